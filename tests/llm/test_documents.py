import base64
import functools
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import base, bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, media, registry, substring_dedup

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 900}" for i in range(30_000))
EXTRA = ("chunk", "bucket", "n", "hash", "template", "salt", "gone", "ids", "label", "tok", "w", "component_id", "item_id")


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, clashing names."""
    rnd = random.Random(3)
    words = [f"x{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    a, b = text(120), text(60)
    near = a.split()
    near[60] = "changed"
    rows = [(1, a), (2, a.upper()), (3, " ".join(near)), (4, b), (5, text(80) + " " + b), (6, ""), (7, None), (8, " \n\t "), (9, "one two"), (10, "ONE  two\n"), (11, LONG), (12, LONG + " end"), (None, a), (None, None), (4, b), (13, "İstanbul é \x1c x y"), (14, "word\n" * 50), (15, "x" * 200_000)]
    df = spark.createDataFrame([(d, t, "en" if d and d % 2 else None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_components(rows, share=75, k=5):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    best = {d: d for d, _ in sets}
    changed = True
    links = [(x, y) for x, s in sets for y, t in sets if s and t and 100 * len(s & t) >= share * len(s | t)]
    while changed:
        changed = False
        for x, y in links:
            m = min(best[x], best[y])
            if best[x] != m or best[y] != m:
                best[x] = best[y] = m
                changed = True
    return best, {d: len(s) for d, s in sets}


@pytest.mark.parametrize("caps", [{}, {"members": 2, "shingles": 300}])
def test_jaccard_join_on_hostile_rows(spark, hostile, caps):
    best, sizes = brute_components(pairs(hostile))
    got = jaccard_join.jaccard_components(hostile, **caps).collect()
    assert len(got) == hostile.count()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(best.items())
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id not in (None,))


def test_jaccard_join_against_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(25):
        seed = [f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 90))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(seed)
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(400)}"
            rows.append((len(rows) * 3 % 1009, "lead line shared by many here " * (g % 2) + " ".join(w)))
    best, _ = brute_components(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(best.items())


def test_voronoi_region_matches_brute_force():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        core = rng.integers(0, 3000, 80)
        sets += [np.unique(np.where(rng.random(80) < 0.05, rng.integers(0, 3000, 80), core)).astype(np.uint64) for _ in range(rng.integers(1, 8))]
    region = jaccard_join.Region(sets, 75)
    region.join(np.arange(len(sets)))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = region.roots(np.arange(len(sets)))
    assert len({(int(g), root(i)) for i, g in enumerate(got)}) == len({int(g) for g in got}) == len({root(i) for i in range(len(sets))})


def test_word_hashes_agree_with_bytes_split():
    texts = [" a  b\tc\x0b", "", None, "\x1c x", "é y z", LONG, "q" * (base.SPAN + 5) + " r"]
    words, offsets = base.split_words(pa.array(texts))
    expected = [w for t in texts for w in (t or "").encode().split()]
    assert words.cast(pa.binary()).to_pylist() == expected
    assert np.diff(offsets).tolist() == [len((t or "").encode().split()) for t in texts]
    h = base.hash_words(words)
    assert len({*h.tolist()}) == len({*expected}) and dict(zip(expected, h.tolist())) == {w: x for w, x in zip(expected, h.tolist())}


def test_substring_dedup_against_brute_force(spark, hostile):
    rows = sorted(pairs(hostile), key=lambda r: (r[0] is None, r[0] or 0))
    last = 1 << 62
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            least[g] = min(least.get(g, last), last if d is None else d)
    expected = []
    for d, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < (last if d is None else d):
                keep[i : i + 13] = [False] * 13
        k = [x for x, y in zip(w, keep) if y]
        expected.append((d, len(w), len(w) - len(k), b" ".join(k).decode()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(hostile).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_difference_cover_holds():
    assert all(any((i + d) % 7 in substring_dedup.COVER and (j + d) % 7 in substring_dedup.COVER for d in range(7)) for i in range(7) for j in range(7))


def test_bpe_stitching_and_merges(spark, hostile):
    path, pattern = bpe.public_vocabulary()
    pat, ranks, rnd = regex.compile(pattern), bpe.load_ranks(path), random.Random(1)
    for _ in range(200):
        s = "".join(rnd.choice(["a", " ", "  ", "\n", "'s", "1", "!!", "é", "word" * rnd.randint(1, 9), " " * rnd.randint(1, 30)]) for _ in range(rnd.randint(0, 300)))
        assert bpe.split(pat, s, rnd.randint(20, 60), rnd.randint(3, 15)) == pat.findall(s)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(hostile.select("doc_id", "text", F.lit(3).alias("ids"), F.lit("x").alias("decoded")), path, pattern, size=500, overlap=50), path).collect()
    once = bpe.encode(hostile.select("doc_id", "text", F.lit(3).alias("ids"), F.lit("x").alias("decoded")), path, pattern, size=500, overlap=50, decoded="decoded").collect()
    assert sorted(map(repr, once)) == sorted(map(repr, rows))  # both in one pass
    for r in rows:
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert base64.b64encode(b"x") and bpe.merge(b"", ranks) == ()


def test_media_round_trip_and_checksums(spark, hostile):
    for r in media.features(media.store(hostile)).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and len(r.feature) == 16
    texts = {hashlib.sha256((t or "").encode() + b"\0" * (-len((t or "").encode()) % 64 if t else 64)).hexdigest() for _, t in pairs(hostile)}
    assert {r.payload_sha256 for r in media.features(media.store(hostile)).collect()} == texts
    rng = np.random.default_rng(2)
    for kind in range(5):
        x = rng.integers(0, 256, (11, 64)).astype(np.uint8)
        png = media.write_png(x.tobytes(), kind=kind)
        assert (media.read_png(png) == x).all()
        for at in (4, 20, 45, len(png) - 6):
            with pytest.raises(ValueError):
                media.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    assert zlib.crc32(b"") == 0


def test_language_id(spark, hostile, empty):
    got = {r.doc_id: r for r in registry.QUERIES["op5_language_id"](spark, SF).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.values())
    profiles = language_id.learn(hostile)
    own = language_id.predict(hostile, profiles).collect()
    assert {r.lang_pred for r in own if r.doc_id in (6, 7, 8)} == {"und"} and len(own) == hostile.count()
    assert language_id.learn(empty) == {} and language_id.predict(hostile, {}).count() == hostile.count()
    assert language_id.ranked(np.array([1, 2, 3]), np.array([5, 9, 5])).tolist() == [2, 1, 3]


def test_language_id_with_a_hot_group_of_copies(spark):
    few = spark.range(20).selectExpr("id as doc_id", "concat('wort nummer ', id, ' der kleinen liste') as text", "'de' as lang")
    hot = spark.range(30_000).selectExpr("id + 100 as doc_id", "concat('wort nummer ', id % 3, ' der kleinen liste') as text", "'de' as lang")
    profiles = language_id.learn(few.unionAll(hot), sample=20)
    assert profiles == language_id.learn(few, sample=20) and len(profiles["de"]) > 20


def test_line_dedup(spark, hostile, empty):
    rows = [(i, f"unique beginning number words {'abcdefghijk'[i]}\nPosted {i} times by user{i}@mail\nending of this {'abcdefghijk'[i]} text") for i in range(8)]
    copies = [(100 + i, "the very same line\nand then the second one\nand a third line") for i in range(20)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed == 1 and "Posted" not in got[i].kept_text for i in range(8))
    assert all(got[100 + i].n_removed == 0 for i in range(20))  # whole copies keep their lines
    own = line_dedup.drop_recurring(hostile).collect()
    assert len(own) == hostile.count() and all(r.n_lines == (r.text or "").count("\n") + 1 for r in own)


def test_line_dedup_in_any_place(spark):
    own = lambda i, k: f"{'abcdefghij'[i]}{'abcdefghij'[k]} begins a paragraph that stands in this document alone"
    rows = [(i, f"{own(i, 0)}\n\nThis notice recurs everywhere.\n\n{own(i, 1)}\nRead more\nfirst footer line\nsecond footer line\nthird footer line") for i in range(8)]
    near = [(100 + i, "\n".join("edited" if i == k else f"near copy line {'abcdefghij'[k]} with words" for k in range(10))) for i in range(10)]
    docs = spark.createDataFrame(rows + near + [(200 + i, rows[0][1]) for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs).collect()}
    assert all(got[i].kept_text == f"{own(i, 0)}\n\n\n{own(i, 1)}" for i in range(8)) and got[200].kept_text == got[0].kept_text
    assert all(got[100 + i].n_removed == 0 for i in range(10))  # left to the near-duplicate stage


def test_decontamination(spark, hostile, empty):
    item = "In 2001 a train left Berlin at 33 km per hour and reached Wien after 33 minutes of travel time in total."
    docs = spark.createDataFrame(
        [
            (1, "Start. " + item + " End"),
            (2, "Start. " + item.replace("33", "50").replace("2001", "1999").replace("Berlin", "Rome") + " End"),
            (3, "Start. " + item.replace("33 km", "50 km") + " End"),
            (4, "nothing to see here at all, only some words that no item has"),
            (5, None), (6, ""), (None, item), (7, "tiny item of seven words right here"),
        ],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "tiny item of seven words right here", 1), (10, "two words", 1), (None, item, 1)], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id): r.literal for r in decontaminate.matches(docs, bench).collect()}
    assert got[(1, 7)] is True and got[(2, 7)] is False and (7, 9) in got and not any(d in (3, 4, 5, 6) for d, _ in got if d != 3)
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(docs, bench).collect() if r.doc_id in (4, 5, 6, None)) == [0, 4, 5, 6]
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(hostile, bench).count() == 0
    kept = decontaminate.decontaminate(hostile, bench)
    assert kept.count() == hostile.count() and set(kept.columns) == set(hostile.columns)


def test_decontamination_at_every_alignment(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("rt", "sd", "vg", "wb", "zx")][:22]
    docs = [(100 * k + at, "pad " * at + " ".join(words[5 : 5 + k]) + " end") for k in (10, 11, 12) for at in range(8)]
    docs += [(2000 + at, "pad " * at + " ".join(words[:10] + ["edited"] + words[11:])) for at in range(8)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.matches(docs, bench).collect()}
    assert got == {100 * k + at for k in (11, 12) for at in range(8)} | {2000 + at for at in range(8)}


def test_decontamination_of_names_and_numbers(spark):
    item = "Tom Smith pays 950 coins to Élodie. Tom then gives 3.5 coins away and Élodie counts 12 more for Tom Smith."
    told = item.replace("Tom", "Anna").replace("Smith", "van Dyk".title().replace(" ", "")).replace("950", "1,000").replace("3.5", "7").replace("Élodie", "Örjan")
    docs = [(1, "So it began. " + told), (2, item.lower()), (3, "one may say forty two here"), (4, "forty three two"), (5, told.replace("Anna then", "Eve then").replace("more for Anna", "more for Eve"))]
    bench = [(1, item), (2, "Forty two!"), (3, "Tom, Ann, Bob, Eve, Zoe, Max, Kim, Joe, Lea, Sam, Ida, Ben")]
    docs += [(6, "Rom, Ulm, Bonn, Genf, Wien, Prag, Oslo, Kiel, Jena, Gera, Hof, Suhl")]
    got = {(r.doc_id, r.item_id): r.literal for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): True}


def test_license_scan(spark, hostile):
    texts = ["CC BY cc by; all rights reserved", "GNU General Public License, version 3 or later", "Licensed under the Apache License, Version 2.0.", "MIT License, CC BY-NC-SA 4.0", "nothing", None, "(c) Copyright 2020 2021"]
    got = [r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert "gpl-3.0-or-later" in got[1].labels and "gpl" in got[1].labels.split(",")
    assert "apache-2.0" in got[2].labels and "apache" not in got[2].labels.split(",")
    assert {"mit", "cc-by-nc-sa-4.0", "cc-by"} <= set(got[3].labels.split(","))
    assert got[4].labels == "" == got[5].labels and got[5].n_words == 0 and got[5].first_word is None and "copyright" in got[6].labels
    pat = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = {d: len(pat.findall((t or "").encode().lower())) for d, t in pairs(hostile) if d}
    assert all(r.n_words == words[r.doc_id] and 0 <= r.score <= 1 for r in license_scan.scan(hostile).collect() if r.doc_id)
    assert len(license_scan.rules()) > 200


def _shortest(parsed):
    """Texts that a rule's regex matches: each branch, each optional part left out."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [chr(a) if str(o) == "LITERAL" else chr(a[0]) for o, a in arg]
        elif name == "SUBPATTERN":
            some = _shortest(arg[3])
        elif name == "BRANCH":
            some = [x for branch in arg[1] for x in _shortest(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [x * arg[0] for x in _shortest(arg[2])]
        else:
            assert name == "ASSERT_NOT"
            some = [""]
        out = sorted({x + y for x in out for y in some})
    return out


def test_license_rules_imply_their_keywords(spark):
    for label, _, keyword, pattern in license_scan.rules():
        # s or c in the word itself is the rule's own spelling
        assert all(keyword in f" {x} " for x in _shortest(re._parser.parse(pattern))), (label, keyword, pattern)
    texts = ["SPDX-License-Identifier: GPL-3.0", "released under MPL 2.0", "LGPL-2.1, AGPL 3.0", "EPL-2.0 CDDL 1.1 EUPL-1.2 OSL 3.0 AFL-3.0 OFL-1.1 BSL 1.0 CPL-1.0 ODbL 1.0 GFDL-1.3"]
    got = [set(r.labels.split(",")) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:3] == [{"gpl-3.0"}, {"mpl-2.0"}, {"lgpl-2.1", "agpl-3.0"}]
    assert got[3] == {"epl-2.0", "cddl-1.1", "eupl-1.2", "osl-3.0", "afl-3.0", "ofl-1.1", "bsl-1.0", "cpl-1.0", "odbl-1.0", "gfdl-1.3"}


@pytest.mark.parametrize("run", [jaccard_join.jaccard_components, substring_dedup.remove_repeats, line_dedup.drop_recurring, license_scan.scan, lambda d: media.features(media.store(d)), lambda d: language_id.predict(d, {})])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made, df = db.sql(registry.ORACLE_SQL[name]), registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(made.columns)
    at = [made.columns.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in made.fetchall())


def test_line_dedup_tree(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda i: f"the {letters[i % 26]}{letters[i // 26]} paragraph {letters[i % 26]} of text {letters[i // 26]} number {letters[i % 7]}{letters[i % 26]}{letters[i // 26]} stands here alone"
    footer = "first line of the footer\nsecond line of it\nthird"
    rows = [(i, f"{own(i)}\n{footer}") for i in range(200)]
    rows += [(300 + i, f"{own(i + 200)}\n{1900 + i} {i * 3} {i}.5") for i in range(10)]
    rows += [(400 + i, f"{own(i + 220)}\nPosted in category {letters[i]}work by the editor\nread {i} more\n12 14") for i in range(10)]
    # fields whose values recur, in pairs that don't
    rows += [(500 + i, f"{own(i + 240)}\nsent from my desk {letters[i % 10]} and floor {letters[i // 10]} with best regards to all") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs).collect()}
    assert all(got[i].kept_text == own(i) for i in range(200))
    assert all(got[300 + i].n_removed == 0 for i in range(10))
    assert all(got[400 + i].kept_text == own(i + 220) for i in range(10))
    assert all(got[500 + i].kept_text == own(i + 240) for i in range(100))


def brute_line_dedup(rows, least=5):
    """The tree by plain Python, over rows (doc_id, text)."""
    var = lambda t: re.search("[0-9@]", t) is not None
    lines = lambda t: [(x, " ".join(re.split(r"[ \t\n\x0b\f\r]+", x.strip(" \t\n\x0b\f\r")))) for x in (t or "").split("\n")]
    texts = {t for d, t in rows if d is not None}
    leaf = lambda tok: (len(tok), *("<*>" if var(t) else t for t in tok[:2]))
    cells, made = {}, {}
    for t in texts:
        for _, m in lines(t):
            tok = m.split(" ") if m else []
            at = leaf(tok)
            for k, w in enumerate(tok):
                cells[at, k, w] = cells.get((at, k, w), 0) + 1
    for t in texts:
        for _, m in lines(t):
            tok, own = m.split(" "), [("own", m)]
            at, words = leaf(tok), [(k, w) for k, w in enumerate(tok) if not var(w)]
            often = sorted(((-cells[at, k, w], k, w) for k, w in words if m and cells[at, k, w] >= least))
            for k in range(1, len(often) + 1):
                if k >= len(words) - len(tok) // 6 and 2 * k >= len(tok):
                    own.append((at, frozenset(x[1:] for x in often[:k])))
            if m:
                made[m] = own
    within = {t: {x for _, m in lines(t) if m for x in made[m]} for t in texts}
    count = lambda some: {x: sum(x in within[t] for t in some) for t in texts for x in within[t]}
    first = {x for x, n in count(texts).items() if n >= least}
    near = {t for t in texts if sum(len(x) for x, m in lines(t) if m and first & set(made[m])) > 6 / 7 * sum(len(x) for x, _ in lines(t))}
    far, close = count(texts - near), count(near)
    last = {x for x in first if far[x] + (close[x] > 0) >= least}
    return [(d, "\n".join(x for x, m in lines(t) if not (m and last & set(made.get(m, [("own", m)]))))) for d, t in rows]


def test_line_dedup_against_brute_force(spark, hostile):
    rnd = random.Random(11)
    words = ["ab", "cd", "ef", "gh", "7x", "12"]
    line = lambda: " ".join(rnd.choice(words[: rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 9)))
    pool = [line() for _ in range(25)]
    rows = [(i if i % 9 else None, "\n".join([f"own {'xyzuvw'[i % 6]}{i} text", *(rnd.choice(pool) if rnd.random() < 0.5 else line() for _ in range(rnd.randint(0, 7)))])) for i in range(120)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), hostile):
        own = pairs(df)
        got = sorted(((r.doc_id, r.kept_text) for r in line_dedup.drop_recurring(df).collect()), key=repr)
        assert got == sorted(brute_line_dedup(own), key=repr)


@pytest.mark.parametrize("caps", [{}, {"members": 2, "shingles": 300}])
def test_jaccard_join_with_repeated_and_null_ids(spark, caps):
    rnd = random.Random(9)
    text = lambda: [f"y{rnd.randrange(10**6)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near = lambda t, k: " ".join([*t[:k], "changed", *t[k + 1 :]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a, 0)), (8, near(b, 0)), (9, "alone"), (5, "other"), (None, near(c, 30)), (20, near(c, 59)), (21, " ".join(c[:30] + ["changed"] + c[31:59] + ["z"])), (None, "nobody"), (None, " ".join(text()))]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **caps).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9), (20, 20), (21, 20), (None, 20), (None, None)}


def test_voronoi_cells_split_regions():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        core = rng.integers(0, 1 << 40, 80)
        sets += [np.unique(np.where(rng.random(80) < 0.12, rng.integers(0, 1 << 40, 80), core)).astype(np.uint64) for _ in range(10)]
    region = jaccard_join.Region(sets, 75)
    region.join(np.arange(len(sets)))
    assert region.cells > 40
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    root = region.roots(np.arange(len(sets)))
    assert all(root[i] == root[j] for i in range(len(sets)) for j in range(i // 10 * 10, i) if linked(sets[i], sets[j]))


def test_large_regions_are_cut_into_cells(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        core = rng.integers(0, 10**9, 70)
        rows += [(len(rows) + i, " ".join(f"s{x}" for x in np.where(rng.random(70) < 0.03, rng.integers(0, 10**9, 70), core))) for i in range(25)]
    best, _ = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for caps in ({"members": 10}, {"members": 60, "shingles": 1500}):
        got = jaccard_join.jaccard_components(df, **caps).collect()
        assert {(r.doc_id, r.component_id) for r in got} == set(best.items())


@pytest.mark.parametrize("changed", [0.02, 0.07])
def test_regions_that_pivots_cannot_cut_take_one_round(spark, monkeypatch, changed):
    """Near copies of one text of which many link with none: measured in a round, not a block of pivots a round."""
    rng, rounds, real = np.random.default_rng(5), [], jaccard_join._measured
    monkeypatch.setattr(jaccard_join, "_measured", lambda share: rounds.append(1) or real(share))
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    core = rng.integers(0, 10**9, 70)
    rows = [(i, " ".join(f"s{x}" for x in np.where(rng.random(70) < changed, rng.integers(0, 10**9, 70), core))) for i in range(90)]
    best, _ = brute_components(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), members=10, shingles=1500).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(best.items())
    assert len(set(best.values())) > 20 and len(rounds) <= 2


def test_exchange_rows_are_linear():
    from millrace.llm import exchange

    h = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)
    for n in (1, 7, 1 << 20):
        t = exchange.send(3, h, n)
        assert t.num_rows <= min(n, len(np.unique(h))) and t["bucket"].to_pylist() == sorted(set(t["bucket"].to_pylist()))
        assert sum(len(x) // 8 for x in t["once"].to_pylist()) == len(np.unique(h)) and max(t["bucket"].to_pylist()) < n
    assert exchange.send(3, h[:0], 5).num_rows == 0


def test_decontamination_slots(spark):
    item = "Each of 12 boxes holds 40 pens and New York buys 7 boxes for 12 schools near 40 parks in total"
    told = item.replace("12", "1,250").replace("40", "3.50").replace("7", "1,100").replace("New York", "Baton Rouge City")
    mixed = told.replace("1,250 schools", "99 schools").replace("3.50 parks", "98 parks").replace("Each of 1,250", "Each of 77")
    docs = [(1, "So. " + told + "."), (2, mixed), (3, item.upper()), (4, "in total " + item), (5, told.replace("pens", "cups").replace("schools", "halls").replace("buys", "sells"))]
    got = {(r.doc_id, r.literal) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(1, False), (3, True), (4, True)}
    items = [(i, f"A farmer named {a} owns {i + 3} cows and sells {2 * i + 1} of them to {b} before buying {i * 7 + 2} goats at the spring market") for i, (a, b) in enumerate([("Ola", "Per"), ("Kim", "Jan"), ("Eva", "Ida")])]
    again = [(10 + i, f"intro words {'pad ' * i}A farmer named {a} owns {x} cows and sells {y} of them to {b} before buying {z} goats at the spring market. More.") for i, (a, b, x, y, z) in enumerate([("Max Planck", "Lea", "1,000", "12.5", 3), ("Zoë", "Åsa Berg", 4, 9, "2.000"), ("J", "K", 1, 2, 3)])]
    got = {r.doc_id for r in decontaminate.matches(spark.createDataFrame(again, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {10, 11, 12}


def brute_matches(docs, items):
    """decontaminate.matches by plain Python: {(doc_id, item_id): literal}."""
    letter = r"0-9A-Za-z\u0080-\U0010FFFF"
    units = set(decontaminate.UNITS.split("|"))

    @functools.cache
    def tokens(t):
        t = regex.sub(rf"(?<![{letter}])\p{{Lu}}[{letter}]*(?: \p{{Lu}}[{letter}]*)*", lambda m: "<N>" + m[0].replace(" ", "·") + "<E>", t)
        out, after = [], False
        for w in regex.finditer(r"<N>(.*?)<E>|([0-9]+(?:[.,·][0-9]+)*)|([A-Za-z\u0080-\U0010FFFF][0-9A-Za-z\u0080-\U0010FFFF]*)", t):
            if w[1] is not None:
                out.append(("nam0", w[1].lower()))
            elif w[2] is not None:
                out.append(("num0", regex.sub("[.,]", "·", w[2])))
            else:
                unit = after and w[3].lower() in units and regex.fullmatch(" ?", t[last : w.start()])
                out.append(("uni0" if unit else "", w[3].lower()))
            after, last = w[2] is not None, w.end()
        return out

    def windows(seq, k):
        return [tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)]

    out = {}
    for d, text in docs:
        for i, other in items:
            if None in (d, text, i, other):
                continue
            mine, its = tokens(text), tokens(other)
            for lane in ("lit", "tpl"):
                x, y = ([p for _, v in s for p in v.split("·")] if lane == "lit" else s for s in (mine, its))
                n = len(y)
                k = 8 if n >= 11 else n
                if not n or lane == "tpl" and (k < 5 or not any(a for a, _ in y) or not any(a for a, _ in x)):
                    continue
                key = (lambda w: w) if lane == "lit" else (lambda w: tuple(a or v for a, v in w))
                at, slots = {}, (lambda w: [v for a, v in w if a] if lane == "tpl" else [])  # noqa: B023
                for b, w in enumerate(windows(x, k)):
                    at.setdefault(key(w), []).append((b, w))
                hits, maps = [], {}
                for a, w in enumerate(windows(y, k)):
                    if lane == "tpl" and len(slots(w)) > k - 2:
                        continue
                    for b, v in at.get(key(w), []):
                        hits.append((a, b - a, bool(slots(w))))
                        for p, q in zip(slots(w), slots(v)):
                            maps.setdefault(b - a, {}).setdefault(p, set()).add(q)
                covered = {a + j for a, s, filled in hits if not filled or all(len(q) == 1 for q in maps[s].values()) for j in range(k)}
                if len(covered) >= (11 if n >= 15 else 8 if n >= 11 else n):
                    out[d, i] = out.get((d, i), False) or lane == "lit"
    return out


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(21)
    words = ["the", "old", "of", "kg", "min", "Anna", "Bo", "tree", "12", "3.5", "7", "runs", "é", "Élan", "and", "sees", "near", "v", "red"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", " ", ", ", ". ", "  "]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 6, 8, 10, 11, 13, 15, 25]))) for i in range(40)]
    docs = []
    for i in range(60):
        base_text = rnd.choice(items)[1].split(" ")
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(base_text))
            swap = {"Anna": "Tom", "Bo": "Mary Jane", "12": "1,000", "3.5": "8", "7": "6"}
            base_text[k] = swap.get(base_text[k], base_text[k])
        if i % 2:
            base_text = [swap.get(x, x) for x in base_text]
        docs.append((i, text(rnd.randint(0, 6)) + " ".join(base_text) + text(rnd.randint(0, 30))))
    want = brute_matches(docs, items)
    got = {(r.doc_id, r.item_id): r.literal for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got.items()) ^ set(want.items()) == set() and len(want) > 60 and 5 < sum(not x for x in want.values())


def test_license_places_against_brute_force(spark, hostile):
    table = license_scan.rules()
    texts = [
        "apache license version 2 0 apache license version 2 0", "apache license version 2 0 1, apache license version 2 0", "under the apache license version 2 0 then copyright copyright",
        "Copyright 2001 2002 copyright (c) 2003. All rights reserved. ALL RIGHTS RESERVED", "mit license mit license the mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "CC BY-SA 4.0 cc by cc by nc 2.0 é", " ", None, "copyright " * 3000,
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    compiled = [(a, p, k, re.compile(f" (?:{r})(?= )")) for a, p, k, r in table]
    want = {}
    for d, t in docs:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        w = " " + "".join(x + " " for x in words)
        at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        found = [(m.start(), m.end(), a, p) for a, p, k, r in compiled if k in w for m in r.finditer(w)]
        if len(found) < 2000:
            found = [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and (y[3] > x[3] or y[3] == x[3] and y[1] - y[0] > x[1] - x[0]) for y in found)]
        base_labels = sorted({x for _, x in at})
        want[d] = (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(base_labels), ",".join(sorted({*base_labels, *(x[2] for x in found)})), 1 - 2.0 ** -len(found), sorted(found))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(x.a, x.b, x.label, x.rank) for x in r.detections]) for r in got} == want
    assert [(x.a, x.b) for x in next(r for r in got if r.doc_id == 0).detections] == [(0, 27), (27, 54)] and want[0][5] == "apache-2.0"
    assert len(license_scan.scan(hostile).collect()) == hostile.count()


def plain_png(media):
    """Samples by the PNG standard, one by one; its chunks and row kinds."""
    at, data = 8, b""
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        if media[at + 4 : at + 8] == b"IHDR":
            width, height = (int.from_bytes(media[at + k : at + k + 4], "big") for k in (8, 12))
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    raw, rows, kinds = zlib.decompress(data), [], []
    for r in range(height):
        line, above = raw[r * (width + 1) : (r + 1) * (width + 1)], rows[-1] if rows else [0] * width
        kinds.append(line[0])
        out = []
        for c in range(width):
            a, b, d = out[c - 1] if c else 0, above[c], above[c - 1] if c else 0
            p = a + b - d
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out.append((line[c + 1] + (0, a, b, (a + b) // 2, near)[line[0]]) % 256)
        rows.append(out)
    return rows, kinds


def plain_cosine_hash(rows):
    """The feature by its definition, in plain Python."""
    import math
    import statistics

    def shrunk(line):
        cuts = [k * len(line) // 32 for k in range(32)] + [len(line)]
        return [sum(line[a:b]) / (b - a) if len(line) >= 32 else line[a] for a, b in zip(cuts, cuts[1:])]

    cols = list(zip(*[shrunk(c) for c in zip(*rows)]))
    grid = [shrunk(r) for r in cols]
    wave = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [sum(wave[u][i] * wave[v][j] * grid[i][j] for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    m = statistics.median(low[1:])
    return low, m


def test_media_columns_against_brute_force(spark, hostile):
    some = [(d, t) for d, t in pairs(hostile) if len(t or "") < 3000]
    docs = spark.createDataFrame([*some, (50, "naïve – text\n" * 90), (51, "".join(chr(33 + i % 90) for i in range(5000)))], "doc_id long, text string")
    stored = {(r.doc_id, r.n_bytes): bytes(r.media) for r in media.store(docs).collect()}
    got = media.features(media.store(docs)).collect()
    texts = {(d, len((t or "").encode())): (t or "").encode() for d, t in pairs(docs)}
    used = set()
    for r in got:
        own, png = texts[r.doc_id, r.n_bytes], stored[r.doc_id, r.n_bytes]
        rows, kinds = plain_png(png)
        used |= set(kinds)
        payload = bytes(x for row in rows for x in row)
        assert payload == own + b"\0" * (len(payload) - len(own)) and len(payload) == max(64, -(-len(own) // 64) * 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        low, m = plain_cosine_hash(rows)
        bits = f"{int(r.feature, 16):064b}"
        assert all(abs(x - m) < 1e-5 or (x > m) == (b == "1") for x, b in zip(low, bits))
    assert len(got) == docs.count() and len(used) >= 4


def test_png_filters_and_errors():
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (h, 64)).astype(np.uint8) for h in (1, 7, 200, 3)]
    images.append(np.cumsum(rng.integers(0, 5, (40, 64)), axis=1).astype(np.uint8))
    for kind in (None, 0, 1, 2, 3, 4):
        made = media.write_pngs([x.tobytes() for x in images], kind=kind)
        assert made == [media.write_png(x.tobytes(), kind=kind) for x in images]
        assert all((a == b).all() for a, b in zip(media.read_pngs(made), images))
        assert all(plain_png(m)[0] == x.tolist() for m, x in zip(made, images))
    png = media.write_png(images[1].tobytes())
    for cut in range(len(png)):
        with pytest.raises(ValueError):
            media.read_png(png[:cut])
    wrong = media._chunk(b"IDAT", zlib.compress(b"\x07" + b"\0" * 64)).join([png[:33], media._chunk(b"IEND", b"")])
    for bad in (wrong, png[:8] + media._chunk(b"IHDR", b"abc") + png[33:], png[:33] + png[-12:], b"", b"x" * 50):
        with pytest.raises(ValueError):
            media.read_png(bad)
    assert media.read_pngs([]) == []


def brute_language(rows, learn_from, top=400, sample=1500):
    """{doc_id: (language, score)} by out-of-place distance, in plain Python; for at most ``sample`` texts of a language."""
    from collections import Counter

    def ranked(texts):
        counts = Counter()
        for t in texts:
            padded = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {t.lower()} "))
            counts.update(c for c in padded if c != " ")
            counts.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))][:top]

    by = {}
    for t, lang in learn_from:
        if t is not None and lang is not None:
            by.setdefault(lang, set()).add(t)
    assert all(len(x) <= sample for x in by.values())
    profiles = {lang: {g: i for i, g in enumerate(ranked(x))} for lang, x in by.items()}
    out = {}
    for d, t in rows:
        own = ranked([t or ""]) if any(c.isalpha() for c in t or "") else []
        far = {lang: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) for lang, p in sorted(profiles.items())}
        best = min(far, key=far.get) if own and far else "und"
        out[d] = (best, 1 - far[best] / (top * len(own)) if own and far else 0.0)
    return out


def test_language_id_against_brute_force(spark, hostile):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionAll(hostile.where("doc_id is not null and length(text) < 5000").dropDuplicates(["doc_id"]).selectExpr("doc_id + 10000 as doc_id", "text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    want = brute_language([r[:2] for r in rows], [r[1:] for r in rows])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(abs(got[d][1] - x[1]) < 1e-9 for d, x in want.items())


@pytest.mark.parametrize("run", [lambda d: bpe.decode(bpe.encode(d, *bpe.public_vocabulary()), bpe.public_vocabulary()[0]), lambda d: decontaminate.matches(d, d.selectExpr("doc_id as item_id", "text")), lambda d: decontaminate.decontaminate(d, d.selectExpr("doc_id as item_id", "text"))])
def test_more_empty_tables(empty, run):
    assert run(empty).collect() == []
