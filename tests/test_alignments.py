import random
import time

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import alignments, sequences

RND = random.Random(6)


def dna(n):
    return "".join(RND.choice("ACGT") for _ in range(n))


def plain_stack(rows):
    """Every row against every column, position by position."""
    extra = {}
    cells = []
    for read, sub, start, seq in rows:
        pos, own = start - 1, {}
        for ch in seq:
            if ch.islower():
                own[pos] = own.get(pos, "") + ch.upper()
            else:
                pos += 1
                own[pos, 0] = ch
        cells.append((read, sub, start, pos, own))
        for p, v in own.items():
            if not isinstance(p, tuple):
                extra[sub, p] = max(extra.get((sub, p), 0), len(v))
    out = {}
    for read, sub, start, end, own in cells:
        text = own.get(start - 1, "")
        for p in range(start, end + 1):
            text += own[p, 0]
            if p < end or p in own:
                text += own.get(p, "").ljust(extra.get((sub, p), 0), "-")
        column = start + sum(n for (s, p), n in extra.items() if s == sub and p < start)
        out[read] = (column, text)
    return out, extra


def test_stack_and_subjects_against_a_plain_loop(spark):
    rows = []
    for i in range(120):
        seq = ""
        for _ in range(RND.randrange(4, 30)):
            seq += RND.choice("ACGT-" if seq else "ACGT") + (dna(RND.randrange(1, 4)).lower() if RND.random() < 0.1 else "")
        rows.append((i, RND.choice(["s1", "s1", "s2"]), RND.randrange(1, 80), seq))
    df = spark.createDataFrame(rows, "read long, sub string, sub_start long, seq string")
    want, extra = plain_stack(rows)
    got = alignments.stack(df, width=16)
    assert {r.read: (r.column, r.row) for r in got.collect()} == want
    subject = {"s1": dna(110), "s2": dna(110)}
    made = alignments.stack_subjects(df, spark.createDataFrame(list(subject.items()), "sub string, seq string"))
    assert {r.sub: r.row for r in made.collect()} == {s: "".join(c + "-" * extra.get((s, i), 0) for i, c in enumerate(t, 1)) for s, t in subject.items()}


def test_consensus_columns_and_matches(spark):
    rows = [(1, "s", 1, "ACgtG"), (2, "s", 1, "ACG"), (3, "s", 2, "CgG-"), (4, "s", 2, "TG")]
    df = spark.createDataFrame(rows, "read long, sub string, sub_start long, seq string")
    got = {(r.pos, r.k): (r.base, r.n, r.cover) for r in alignments.consensus_columns(df).collect()}
    assert got == {(1, 0): ("A", 2, 2), (2, 0): ("C", 3, 4), (2, 1): ("-", 2, 4), (2, 2): ("-", 3, 4), (3, 0): ("G", 4, 4), (4, 0): ("-", 1, 1)}
    ref = spark.createDataFrame([("s", 1, "A"), ("s", 2, "C"), ("s", 3, "G"), ("s", 4, "T")], "sub string, pos long, ref string")
    counts = {r.read: (r.matches, r.mismatches, r.inserted, r.deleted) for r in alignments.match_counts(df, ref).collect()}
    assert counts == {1: (3, 0, 2, 0), 2: (3, 0, 0, 0), 3: (2, 0, 1, 1), 4: (1, 1, 0, 0)}


def test_seed_hits_equal_the_plain_join(spark):
    subjects = [("p", "A" * 60), *((f"s{i}", dna(200)) for i in range(5))]
    reads = [(i, s[1][j : j + 40]) for i in range(60) for s in [RND.choice(subjects)] for j in [RND.randrange(len(s[1]) - 20)]] + [(100 + i, dna(50)) for i in range(40)] + [(200, None), (201, "AC")]
    r, s = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(subjects, "id string, seq string")
    plain = sequences.kmer_hits(r, s, 11)
    key = lambda df: sorted((x.id, x.sub, x.diagonal, x.hits) for x in df.collect())
    assert key(alignments.seed_hits(r, s, 11, hot=50)) == key(plain)
    own = sequences.kmers(s.withColumnRenamed("id", "sub"), 11, ("sub",)).select(F.xxhash64("kmer").alias("h"))
    known = alignments.bloom(own, "h", 1000)
    others = sequences.kmers(r.where("id between 100 and 139"), 11).select(F.xxhash64("kmer").alias("h"))
    assert own.where(~alignments.may_hold(known, "h")).count() == 0
    assert others.where(alignments.may_hold(known, "h")).count() < 0.1 * others.count()


def plain_align(q, s, d, band, match=5, mismatch=-4, gap_open=-12, gap_next=-6):
    """Cell by cell."""
    n = len(s)
    neg = -(1 << 28)
    h, e = np.zeros(n + 1, np.int64), np.full(n + 1, neg)
    origin = np.stack([np.arange(n + 1), np.zeros(n + 1, np.int64)], 1)
    eo, best = origin.copy(), (0, 0, 0, 0, 0)
    sb = np.frombuffer(s.encode(), np.uint8)
    for i, ch in enumerate(q.encode(), 1):
        lo, hi = max(1, i + d - band), min(n, i + d + band)
        nh, no = np.zeros(n + 1, np.int64), np.stack([np.arange(n + 1), np.full(n + 1, i)], 1)
        f, fo = neg, (0, 0)
        for j in range(lo, hi + 1):
            open_e, open_f = h[j] + gap_open, nh[j - 1] + gap_open
            if open_e > e[j] + gap_next:
                e[j], eo[j] = open_e, origin[j]
            else:
                e[j] += gap_next
            f, fo = (open_f, tuple(no[j - 1])) if open_f > f + gap_next else (f + gap_next, fo)
            diag = h[j - 1] + (match if sb[j - 1] == ch else mismatch)
            v = max(0, diag, e[j], f)
            nh[j] = v
            if v:
                no[j] = origin[j - 1] if v == diag else eo[j] if v == e[j] else fo
                if v > best[0]:
                    best = (int(v), int(no[j][0]), j, int(no[j][1]), i)
        h, origin = nh, no
    return best


def test_batches_align_like_the_plain_loop(spark):
    pairs = []
    for i in range(60):
        s = dna(RND.randrange(5, 90))
        a = RND.randrange(len(s))
        q = list(s[a : a + RND.randrange(1, 60)])
        for _ in range(RND.randrange(6)):
            k = RND.randrange(len(q) + 1)
            q[k : k + RND.randrange(3)] = RND.choice(["", "A", "GT", "CCC"])
        pairs.append((i, "".join(q), s, a))
    pairs += [(100, "", "ACGT", 0), (101, "ACGT", "", 0), (102, None, None, None), (103, "ACGTACGT", "ACGTACGT", 3)]
    df = spark.createDataFrame(pairs, "id long, query string, subject string, diagonal long").repartition(2).cache()
    cols = ("score", "s_start", "s_end", "q_start", "q_end")
    for band in (4, 32):
        fast = {r.id: tuple(r[c] for c in cols) for r in alignments.local_alignments(df, band=band).collect()}
        slow = {i: plain_align(q or "", s or "", d or 0, band) for i, q, s, d in pairs}
        assert fast == slow
    kept = alignments.local_alignments(df, min_length=20, max_mismatch_pct=5.0).collect()
    assert kept and all(r.q_end - r.q_start >= 20 and r.matches >= 0.95 * (r.q_end - r.q_start) for r in kept)
    assert alignments.align_batch(["ACGT"], ["TTACGTTT"], np.array([0]), 5, -4, -12, -6, 8).tolist() == [[20, 2, 6, 0, 4, 4]]


def test_batches_are_fast():
    q = [dna(150) for _ in range(256)]
    began = time.time()
    alignments.align_batch(q, q, np.zeros(256, np.int64), 5, -4, -12, -6, 32)
    fast, began = time.time() - began, time.time()
    for x in q[:4]:
        plain_align(x, x, 0, 32)
    assert 20 * fast < 64 * (time.time() - began)


def brute_start(text, adapter, errors):
    def distance(i):
        row = list(range(len(adapter) + 1))
        best = row[-1]
        for ch in text[i:]:
            new = [row[0] + 1]
            for k, a in enumerate(adapter, 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (a != ch)))
            row = new
            best = min(best, row[-1])
        return best

    d = [distance(i) for i in range(len(text))]
    for i, x in enumerate(d):
        if x <= errors:
            while i + 1 < len(text) and d[i + 1] < d[i]:
                i += 1
            return i
    return len(text)


def test_adapters_against_edit_distances(spark):
    adapter, texts = "ACGTTGCA", []
    for _ in range(150):
        a = list(adapter)
        for _ in range(RND.randrange(3)):
            k = RND.randrange(len(a))
            a[k : k + 1] = RND.choice(["", "A", "GT"])
        texts.append(dna(RND.randrange(20)) + "".join(a) + dna(RND.randrange(6)))
    texts += ["", adapter, "A"]
    for errors in (0, 1, 2):
        assert alignments.adapter_starts(texts, adapter, errors).tolist() == [brute_start(t, adapter, errors) for t in texts]
    df = spark.createDataFrame([(1, "GGGACGTAGCATT", list(range(13))), (2, None, None)], "id long, seq string, qual array<int>")
    assert [(r.seq, r.qual) for r in alignments.trim_adapters(df, [adapter], 1).orderBy("id").collect()] == [("GGG", [0, 1, 2]), (None, None)]
    masked = alignments.mask(df, min_quality=2, positions=[(4, 5)]).orderBy("id").first()
    assert masked.seq == "NNGNNGTAGCATT"


def test_reads_of_one_sequence_are_looked_up_once(spark, monkeypatch):
    looked, real = [], alignments.kmers
    monkeypatch.setattr(alignments, "kmers", lambda df, *a: looked.append(df.count()) or real(df, *a))
    reads = spark.createDataFrame([(f"r{i}", "ACGTACC" if i % 3 else "GGGACGT") for i in range(40)] + [("r1", "ACGT"), ("none", None)], "id string, seq string")
    got = {tuple(r) for r in alignments.seed_hits(reads, reads.where("id in ('r1', 'r2')"), 4).where("id in ('r3', 'r4', 'r1') and sub = 'r1'").collect()}
    assert max(looked) == 3
    assert got == {("r3", "r1", -3, 2), ("r4", "r1", 0, 5), ("r1", "r1", 0, 7)}


def test_stacked_reads_are_joined_once_and_not_shuffled(spark):
    rows = [(0, None, 3, "AgC"), (1, None, 3, "AC"), (2, None, 9, "acgTT"), (3, "s", 7, ""), (4, "s", 8, "tt"), (5, "s", 5, "A" + "Cg" * 3), (6, "s", -40, "ACGTT" * 60), (7, "s", 1, "A" * 9 + "gg")]
    for i in range(8, 90):
        seq = "".join(RND.choice("ACGT-") + (dna(2).lower() if RND.random() < 0.2 else "") for _ in range(RND.choice([1, 2, 3, 8, 40, 300])))
        rows.append((i, RND.choice(["s", "t", None]), RND.randrange(-20, 500), seq))
    df = spark.createDataFrame(rows, "read long, sub string, sub_start int, seq string")
    want, _ = plain_stack(rows)
    for width in (1, 4, 1000):
        got = alignments.stack(df, width)
        assert {r.read: (r.column, r.row) for r in got.collect()} == want
    assert "hashpartitioning" not in got._jdf.queryExecution().toString()
    odd = spark.createDataFrame([(1, "s", None, "AcC"), (2, "s", 4, None), (3, "s", 2, "AcC"), (4, "s", 3, "GG")], df.schema)
    assert {r.read: (r.column, r.row) for r in alignments.stack(odd).collect()} == {1: (None, "ACC"), 2: (5, ""), 3: (2, "ACC"), 4: (4, "GG")}
