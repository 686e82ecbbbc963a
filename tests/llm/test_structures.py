"""Conversation repair and Merkle manifests against brute force, over many small partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair as repair
from millrace.llm import merkle

NAMES = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    """Least (cost, audit) with its lines, over all states forwards; rows: (role, text, fault)."""
    best = {"": (0, "", [])}

    def more(states):
        out = dict(states)
        for _ in range(2):
            for q, (c, a, lines) in list(out.items()):
                to = NAMES[q][0]
                made = (c + 3, a + "I", [*lines, NAMES[q] + ":"])
                if to not in out or made[:2] < out[to][:2]:
                    out[to] = made
        return out

    for role, text, fault in rows:
        new = {}
        for q, (c, a, lines) in more(best).items():
            moves = [(q, c + 4, a + "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    moves.append((role[0], c + extra, a + "K", [*lines, f"{role}:{text}"]))
                moves.append((NAMES[q][0], c + extra + 3, a + "R", [*lines, f"{NAMES[q]}:{text}"]))
            for to, cost, audit, made in moves:
                if to not in new or (cost, audit) < new[to][:2]:
                    new[to] = (cost, audit, made)
        best = new
    return min(v for q, v in more(best).items() if q in ("", "a"))


def brute(conversations):
    white, out = " \t\n\x0b\x0c\r", {}
    for conv in {r[0] for r in conversations}:
        rows = []
        for c, turn, role, text in (r for r in conversations if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            fault = "blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(white)[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(11)
    said = ["One.", "two", "Three!", " \t", "", "Is it?", "é ü.  \n", None, "x." * 3000]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(said) if rnd.random() < 0.4 else f"Line {rnd.random()}" + rnd.choice(".?!,")) for c in range(40) for t in range(rnd.randrange(1, 14))]
    rows += [(777, t, ["user", "assistant"][t % 2] if rnd.random() < 0.9 else "system", f"Turn {t % 190}.") for t in range(400)]
    rows += [(None, t, "user", "Hello.") for t in (None, None, 3, 9)] + [(50, None, None, None), (51, 4, "user", "Same.")] + [(52, 1, "user", "Again.")] * 30
    return rows


@pytest.mark.parametrize("size", [{}, {"piece_rows": 25}, {"piece_rows": 3}])
def test_repair_against_brute_force(spark, talks, size):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("_part", F.lit(1)).withColumn("copies", F.lit("x"))
    got = repair.repair(repair.damage(df), **size).collect()
    want = brute(talks)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damage(df)).collect() == []


def brute_tree(rows, fanout):
    def H(*x):
        return hashlib.sha256("".join(x).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def paths(nodes):
        path, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for j, i in enumerate(at):
                run = runs[i // fanout]
                path[j].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
                at[j] = i // fanout
            nodes = [H(*r) for r in runs]
        return nodes[0], path

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), H(*map(field, r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: paths([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    root, upper = paths([made[s][0] for s in order])
    out = []
    for s, up in zip(order, upper):
        for (_, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:2]), made[s][1]):
            out.append((r[0], leaf, made[s][0], root, H(*[a + b for a, b in path + up]), [list(p) for p in path + up]))
    return out


@pytest.mark.parametrize(("fanout", "rows_each", "parts"), [(16, 100_000, 1), (16, 37, 9), (2, 10, 30), (3, 1, 4)])
def test_manifest_against_brute_force(spark, fanout, rows_each, parts):
    rnd = random.Random(fanout)
    rows = [(i if i % 50 else None, rnd.choice(["hot", "hot", "hot", "é", "zz", None]), None if i % 7 == 0 else "en", i % 5 or None, rnd.choice(["", None, "x" * 50_000, f"Text {i}"])) for i in range(240 if rows_each > 1 else 60)]
    rows += [(3, "lone", "en", 1, "A")] + [(5, "twins", "en", 1, "Same")] * 17
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("g", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("path", F.lit(3))
    got = merkle.manifest(df.repartition(parts), merkle.FIELDS, "source", "doc_id", fanout=fanout, rows=rows_each)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    table = got.select("doc_id", "leaf", "subroot", "root", proof.alias("proof"), "path", merkle.fold(F.col("path"), F.col("leaf")).alias("folded")).collect()
    assert all(r.folded == r.root for r in table)
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, [[p.before, p.after] for p in r.path]) for r in table), key=key) == sorted(brute_tree(rows, fanout), key=key)


def test_manifest_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(1, None, None, None, "A b")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df.limit(0), merkle.FIELDS, "source", "doc_id").collect() == []
    row = merkle.manifest(df, merkle.FIELDS, "source", "doc_id").collect()[0]
    assert row.leaf == row.subroot == row.root == hashlib.sha256(b"1:1---3:A b").hexdigest() and row.path == []


def test_tampering_is_found(spark):
    rows = merkle.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        bad = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text[r.doc_id])
        assert r.verified == (not bad) and (r.folded_root == r.root) == r.verified
    assert 0 < sum(r.verified for r in rows) < len(rows)
