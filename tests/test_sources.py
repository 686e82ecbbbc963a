import csv
import io
import random

import pyarrow as pa
import pytest

from millrace.queries.catalog import QUERIES
from millrace.sources import formats, lattice, records

TRICKY = 'id,note,n\r\n1,"two\nlines, and ""quotes""",5\n2,5" pipe,6\n\n3,"",7\n4,a"b"c,8\n5,"x\r\n\n\ny",9\n6,"tail",10\n'


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield cut
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def test_states_over_all_cuts():
    """However lines are dealt to blocks, the chained states mark the same lines as one pass."""
    for text, rule in ((TRICKY, records.Quoted()), ("@a\nAC\n+\nII\n\n@b\n\n+\n\n@c\nA\n+\n@\n", records.FourLines()), ("x\n>a\nAC\n\n>b\nG\n", records.Headed())):
        lines = pa.array(text.split("\n")[:-1])
        whole = rule.kinds(lines, 0)[0]
        for a in range(len(lines) + 1):
            for b in range(a, len(lines) + 1):
                parts = [p for p in ((0, a), (a, b), (b, len(lines))) if p[0] < p[1]]
                rows = []
                for i, j in parts:
                    for state in range(rule.states):
                        kinds, ends = rule.kinds(lines.slice(i, j - i), state)
                        rows.append({"file": "f", "block": i, "state": state, "ends": ends, "begun": (kinds == 1).sum(), "continued": (kinds == 2).sum()})
                known, continued = records.chained(rows)
                assert continued == (whole == 2).sum()
                assert [k for i, j in parts for k in rule.kinds(lines.slice(i, j - i), known["f", i][0])[0]] == list(whole)
                for i, _ in parts:
                    owner = [p for p, q in parts if p < i and 1 in whole[p:q]]
                    assert known["f", i][1] == (owner[-1] if owner else None)


def test_csv_over_cuts(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes(TRICKY.encode())
    rule = records.Quoted()
    want = [r for r in csv.reader(io.StringIO(TRICKY, newline="")) if r]
    for size in (17, 1000):
        small_blocks(size)
        rows = records.records(spark, str(tmp_path / "a.csv"), rule)
        got = [next(csv.reader(io.StringIO(r.text, newline=""))) for r in sorted(rows.collect(), key=lambda r: (r.file, r.block, r.k))]
        assert got == want, size


def test_csv_keeps_rows_and_their_order(spark, tmp_path, small_blocks):
    rnd = random.Random(3)
    cells = ['plain', 'with, comma', 'two\nlines', '"', 'say ""', '\n\n', '', 'é ü', '5" x', ' lead']
    rows = [[str(i), rnd.choice(cells), rnd.choice(cells)] for i in range(700)]
    for name in ("b.csv", "a.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, quoting=csv.QUOTE_MINIMAL).writerows([["id", "x", "y"], *(rows[:400] if name == "a.csv" else rows[400:])])
    small_blocks(500)
    df = formats.read_csv(spark, str(tmp_path))
    assert df.dtypes == [("id", "int"), ("x", "string"), ("y", "string")]
    got = [[str(r.id), r.x or "", r.y or ""] for r in df.collect()]
    strip = lambda t: [[a, b.strip(" "), c.strip(" ")] for a, b, c in t]
    assert strip(got) == strip(rows)
    window = formats.read_csv(spark, str(tmp_path), parse_start=398, parse_count=4)
    assert [r.id for r in window.collect()] == [398, 399, 400, 401]


def test_csv_round_trip_keeps_odd_texts(spark, tmp_path, small_blocks):
    """Nulls, empty texts, outer blanks, lone carriage returns and the character 0 come back, with and without newlines in the table."""
    odd = [None, "", " ", " x ", "\tx\t", "\r", "a\rb", "x\r", "\0", "a\0", '"', '",\r"', "\\", "null", "\ufeffx\x85"]
    for name, texts in (("lines", odd), ("newlines", [*odd, "\n", "x\n", "\r\n", "a\r\n\nb", '"\n,"'])):
        rows = [(None if i == 3 else i, x, texts[(i * 7 + 3) % len(texts)], texts[-i], None if i == 5 else -i) for i, x in enumerate(texts)]
        sf = tmp_path / name
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(sf / "documents.parquet"))
        for size in (40, 100000):
            small_blocks(size)
            assert sorted(map(tuple, QUERIES["src_csv_round_trip"](spark, str(sf)).collect()), key=repr) == sorted(rows, key=repr), (name, size)


def test_csv_round_trip_keeps_texts_that_look_like_numbers(spark, tmp_path):
    rows = [(1, "007", "true", "1.50", 3), (2, "+8", "TRUE", "2020-01-01", 2), (3, "9", "false", "2020-01-02 10:00", 10**12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, QUERIES["src_csv_round_trip"](spark, str(tmp_path)).collect())) == rows


def test_carriage_returns_outside_quotes_end_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r1,"x"\r2,y\r')
    (tmp_path / "b.csv").write_bytes(b'a,b\r\n1,"x\ry"\r\n2,""\r\n')
    assert [tuple(r) for r in formats.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in formats.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [(1, "x\ry"), (2, None)]
    assert [tuple(r) for r in formats.read_csv(spark, str(tmp_path / "b.csv"), null="-").collect()] == [(1, "x\ry"), (2, "")]


def test_a_late_value_widens_its_column(spark, tmp_path):
    lines = ["a,b,c,d,e"] + [f"{i},{i},2020-01-0{i % 9 + 1},{i},true" for i in range(2500)]
    path = tmp_path / "late.csv"
    path.write_text("\n".join([*lines, 'x,"two\nlines",2020-01-01 10:00:00,,false', "7,3.5,2021-02-03,2020-05-05,true"]) + "\n")
    df = formats.read_csv(spark, str(path))
    assert df.dtypes == [("a", "string"), ("b", "string"), ("c", "timestamp"), ("d", "date"), ("e", "boolean")]
    last = df.collect()[-2:]
    assert (last[0].a, last[0].b, last[1].b, str(last[1].d)) == ("x", "two\nlines", "3.5", "2020-05-05") and df.count() == 2502
    assert df.where("a is null or b is null or c is null").count() == 0
    with pytest.raises(Exception, match="column a: not int"):
        formats.read_csv(spark, str(path), sample=2000).collect()


def test_merged_types():
    assert [lattice.merged(b) for b in (0, 1, 64, 65, 67, 2, 3, 4, 5, 8, 9, 10, 16, 25, 48, 32)] == ["string", "int", "bigint", "bigint", "double", "double", "double", "boolean", "string", "date", "date", "string", "timestamp", "timestamp", "string", "string"]


def test_fastq_and_fasta_over_cuts(spark, tmp_path, small_blocks):
    reads = [(f"r{i}", "ACGTN"[: i % 5 + 1], "@I+>!"[: i % 5 + 1]) for i in range(60)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in reads) + "\n\n")
    (tmp_path / "a.fa").write_text(";old comment\n" + "".join(f">{n} a>b\n{s}\n\n{s}\n" for n, s, _ in reads))
    for size in (150, 4000):
        small_blocks(size)
        got = formats.read_fastq(spark, str(tmp_path / "a.fq")).collect()
        assert sorted((r.id, r.seq, "".join(chr(q + 33) for q in r.qual)) for r in got) == sorted(reads)
        assert sorted((r.id, r.description, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == sorted((n, "a>b", s + s) for n, s, _ in reads)
    (tmp_path / "bad.fq").write_text("@r\nAC\n+\nI\n")
    with pytest.raises(Exception, match="four lines"):
        formats.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_many_tasks_read_one_file(spark, tmp_path, small_blocks):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("k,t\n" + "".join(f'{i},"line\n{i}"\n' for i in range(50_000)))
    small_blocks(80_000)
    assert records.blocks(spark, str(tmp_path / "big.csv")).rdd.getNumPartitions() >= 10
    df = formats.read_csv(spark, str(tmp_path / "big.csv"))
    assert df.count() == 50_000 and df.where("t <> concat('line\\n', k)").count() == 0
