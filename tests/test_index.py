import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.index import RangeIndex, SortedRelation, _counts
from millrace.plans.relations import Traversal
from millrace.table import PlanError


@pytest.fixture(scope="module")
def ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["chr1", "chr1", "chr2", None]), s, s + (rnd.randrange(200_000) if i % 97 == 0 else rnd.randrange(30)), i) for i, s in enumerate(rnd.randrange(100_000) for _ in range(4000))]
    return rows + [("chr1", 10, 5, -1), ("chr1", None, 5, -2), ("chr2", 7, None, -3)]


def test_range_index_reads_few_files(spark, ranges, tmp_path):
    df = spark.createDataFrame(ranges, "seq string, pos_start long, pos_end long, id long")
    index = RangeIndex.build(df, str(tmp_path / "v"), ["seq"], "pos_start", "pos_end", rows=100)
    total = spark.read.parquet(str(tmp_path / "v/files")).count()
    assert total > 30
    for low, high, key in ((500, 500, "chr1"), (500, 900, "chr2"), (99_990, 10**6, None), (-5, -1, "chr1"), (40_000, 40_010, "none")):
        want = {r[3] for r in ranges if r[1] is not None and r[2] is not None and r[1] <= r[2] and r[1] <= high and r[2] >= low and (key is None or r[0] == key)}
        assert {r.id for r in index.search(low, high, key).collect()} == want
        files = index.files(low, high, key)
        assert len(files) < total * (0.75 if key is None else 0.4)
        assert len(index.search(low, high, key).inputFiles()) == max(1 if not files else 0, len(files)) or not files
    s, e = ranges[0][1], ranges[0][2]
    assert {r.id for r in index.search(s, e, exact=True).collect()} == {r[3] for r in ranges if (r[1], r[2]) == (s, e)}
    got = Traversal(spark, {"annot": index}).run("a = find.annot(pos=500:900, seq=='chr2'); printCSV(a.id);")
    assert {r[0] for r in got.collect()} == {r.id for r in index.search(500, 900, "chr2").collect()}
    assert index.table().count() == len(ranges)


@pytest.mark.parametrize(("reverse", "numeric"), [(False, False), (True, False), (False, True), (True, True)])
def test_sorted_relation(spark, tmp_path, reverse, numeric):
    rnd = random.Random(1)
    rows = [(str(rnd.randrange(500)), i) for i in range(1000)] + [(None, 1000), ("x9", 1001)]
    rel = SortedRelation.build(spark.createDataFrame(rows, "k string, i long"), str(tmp_path / "s"), ["k", "i"], reverse, numeric, rows=90)
    key = (lambda k: None if k in (None, "x9") else float(k)) if numeric else (lambda k: k)
    order = sorted(rows, key=lambda r: (key(r[0]) is not None, key(r[0]) or (0 if numeric else ""), r[1]), reverse=reverse)
    if not numeric:
        assert [tuple(r) for r in rel.rows().collect()] == order
        assert [tuple(r) for r in rel.rows(333, 5).collect()] == order[333:338]
    else:
        assert [key(r.k) for r in rel.rows().collect()] == [key(k) for k, _ in order]
    assert len(rel.rows(333, 5).inputFiles()) <= 2
    assert sorted(r.i for r in rel.find("17").collect()) == sorted(i for k, i in rows if k == "17")
    assert len(rel.find("17").inputFiles()) <= 3
    assert {r.i for r in rel.find(None).collect()} == {i for k, i in rows if key(k) is None}
    got = Traversal(spark, {"r": rel}).run("a = find.r(k=='17'); printCSV(a.i);")
    assert got.count() == sum(k == "17" for k, _ in rows)


def test_inequalities_alone_are_refused(spark):
    df = spark.range(5).select(F.col("id").alias("x"))
    with pytest.raises(PlanError, match="inequalities"):
        Traversal(spark, {"r": df, "s": df}).run("a = foreach.r(''); b = find.s(x<a.x); printCSV(a.x, b.x);")


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_files_are_told_apart_without_sorting_rows(spark, tmp_path, kind):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(1, 30)]), s, s + rnd.randrange(9), i) for i, s in enumerate(rnd.randrange(1000) for _ in range(900))]
    df = spark.createDataFrame(rows, "k long, s long, e long, id long").withColumn("k", F.col("k").cast(kind))
    index = RangeIndex.build(df, str(tmp_path / "v"), ["k"], "s", "e", rows=50)
    written = spark.read.parquet(str(tmp_path / "v/rows"))
    assert "SortAggregate" not in _counts(written, "k", [F.min("s").alias("_start")])._jdf.queryExecution().toString()
    about = written.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_n"), F.min("k").alias("_low"), F.max("k").alias("_high"), F.min("s").alias("_start"), F.max("e").alias("_end"))
    cols = ["_file", "_n", "_low", "_high", "_start", "_end"]
    assert sorted(map(tuple, about.select(cols).collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "v/files")).select(cols).collect()))
    for key in (5, 12.0, "12.0" if kind == "double" else "12"):  # as the comparison with the column takes it
        assert {r.id for r in index.search(100, 700, key).collect()} == {r[3] for r in rows if r[0] == float(key) and r[1] <= 700 and r[2] >= 100}
    for reverse in (False, True):
        SortedRelation.build(df, str(tmp_path / f"s{reverse}"), ["k", "id"], reverse, rows=50)
        about = spark.read.parquet(str(tmp_path / f"s{reverse}/rows")).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.min("_k0").alias("_low"), F.max("_k0").alias("_high"), F.count_if(F.col("_k0").isNull()).alias("_nulls"))
        assert sorted(map(repr, about.collect())) == sorted(map(repr, spark.read.parquet(str(tmp_path / f"s{reverse}/files")).select("_file", "_low", "_high", "_nulls").collect()))
