import pytest
from pyspark.sql import functions as F

from millrace.operators import commands, numeric  # noqa: F401
from millrace.plans.pipeline import Pipeline
from millrace.table import PlanError, Table


def rows(table):
    return [tuple(r) for r in Table(table.df.orderBy("_row"), table.names).result().collect()]


def run(spark, df, stages, params=None, **sources):
    return rows(Pipeline(spark, {"t": df, **sources}).run(stages, "t", params))


def stage(op, **arg):
    return {"op": op, "arg": arg}


@pytest.fixture
def abc(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate("abc")], "i long, s string").coalesce(1)


def test_negate_is_per_value_before_or(spark, abc):
    assert len(run(spark, abc, [stage("filter", method="equals", col="s", values=["a", "b"], negate=True)])) == 3
    assert len(run(spark, abc, [stage("filter", method="equals", col="s", values=["a"], negate=True)])) == 2


def test_mixed_sort_order(spark):
    df = spark.createDataFrame([(0, "10"), (1, ""), (2, "b"), (3, None), (4, "B"), (5, "a")], "i long, s string").coalesce(1)
    order = [r[0] for r in run(spark, df, [stage("sort", formula="$s")])]
    assert order == [3, 0, 5, 2, 4, 1]  # null as "0", then 10, a, b = B by row, then empty text
    assert [r[0] for r in run(spark, df, [stage("sort", formula="$s", reverse=True)])] == order[::-1]


def test_glue_matches_first_pairs(spark):
    left = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, None)], "a long, k long").coalesce(1)
    right = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, None)], "b long, k long").coalesce(1)
    got = run(spark, left, [stage("glue", lhs={"formula": "$k"}, rhs={"tbl": "r", "formula": "$k"})], r=right)
    assert [(r[0], r[2]) for r in got] == [(0, 0), (1, None), (2, None), (3, 3), (None, 2)]


def test_glue_never_matches_numbers_with_text(spark):
    left, right = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([("1",)], "k string")
    assert len(run(spark, left, [stage("glue", lhs={}, rhs={"tbl": "r"})], r=right)) == 2


def test_slice_both_directions(spark):
    up = spark.createDataFrame([(i,) for i in range(6)], "x long").coalesce(1)
    cut = stage("slice", start={"method": "firstEquals", "col": 0, "value": 2}, end={"method": "lastEquals", "col": 0, "value": 4})
    assert run(spark, up, [cut]) == [(2,), (3,), (4,)]
    down = spark.createDataFrame([(i,) for i in range(5, -1, -1)], "x long").coalesce(1)
    cut = stage("slice", start={"method": "firstLessThan", "col": 0, "value": 4}, end={"method": "lastGreaterThan", "col": 0, "value": 1})
    assert run(spark, down, [cut]) == [(3,), (2,)]
    assert run(spark, up, [stage("slice", start={"method": "firstEquals", "col": 0, "value": 9})]) == []


def test_transpose_twice_is_the_same(spark):
    df = spark.createDataFrame([("r1", "1", "2"), ("r2", "3", "4")], "name string, a string, b string").coalesce(1)
    assert run(spark, df, [stage("transpose"), stage("transpose")]) == rows(Table.of(df))


def test_concat_page_and_constants(spark, abc):
    got = run(spark, abc, [stage("predefine", name="k", value=10), stage("load", tbl="t"), stage("appendcol", name="n", formula="$i+k")], {"start": 2, "cnt": 3})
    assert got == [(2, "c", 12), (0, "a", 10), (1, "b", 11)]


def test_rowlist_categories_and_setcell(spark, abc):
    assert run(spark, abc, [stage("filter", method="rowlist", value="0,2"), stage("setcell", row=1, col="s", value="z")]) == [(0, "a"), (2, "z")]
    p = Pipeline(spark, {"t": abc})
    p.run([stage("rowcategory", name="ab", method="equals", col="s", values=["a", "b"]), stage("colcategory", name="c", method="equals", value="c")], "t")
    assert sorted(r[0] for r in p.categories["ab"].collect()) == [0, 1] and p.categories["c"] == [1]


def test_downsampling_keeps_ends(spark):
    df = spark.createDataFrame([(i, (i * 7) % 10) for i in range(100)], "i long, v long").coalesce(1)
    got = run(spark, df, [], {"resolution": 7, "minmaxMainCol": "v"})
    assert got[0][0] == 0 and got[-1][0] == 99 and len(got) == 12
    assert len(run(spark, df, [], {"resolution": 100})) == 100
    assert len(run(spark, df, [], {"resolution": 7})) == 7


def test_unknown_and_undefined_operations(spark, abc):
    for op in ("nothing", "rlda", "geneOntology"):
        with pytest.raises(PlanError):
            run(spark, abc, [stage(op)])
    with pytest.raises(PlanError):
        run(spark, abc, [{"arg": {}}])
    assert len(run(spark, abc, [stage("collapserows")])) == 3


def test_add_missing_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (8,)], "x long").coalesce(1)
    xs = lambda **a: [r[0] for r in run(spark, df, [stage("addMissingRows", abscissa={"col": "x", **a})])]
    assert xs() == [1, 2, 3, 4, 7, 8]
    assert xs(dense=True) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert xs(dense=True, minValue=2, maxValue=10) == [2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_kaplan_meier(spark):
    data = [("2020-01-01", "2020-01-03", None), ("2020-01-01", None, "2020-01-04"), ("2020-01-01", "2020-01-06", None), ("2020-01-01", "2020-01-02", "2020-01-02"), ("2020-01-01", None, None)]
    df = spark.createDataFrame(data, "a string, f string, c string").coalesce(1)
    got = run(spark, df, [stage("kaplanmeier", initEvents=["a"], finEvents=["f"], cenEvents=["c"])])
    assert [(r[0], round(r[3], 6)) for r in got] == [(0, 1.0), (2, round(2 / 3, 6)), (5, 0.0)]


def test_fold_change(spark):
    df = spark.createDataFrame([(4.0, 2.0), (2.0, 4.0), (3.0, 3.0), (0.0, 0.0), (0.0, 5.0)], "a double, b double").coalesce(1)
    got = {(r[0], r[1]): r[2:] for r in run(spark, df, [stage("fold_change", col_1="a", col_2="b")])}
    assert [got[k][0] for k in ((4, 2), (2, 4), (3, 3), (0, 0), (0, 5))] == [2, -2, -1, 1, None] and got[(0, 5)][2]


def test_stat_test_and_beta(spark):
    assert commands.incomplete_beta(0.5, 2, 3) == pytest.approx(0.6875)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "a double, b double, c double, d double, e double, f double")
    got = run(spark, df, [stage("statTest", colSet1=["a", "b", "c"], colSet2=["d", "e", "f"])])[0]
    assert got[6] == pytest.approx(-3.674235) and got[7] == 4 and got[8] == pytest.approx(0.0213, abs=1e-4)


def test_calibration_modes(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double").coalesce(1)
    assert [r[1] for r in run(spark, df, [stage("dataCalib", normalize=1)])] == [0.25, 0.75]
    carried = run(spark, df, [stage("dataCalib", normalize=1, strict_reference=True)])
    assert carried[0][1] == pytest.approx(10 / 44)


def test_correlation_matrix_best_and_impute(spark):
    data = [(1.0, 2.0, 9.0), (2.0, 4.5, None), (None, 5.0, 3.0), (4.0, 7.0, 4.0)]
    df = spark.createDataFrame(data, "a double, b double, c double").coalesce(1)
    matrix = run(spark, df, [stage("pearsonCorr", output="matrix")])
    assert [r[0] for r in matrix] == ["a", "b", "c"] and [matrix[k][k + 1] for k in range(3)] == [1, 1, 1]

    def plain(x, y, impute=False):
        mx = sum(v for v in x if v is not None) / (len(x) if impute else sum(v is not None for v in x))
        my = sum(v for v in y if v is not None) / sum(v is not None for v in y)
        both = [(p - mx, q - my) for p, q in zip(x, y) if p is not None and q is not None]
        ab, aa, bb = (sum(f(p, q) for p, q in both) for f in (lambda p, q: p * q, lambda p, q: p * p, lambda p, q: q * q))
        return ab / (aa * bb) ** 0.5, ab / aa, my - ab / aa * mx

    cols = list(zip(*data))
    assert all(matrix[i][j + 1] == pytest.approx(plain(cols[i], cols[j])[0]) for i in range(3) for j in range(3) if i != j)
    best = run(spark, df, [stage("pearsonCorr", output="best")])
    assert {r[:2] for r in best} == {("b", "a"), ("c", "a"), ("c", "b")}
    assert [abs(r[2]) for r in best] == sorted((abs(r[2]) for r in best), reverse=True)
    one = run(spark, df, [stage("pearsonCorr", colSet1=["a"], colSet2=["b"], imputeZeroForEmptyCellColSet1=True)])[0]
    assert one[2:5] == pytest.approx(plain(cols[0], cols[1], True)) and one[5] == 3
    empty = run(spark, df.limit(0), [stage("pearsonCorr", output="matrix")])
    assert empty[0] == ("a", 1.0, 0.0, 0.0)


def test_correlation_of_rows_and_of_readings(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0, 4.0), ("q", 2.0, 4.0, 8.0), ("r", 3.0, 2.0, 0.0)], "n string, a double, b double, c double").coalesce(1)
    got = run(spark, df, [stage("pearsonCorr", doTranspose=True, output="matrix")])
    assert [r[0] for r in got] == ["p", "q", "r"] and got[0][2] == pytest.approx(1) and got[0][3] == pytest.approx(-1)
    cells = spark.createDataFrame([("1", "2 +/- 0.5"), ("3", "6 +/- 0.3"), ("2", "4"), (None, "9 +/- 1"), ("x", None)], "x string, y string").coalesce(1)
    got = run(spark, cells, [stage("pearsonCorr", colSet1=["x"], colSet2=["y"], cellHasStdev=True)])[0]
    my = (2 + 6 + 4 + 9) / 4
    slope = sum((x - 2) * (y - my) for x, y in ((1, 2), (3, 6), (2, 4))) / 2
    assert got[3] == pytest.approx(slope) and got[6] == pytest.approx(slope * 2 / (2 * 0.8)) and got[5] == 3


def test_calibration_by_category_and_turned(spark):
    data = [("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 50.0), ("a", None), (None, 3.0), (None, None)]
    df = spark.createDataFrame(data, "k string, v double").coalesce(1)
    got = run(spark, df, [stage("dataCalib", categoryCols=["k"])])
    assert [r[1] for r in got] == pytest.approx([1, 1, 1, 1, 1, 55 / 6, 55 / 6, 3, 3]) and got[7][0] is None
    strict = run(spark, df, [stage("dataCalib", categoryCols=["k"], strict_reference=True)])
    assert strict[7][1] == 3 and strict[0][1] == 1
    wide = spark.createDataFrame([("s", 1.0, 2.0), ("t", 5.0, 6.0), ("s", 3.0, 8.0)], "n string, a double, b double").coalesce(1)
    table = Pipeline(spark, {"t": wide}).run([stage("dataCalib", translate=1, redundencyWay=1)], "t")
    assert table.names == ("n", "s", "t") and rows(table) == [("a", 2.0, 5.0), ("b", 5.0, 6.0)]


def test_numeric_commands(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), f"n{i}") for i in range(9)], "a double, b double, s string").coalesce(1)
    assert run(spark, df, [stage("tree", colSet=["a", "b"], labelCol="s", method="single")])[0][0].count("n") == 9
    assert len(run(spark, df, [stage("heatmap", colSet=["a", "b"])])) == 9
    assert len(run(spark, df, [stage("som", colSet=["a", "b"], mapSize=3)])[0]) == 5
    assert len(run(spark, df, [stage("fourier", colSet=["a"])])) == 9
    assert len(run(spark, df, [stage("simulation", groupCol="s", col="b", cnt=20)])) == 20
    scores = run(spark, df, [stage("pca", colSet=["a", "b"])])
    assert abs(sum(r[3] for r in scores)) < 1e-9


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("partitions", ["4", "40"])
def test_row_numbers_are_dense_at_size(spark, aqe, partitions):
    from millrace.operators.resample import downsample

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
        for order in (None, ["event_id"]):
            t = Table.of(events, order).numbered()
            n, least, most, all_ = t.df.agg(F.count_distinct("_row"), F.min("_row"), F.max("_row"), F.count("*")).first()
            assert (n, least, most) == (all_, 0, all_ - 1)
        assert t.df.where(F.col("_row") != F.col(f"c{t.index('event_id')}") - events.agg(F.min("event_id")).first()[0]).count() == 0
        assert downsample(t, 50, None, None, "value").df.count() == 98
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("categories,heavy", [(100_000, 100_000), (1, 3), (1, 100)])
def test_rows_of_large_categories_are_not_shuffled(spark, monkeypatch, categories, heavy):
    from millrace.operators import commands

    monkeypatch.setattr(commands, "CATEGORIES", categories, raising=False)
    monkeypatch.setattr(commands, "HEAVY", heavy, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, "abc"[(i > 5) + (i > 7)], float(i) if i % 4 else None) for i in range(9)], "i long, c string, x double")
        out = commands.data_calib(Table.of(df), {"categoryCols": ["c"], "calibrationCols": ["x"]}).result()
        assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (categories == 1)
        assert sorted(map(tuple, out.select("i", "c", "x").collect())) == [(i, "aaaaaabbc"[i], [2.75, 1, 2, 3, 2.75, 5, 6, 7, None][i]) for i in range(9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
