"""Queries of the table pipeline and its commands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import columns_read, compile_formula
from ..operators import commands, numeric  # noqa: F401  (their commands register themselves)
from ..plans.objects import search_string
from ..plans.pipeline import Pipeline
from ..table import Table
from .registry import Sources, query


def run(t: Sources, source: str, stages: list, params: dict | None = None, order: list | None = None) -> DataFrame:
    params = {**(params or {}), **({"order": order} if order else {})}
    return Pipeline(t.spark, t).run(stages, source, params).result()


def stage(op: str, **arg: object) -> dict:
    return {"op": op, "arg": arg}


def register(name: str, sql: str, source: str, stages: list, params: dict | None = None, order: list | None = None) -> None:
    query(name, sql)(lambda t: run(t, source, stages, params, order))


FLAGSHIP = [
    stage("filter", method="range", col={"name": "l_quantity"}, value={"min": 10}),
    stage("appendcol", name="net", formula="$l_extendedprice*(1-$l_discount)"),
    stage("sort", formulas=["$l_partkey"], maxCountEach=3),
]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
register(
    "tqs_flagship",
    f"""SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 10
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(LINE)}) <= 3""",
    "lineitem", FLAGSHIP, order=LINE,
)
register("tqs_filter_range", "SELECT * FROM lineitem WHERE l_discount > 0.02 AND l_discount < 0.05", "lineitem", [stage("filter", method="range", col="l_discount", value={"min": 0.02, "max": 0.05, "exclusive": True})])
register("tqs_filter_regex", "SELECT * FROM part WHERE regexp_matches(p_type, 'e.*d', 'i')", "part", [stage("filter", method="regex", col="p_type", value="e.*d")])
register("tqs_filter_substring", "SELECT * FROM part WHERE contains(lower(p_name), 'ring')", "part", [stage("filter", method="substring", col="p_name", value="RING")])
register("tqs_filter_equals_values", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')", "orders", [stage("filter", method="equals", col="o_orderstatus", values=["F", "O"])])
register("tqs_filter_negate", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F') OR NOT (o_orderstatus = 'O')", "orders", [stage("filter", method="equals", col="o_orderstatus", values=["F", "O"], negate=True)])
register("tqs_filter_conjunction", "SELECT * FROM nation WHERE n_nationkey >= 2 AND n_regionkey >= 2", "nation", [stage("filter", method="range", cols=["n_nationkey", "n_regionkey"], value={"min": 2}, colConjunction=True)])
register("tqs_filter_formula", "SELECT * FROM orders WHERE o_totalprice / 2 > 100000 AND o_orderstatus <> 'P'", "orders", [stage("filter", formula="$o_totalprice/2 > 100000 && $o_orderstatus != 'P'")])
register("tqs_filter_rowlist", "SELECT n_nationkey, n_name, n_regionkey FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) IN (1, 4, 5, 6)", "nation", [stage("filter", method="rowlist", value="0,3-5")], order=["n_nationkey"])
register("tqs_search", "SELECT * FROM nation WHERE contains(n_name, '_1') OR contains(n_nationkey::VARCHAR, '_1') OR contains(n_regionkey::VARCHAR, '_1')", "nation", [], {"search": "_1"})
register("tqs_appendcol", "SELECT *, o_totalprice * 1.1 + 5 AS gross FROM orders", "orders", [stage("appendcol", name="gross", formula="$o_totalprice*1.1+5")])
register("tqs_definecol_format", "SELECT o_orderkey, o_custkey, o_orderstatus, printf('%.2f', o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority FROM orders", "orders", [stage("definecol", col="o_totalprice", formula="$o_totalprice", format="%.2f")])
register("tqs_insert_move_rename", "SELECT n_name AS name, n_regionkey, (n_nationkey * 2)::BIGINT AS twice, n_nationkey FROM nation", "nation", [stage("insertcol", col=0, name="twice", formula="$n_nationkey*2"), stage("movecol", col="n_name", to=0), stage("movecol", col="n_regionkey", to=1), stage("renamecol", col="n_name", to="name")])
register("tqs_hidecol_negate", "SELECT p_partkey, p_brand FROM part", "part", [stage("hidecol", cols=["p_partkey", "p_brand"], negate=True)])
register("tqs_hidecol_regex", "SELECT p_partkey, p_name, p_brand, p_type FROM part", "part", [stage("hidecol", col={"regex": "size|price"})])
register("tqs_predefine", "SELECT *, p_retailprice * 6 AS scaled FROM part", "part", [stage("predefine", name="k", formula="2*3"), stage("appendcol", name="scaled", formula="$p_retailprice*k")])
register("tqs_setcell", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'SEA' ELSE r_name END AS r_name FROM region", "region", [stage("setcell", row=2, col="r_name", value="SEA")], order=["r_regionkey"])
register("tqs_extract", "SELECT n_name FROM nation WHERE n_nationkey IN (0, 2, 3)", "nation", [stage("extract", rowSet="0,2-3", colSet=[1])], order=["n_nationkey"])
register("tqs_transpose_small", """SELECT 'r_name' AS r_regionkey, max(r_name) FILTER (WHERE r_regionkey = 0) AS "0", max(r_name) FILTER (WHERE r_regionkey = 1) AS "1", max(r_name) FILTER (WHERE r_regionkey = 2) AS "2", max(r_name) FILTER (WHERE r_regionkey = 3) AS "3", max(r_name) FILTER (WHERE r_regionkey = 4) AS "4" FROM region""", "region", [stage("transpose")], order=["r_regionkey"])
register(
    "tqs_sort_topk_each",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) <= 2",
    "lineitem", [stage("hidecol", cols=LINE, negate=True), stage("sort", formula="$l_suppkey", reverse=True, maxCountEach=2)], order=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
)
register("tqs_sort_page", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 5", "orders", [stage("sort", formula="$o_totalprice")], {"start": 5, "cnt": 20}, order=["o_orderkey"])
register("tqs_slice", "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200", "orders", [stage("slice", start={"method": "firstEquals", "col": "o_orderkey", "value": 100}, end={"method": "lastLessThan", "col": "o_orderkey", "value": 200})], order=["o_orderkey"])
register("tqs_concat_load", "SELECT * FROM nation UNION ALL SELECT * FROM nation", "nation", [stage("load", tbl="nation")])
register(
    "tqs_glue_full_outer",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_custkey) AS m FROM customer)
       SELECT o_orderkey, o_custkey, c_custkey, c_name FROM l FULL JOIN (SELECT * FROM r WHERE m = 1) r ON o_custkey IS NOT DISTINCT FROM c_custkey AND n = 1""",
    "orders",
    [stage("hidecol", cols=["o_orderkey", "o_custkey"], negate=True), stage("glue", lhs={"formula": "$o_custkey"}, rhs={"tbl": "customer", "order": ["c_custkey"], "formula": "$c_custkey", "hidecol": [2, 3, 4]})],
    order=["o_orderkey"],
)
register(
    "tqs_resolution_minmax",
    """WITH o AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events),
       b AS (SELECT *, least(floor((r - 1) * 48 / (n - 2)), 47) AS bin FROM o WHERE r BETWEEN 1 AND n - 2),
       x AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY value, r) AS lo, row_number() OVER (PARTITION BY bin ORDER BY value DESC, r) AS hi FROM b)
       SELECT event_id, ts, value FROM x WHERE lo = 1 OR hi = 1 UNION ALL SELECT event_id, ts, value FROM o WHERE r IN (0, n - 1)""",
    "events", [], {"cols": ["event_id", "ts", "value"], "resolution": 50, "minmaxMainCol": "value"}, order=["event_id"],
)
register("tqs_colfilter", "SELECT p_brand FROM part", "part", [stage("colfilter", method="regex", value="^brand#", rowConjunction=True)])


@query("tqs_rowcategory", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row FROM nation QUALIFY n_regionkey = 3")
def _(t: Sources) -> DataFrame:
    p = Pipeline(t.spark, t)
    p.run([stage("rowcategory", name="three", method="equals", col="n_regionkey", value=3)], "nation", {"order": ["n_nationkey"]})
    return p.categories["three"]


@query("sql_search_string", "SELECT * FROM nation WHERE (contains(lower(n_nationkey::VARCHAR), '1') OR contains(lower(n_name), '1') OR contains(lower(n_regionkey::VARCHAR), '1')) AND n_regionkey <> 2")
def _(t: Sources) -> DataFrame:
    return t["nation"].where(search_string("any has 1 and n_regionkey isnt 2", t["nation"].columns))


# commands

for _k, _agg in ((0, "arg_min(v, o)"), (1, "arg_max(v, o)"), (2, "string_agg(v, ',' ORDER BY o)")):
    _cells = ", ".join(f"coalesce((SELECT {_agg} FROM e WHERE e.u = k.u AND e.c = '{c}'), '-') AS {c}" for c in ("click", "purchase"))
    register(
        f"cmd_dictionary_pivot_{('first', 'last', 'list')[_k]}",
        f"""WITH e AS (SELECT user_id::VARCHAR AS u, event_type AS c, event_id::VARCHAR AS v, event_id AS o FROM events WHERE event_type IN ('click', 'purchase')),
            k AS (SELECT DISTINCT u FROM e) SELECT u AS user_id, {_cells} FROM k""",
        "events",
        [stage("filter", formula="$event_type == 'click' | 'purchase'"), stage("dictionaryTable", rowSet=["user_id"], colSet=["event_type"], valSet=["event_id"], option=_k, defaultMissing="-")],
        order=["event_id"],
    )

register(
    "cmd_trend_month_status",
    "SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "orders", [stage("data-trending", period=["o_orderdate"], periodAsDate=True, groupBy=["o_orderstatus"])],
)

@query("cmd_add_missing_rows_dense", """WITH p AS (SELECT DISTINCT floor(o_totalprice / 10)::BIGINT AS x FROM orders), q AS (SELECT x, lead(x) OVER (ORDER BY x) AS y FROM p)
       SELECT x AS price, 'old' AS kind FROM p UNION ALL SELECT unnest(range(x + 1, y, 1)), 'new' FROM q WHERE y - x > 1""")
def _(t: Sources) -> DataFrame:
    prices = t["orders"].select(F.floor(F.col("o_totalprice") / 10).cast("bigint").alias("price")).distinct().withColumn("kind", F.lit("old"))
    return commands.add_missing_rows(Table.of(prices, ["price"]), {"abscissa": {"col": "price", "dense": True, "maxGap": 1}, "add": [{"col": "kind", "value": "new"}]}).result()


@query(
    "cmd_collapse_rollup",
    """SELECT l_returnflag, l_linestatus, (CASE WHEN l_linestatus IS NULL THEN 1 ELSE 2 END)::INTEGER AS level, count(*) AS n, round(avg(l_quantity), 6) AS q_mean, round(stddev_pop(l_quantity), 6) AS q_sd
       FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""",
)
def _(t: Sources) -> DataFrame:
    out = commands.collapse_rollup(t["lineitem"], ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return out.select("l_returnflag", "l_linestatus", "level", "n", F.round("l_quantity_mean", 6).alias("q_mean"), F.round("l_quantity_sd", 6).alias("q_sd"))


register(
    "cmd_collapse_with_stat",
    """SELECT n_nationkey, n_name, n_regionkey, printf('%.5f', avg(n_nationkey) OVER w)[1:7] || '±' || printf('%.5f', stddev_pop(n_nationkey) OVER w) AS "n_nationkey 1" FROM nation WINDOW w AS (PARTITION BY n_regionkey)""",
    "nation", [stage("collapsewithstat", colSet=["n_regionkey"])],
)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(
    "cmd_pearson",
    """SELECT x, y, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 4) AS intercept, n FROM (
       SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, corr(l_extendedprice, l_quantity) AS r, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, count(*) AS n FROM lineitem
       UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_tax, l_quantity), regr_slope(l_tax, l_quantity), regr_intercept(l_tax, l_quantity), count(*) FROM lineitem)""",
)
def _(t: Sources) -> DataFrame:
    out = run(t, "lineitem", [stage("pearsonCorr", colSet1=["l_quantity"], colSet2=["l_extendedprice", "l_tax"])])
    return out.select("x", "y", F.round("r", 6).alias("r"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


_CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "cmd_pearson_matrix",
    "\nUNION ALL ".join(f"SELECT '{x}' AS \"column\", " + ", ".join(f"round(corr({x}, {y}), 6) AS {y}" for y in _CORRELATED) + " FROM lineitem" for x in _CORRELATED),
)
def _(t: Sources) -> DataFrame:
    return _rounded(run(t, "lineitem", [stage("pearsonCorr", colSet1=_CORRELATED, output="matrix")]))


@query(
    "cmd_pearson_best_imputed",
    """WITH e AS (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS sold, l_extendedprice, l_tax FROM lineitem),
       m AS (SELECT sum(sold) / count(*) AS ms, avg(l_extendedprice) AS me, avg(l_tax) AS mt FROM e),
       d AS (SELECT sold - ms AS s, l_extendedprice - me AS e, l_tax - mt AS t, ms, me, mt FROM e, m WHERE sold IS NOT NULL)
       SELECT 'sold' AS x, 'l_extendedprice' AS y, round(sum(s * e) / sqrt(sum(s * s) * sum(e * e)), 6) AS r, round(sum(s * e) / sum(s * s), 6) AS slope, round(any_value(me) - sum(s * e) / sum(s * s) * any_value(ms), 4) AS intercept, count(*) AS n FROM d
       UNION ALL SELECT 'sold', 'l_tax', round(sum(s * t) / sqrt(sum(s * s) * sum(t * t)), 6), round(sum(s * t) / sum(s * s), 6), round(any_value(mt) - sum(s * t) / sum(s * s) * any_value(ms), 4), count(*) FROM d""",
)
def _(t: Sources) -> DataFrame:
    sold = t["lineitem"].select("l_extendedprice", "l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("sold"))
    out = commands.pearson(Table.of(sold), {"colSet1": ["sold"], "colSet2": ["l_extendedprice", "l_tax"], "imputeZeroForEmptyCellColSet1": True, "output": "best"}).result()
    return out.select("x", "y", F.round("r", 6).alias("r"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


register(
    "cmd_fold_change",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, CASE WHEN l_quantity = 0 AND l_tax = 0 THEN 1.0 WHEN l_quantity = 0 OR l_tax = 0 THEN NULL WHEN l_quantity > l_tax THEN l_quantity / l_tax ELSE -l_tax / l_quantity END AS fold_change,
       l_quantity <> 0 AND l_tax = 0 AS unique_1, l_quantity = 0 AND l_tax <> 0 AS unique_2 FROM lineitem""",
    "lineitem", [stage("hidecol", cols=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"], negate=True), stage("fold_change", col_1="l_quantity", col_2="l_tax", threshold=0)],
)


@query(
    "cmd_variance",
    """WITH d AS (SELECT p_partkey, p_retailprice - p_size AS difference FROM part) SELECT p_partkey, round(difference, 6) AS difference, round(difference / (SELECT avg(abs(difference)) FROM d), 6) AS relative FROM d""",
)
def _(t: Sources) -> DataFrame:
    return _rounded(run(t, "part", [stage("variance", colSetA=["p_retailprice"], colSetB=["p_size"]), stage("hidecol", cols=["p_partkey", "difference", "relative"], negate=True)]))


@query(
    "cmd_bstat",
    """WITH m AS (SELECT avg(l_quantity) * 1.1 AS c FROM lineitem), h AS (SELECT l_returnflag AS value, count(*) FILTER (WHERE l_quantity >= c) AS k FROM lineitem, m GROUP BY 1)
       SELECT 'l_returnflag' AS category, value, 'l_quantity' AS "column", round(k / sum(k) OVER (), 6) AS probability FROM h""",
)
def _(t: Sources) -> DataFrame:
    return _rounded(run(t, "lineitem", [stage("bStat", categories=["l_returnflag"], colSet=["l_quantity"], margin=0.1)]))


register("cmd_cleaner", "SELECT n_name, n_nationkey, n_regionkey FROM nation", "nation", [stage("appendcol", name="flat", formula="7"), stage("cleaner", categories=["n_regionkey"], colSet=["flat", "n_nationkey"])])


@query(
    "cmd_stat_t_values",
    """WITH g AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS a, embedding[9:16]::DOUBLE[] AS b FROM embeddings)
       SELECT vec_id, round((list_avg(a) - list_avg(b)) / sqrt(list_var_samp(a) / 8 + list_var_samp(b) / 8), 6) AS statistic, 14.0::DOUBLE AS degrees FROM g""",
)
def _(t: Sources) -> DataFrame:
    wide = t["embeddings"].select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(16)])
    out = commands.stat_test(Table.of(wide), {"colSet1": [f"e{i}" for i in range(8)], "colSet2": [f"e{i}" for i in range(8, 16)]}).result()
    return out.select("vec_id", F.round("statistic", 6).alias("statistic"), "degrees")


@query(
    "cmd_kaplanmeier",
    """WITH r AS (SELECT datediff('day', DATE '1992-01-01', o_orderdate::DATE) % 40 AS duration, o_orderstatus = 'F' AS event FROM orders),
       b AS (SELECT duration, count(*) FILTER (WHERE event) AS events, count(*) AS leaving FROM r GROUP BY 1),
       a AS (SELECT *, (SELECT count(*) FROM r) - coalesce(sum(leaving) OVER (ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM b)
       SELECT duration::BIGINT AS duration, at_risk::BIGINT AS at_risk, events::BIGINT AS events, round(product((at_risk - events) / at_risk) OVER (ORDER BY duration), 6) AS survival FROM a WHERE events > 0
       UNION ALL SELECT 0, count(*), 0, 1.0 FROM r""",
)
def _(t: Sources) -> DataFrame:
    rows = t["orders"].select((F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) % 40).cast("bigint").alias("duration"), (F.col("o_orderstatus") == "F").alias("event"))
    return _rounded(commands.survival_steps(rows))


@query("cmd_calibrate_share", "SELECT r_regionkey, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT n_regionkey AS r_regionkey, count(*)::DOUBLE AS n FROM nation GROUP BY 1)")
def _(t: Sources) -> DataFrame:
    by = t["nation"].groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").cast("double").alias("n")).withColumn("share", F.col("n"))
    return _rounded(commands.data_calib(Table.of(by), {"normalize": 1, "normalizeCols": ["share"]}).result())


@query(
    "cmd_calibrate_category",
    """WITH c AS (SELECT l_returnflag, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l_returnflag, round(CASE WHEN l_quantity IS NULL OR abs(l_quantity - mq) > 2 * sq THEN mq ELSE l_quantity END, 6) AS l_quantity,
       round(CASE WHEN l_extendedprice IS NULL OR abs(l_extendedprice - me) > 2 * se THEN me ELSE l_extendedprice END, 6) AS l_extendedprice FROM lineitem JOIN c USING (l_returnflag)""",
)
def _(t: Sources) -> DataFrame:
    keep = stage("hidecol", cols=["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"], negate=True)
    return _rounded(run(t, "lineitem", [keep, stage("dataCalib", categoryCols=["l_returnflag"], calibrationCols=["l_quantity", "l_extendedprice"])]))


@query("cmd_generic", "SELECT n_nationkey, n_name, n_regionkey, (n_nationkey + n_regionkey)::DOUBLE AS \"Sum\" FROM nation")
def _(t: Sources) -> DataFrame:
    return run(t, "nation", [stage("generic-cmd-test", cols=["n_nationkey", "n_name", "n_regionkey"])])


@query("cmd_pca")
def _(t: Sources) -> DataFrame:
    wide = t["embeddings"].select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(6)])
    return numeric.pca(Table.of(wide), {"colSet": {"regex": "^e"}, "components": 3}).result()


@query("cmd_tree")
def _(t: Sources) -> DataFrame:
    wide = t["nation"].select("n_name", "n_nationkey", "n_regionkey")
    return numeric.tree(Table.of(wide, ["n_nationkey"]), {"colSet": ["n_nationkey", "n_regionkey"], "labelCol": "n_name"}).result()


@query("cmd_kmeans")
def _(t: Sources) -> DataFrame:
    return numeric.clusters(t["embeddings"], "vec_id", "embedding", 4).select("vec_id", "cluster")


@query(
    "stat_describe",
    """SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, max(l_quantity) - min(l_quantity) AS range, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1""",
)
def _(t: Sources) -> DataFrame:
    return _rounded(numeric.describe(t["lineitem"], ["l_returnflag"], "l_quantity").drop("mode"))


@query(
    "stat_diversity",
    """WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS w FROM events GROUP BY ALL)
       SELECT user_id, round(sum(w * w) / (sum(w) * sum(w)), 6) AS simpson, round(ln(sum(w)) - sum(w * ln(w)) / sum(w), 6) AS shannon, count(*) AS richness FROM c GROUP BY 1""",
)
def _(t: Sources) -> DataFrame:
    return _rounded(numeric.diversity(t["events"], ["user_id"], "event_type").select("user_id", "simpson", "shannon", "richness"))


_D = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) ** 2)))",
    "manhattan": "list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))",
    "maximum": "list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))",
    "canberra": "list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN abs(a[i]) + abs(b[i]) > 0 THEN abs(a[i] - b[i]) / (abs(a[i]) + abs(b[i])) ELSE 0 END))",
    "cosine": "1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))",
}


@query("stat_distances", f"""SELECT vec_id, {", ".join(f"round({x}, 5) AS {n}" for n, x in _D.items())} FROM (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)""")
def _(t: Sources) -> DataFrame:
    e = t["embeddings"]
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", *[F.round(numeric.distance(F.col("a"), F.col("b"), n), 5).alias(n) for n in _D])


# expressions


def formulas(name: str, source: str, keep: list[str], made: dict[str, str], sql: str, missing: bool = False) -> None:
    """Columns made by formulas; with ``missing``, what is made from a missing cell is missing, while the language counts it as 0."""

    def cell(f: str, table: Table) -> Column:
        value = compile_formula(f, table).col
        known = [table.col(table.index(c)).isNotNull() for c in columns_read(f)] if missing else []
        return F.when(reduce(Column.__and__, known), value) if known else value

    def go(t: Sources) -> DataFrame:
        table = Table.of(t[source])
        return table.df.select(*[table.col(table.index(k)).alias(k) for k in keep], *[cell(f, table).alias(n) for n, f in made.items()])

    query(name, sql)(go)


formulas("qlang_arithmetic", "lineitem", ["l_orderkey", "l_linenumber"], {"a": "$l_linenumber/2", "b": "$l_linenumber % 3", "c": "-$l_quantity + 1", "d": "$l_linenumber/($l_linenumber-1)"}, "SELECT l_orderkey, l_linenumber, (l_linenumber // 2)::DOUBLE AS a, (l_linenumber % 3)::BIGINT AS b, 1 - l_quantity AS c, CASE WHEN l_linenumber = 1 THEN 'inf'::DOUBLE ELSE (l_linenumber // (l_linenumber - 1))::DOUBLE END AS d FROM lineitem", missing=True)
formulas("qlang_nullish", "events", ["event_id"], {"a": "null == 0", "b": "$event_type == null", "c": "$value == null", "d": '"no" ? 1 : 0', "e": '$event_type == "click" | "purchase"'}, "SELECT event_id, true AS a, coalesce(event_type, '') = '' AS b, coalesce(value, 0) = 0 AS c, 1::BIGINT AS d, event_type IN ('click', 'purchase') AS e FROM events")
formulas("qlang_strings", "part", ["p_partkey"], {"a": "$p_name[0:3]", "b": '$p_brand =~ /#([0-9])/', "c": 'cat($p_brand, "-", $p_size)', "d": '$p_type.split(" ").dim()', "e": '$p_type.split(" ").join("_")'}, "SELECT p_partkey, p_name[1:4] AS a, CASE WHEN regexp_matches(p_brand, '#([0-9])') THEN [regexp_extract(p_brand, '#([0-9])', 0), regexp_extract(p_brand, '#([0-9])', 1)] ELSE []::VARCHAR[] END AS b, p_brand || '-' || p_size AS c, len(string_split(p_type, ' '))::BIGINT AS d, replace(p_type, ' ', '_') AS e FROM part")
formulas("qlang_list_functions", "part", ["p_partkey"], {"a": "range(0,$p_size).map(function(x){return x*x;}).sum()", "b": "[$p_size, 3, 20].max()", "c": "[$p_size,1,2,1].union([2,9]).dim()", "d": "[5,1,$p_size].sort()[0]", "e": "range(1,5).filter(function(x){return x>2;})"}, "SELECT p_partkey, (p_size - 1) * p_size * (2 * p_size - 1) / 6::DOUBLE AS a, greatest(p_size, 3, 20)::DOUBLE AS b, len(list_distinct([p_size, 1, 2, 9]))::BIGINT AS c, least(5, 1, p_size)::BIGINT AS d, [3::BIGINT, 4::BIGINT] AS e FROM part")
formulas("qlang_histogram", "part", ["p_partkey"], {"h": "range(0,$p_size+1).histogram(2)"}, "SELECT p_partkey, [len(list_filter(range(0, p_size + 1), lambda x: x < p_size / 2))::BIGINT, len(list_filter(range(0, p_size + 1), lambda x: x >= p_size / 2))::BIGINT] AS h FROM part WHERE p_size > 0 UNION ALL SELECT p_partkey, [1::BIGINT, 0::BIGINT] FROM part WHERE p_size = 0")
formulas("qlang_dates", "orders", ["o_orderkey"], {"a": '$o_orderdate.strftime("%Y/%m/%d")', "b": 'strptime("2020-01-31", "%Y-%m-%d") as date', "c": 'strptime("x", "%Y").isnull()'}, "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS a, DATE '2020-01-31' AS b, true AS c FROM orders")
formulas("qlang_counts", "part", ["p_partkey"], {"k": '$p_type.split(" ").counts().keys()', "n": '$p_type.split("").counts().dim()'}, "SELECT p_partkey, list_sort(list_distinct(string_split(p_type, ' '))) AS k, len(list_distinct(string_split(p_type, '')))::BIGINT AS n FROM part")
