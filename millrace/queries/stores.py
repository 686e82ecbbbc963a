"""Queries of the object catalog, the relation language, domain tables, ranges, sources and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotations, clustering, graph, keyed, ranges, sequences
from ..plans import procedures
from ..plans.objects import Catalog, object_search, permission_sum
from ..plans.relations import Traversal
from ..streaming import events
from .registry import Sources, query


def catalog(t: Sources) -> Catalog:
    """Customers, nations and regions as typed objects."""
    c, n, r = t["customer"], t["nation"], t["region"]
    ident = lambda kind, col: F.concat(F.lit(f"{kind}."), F.col(col).cast("string"))
    objects = c.select(ident("customer", "c_custkey").alias("obj_id"), F.concat(F.lit("customer-"), F.lower("c_mktsegment")).alias("type"))
    objects = objects.unionAll(n.select(ident("nation", "n_nationkey"), F.lit("nation"))).unionAll(r.select(ident("region", "r_regionkey"), F.lit("region")))
    field = lambda df, i, name, v: df.select(i.alias("obj_id"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("grp"), v.cast("string").alias("value"))
    fields = field(c, ident("customer", "c_custkey"), "name", F.col("c_name"))
    for df, i, name, v in (
        (c, ident("customer", "c_custkey"), "segment", F.col("c_mktsegment")),
        (c, ident("customer", "c_custkey"), "nation", ident("nation", "c_nationkey")),
        (n, ident("nation", "n_nationkey"), "name", F.col("n_name")),
        (n, ident("nation", "n_nationkey"), "region", ident("region", "n_regionkey")),
        (r, ident("region", "r_regionkey"), "name", F.col("r_name")),
    ):
        fields = fields.unionAll(field(df, i, name, v))
    kinds = objects.select("type").distinct().select(F.col("type").alias("name"), F.when(F.startswith("type", F.lit("customer-")), F.lit("customer, party")).otherwise(F.lit("")).alias("parent"))
    types = kinds.unionAll(t.spark.createDataFrame([("customer", "base"), ("party", ""), ("base", "")], "name string, parent string"))
    return Catalog(objects, fields, types)


@query("obj_alloftype_filter", "SELECT 'customer.' || c_custkey AS obj_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(c_name, '7$')")
def _(t: Sources) -> DataFrame:
    return catalog(t).alloftype("customer", {"segment": ["BUILDING", "MACHINERY"], "name": {"method": "regex", "value": "7$"}})


@query("obj_type_inheritance", "SELECT count(*) AS n FROM customer")
def _(t: Sources) -> DataFrame:
    return catalog(t).alloftype("ba?e").agg(F.count("*").alias("n"))


@query(
    "obj_csv_page",
    """SELECT 'customer.' || c_custkey AS obj_id, c_name AS name, n_name AS "nation.name" FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' ORDER BY obj_id DESC LIMIT 15 OFFSET 3""",
)
def _(t: Sources) -> DataFrame:
    k = catalog(t)
    return k.csv(k.alloftype("customer", {"segment": "^BUILDING$"}), ["name", "nation.name"], 3, 15)


@query("obj_allusedby_recursive", "SELECT 'nation.' || c_nationkey AS obj_id, 1 AS depth FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'region.' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
def _(t: Sources) -> DataFrame:
    ids = t["customer"].where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("obj_id"))
    return catalog(t).allusedby(ids, ["nation", "region"])


@query("obj_allthatuse", "SELECT 'nation.' || n_nationkey AS obj_id, 1 AS depth FROM nation WHERE n_regionkey = 2")
def _(t: Sources) -> DataFrame:
    return catalog(t).allthatuse(t.spark.createDataFrame([("region.2",)], "obj_id string"), ["nation", "region"])


@query("obj_props", "SELECT 'nation.' || n_nationkey AS obj_id, 'name=' || n_name || ';region=region.' || n_regionkey AS props FROM nation")
def _(t: Sources) -> DataFrame:
    k = catalog(t)
    return k.props(k.alloftype("nation")).select("obj_id", F.array_join(F.transform(F.map_entries("props"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("props"))


@query("obj_objs2_page", "SELECT 'customer.' || c_custkey AS obj_id, c_mktsegment AS segment FROM customer WHERE starts_with(c_name, 'Customer#0000000') ORDER BY obj_id DESC LIMIT 20 OFFSET 5")
def _(t: Sources) -> DataFrame:
    return catalog(t).objs2("customer", "name", "Customer#0000000+", ["segment"], 5, 20)


@query("obj_objoftype", "SELECT 'nation.' || n_nationkey AS obj_id FROM nation WHERE n_regionkey = 2")
def _(t: Sources) -> DataFrame:
    k = catalog(t)
    used = k.allthatuse(t.spark.createDataFrame([("region.2",)], "obj_id string"), ["nation", "region"], None)
    return k.objoftype(used.select("obj_id"), "nation")


def relations(t: Sources) -> Traversal:
    tree = t["nation"].select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    tree = tree.unionAll(t["region"].select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit("root")))
    spans = t["events"].select("event_id", "user_id", (F.col("event_id") * 3 % 1000).alias("pos_start"), (F.col("event_id") * 3 % 1000 + F.col("event_id") % 9).alias("pos_end"))
    return Traversal(t.spark, {"nation": t["nation"], "region": t["region"], "customer": t["customer"], "orders": t["orders"], "tree": tree, "span": spans})


@query("ion_find_chain", "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")
def _(t: Sources) -> DataFrame:
    out = relations(t).run("a=find.region(r_name='ASIA'); b=find.nation(n_regionkey==a.r_regionkey); c=find.customer(c_nationkey==b.n_nationkey); printCSV(a.r_name, b.n_name, c.c_custkey);")
    return out.toDF("r_name", "n_name", "c_custkey")


@query("ion_search_regex", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_2[0-3]')")
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=search.nation(n_name='regex:_2[0-3]'); printCSV(a.n_name);").toDF("n_name")


@query("ion_unique", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=foreach.customer(''); unique.u(a.c_mktsegment, a.c_nationkey); printCSV(a.c_mktsegment, a.c_nationkey);").toDF("c_mktsegment", "c_nationkey")


@query("ion_sum", "SELECT n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(t: Sources) -> DataFrame:
    out = relations(t).run("a=foreach.nation(''); b=find.customer(c_nationkey==a.n_nationkey); sum.s(a.n_name, b.c_acctbal); printCSV(a.n_name, s.sum);")
    return out.toDF("n_name", "total").select("n_name", F.round("total", 2).alias("total"))


@query("ion_dict", "SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS names FROM nation GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=foreach.nation(''); dict.d(a.n_regionkey, a.n_name); printCSV(a.n_regionkey, d.values);").toDF("n_regionkey", "names")


@query("ion_count", "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=foreach.nation(''); b=count.customer(c_nationkey==a.n_nationkey); printCSV(a.n_name, b.#);").toDF("n_name", "customers")


@query("ion_jump_parent", "SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)")
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=find.tree(id==$start); jump!.a(a.parent, 'root'); printCSV(a.id, a.parent);", {"start": "n7"}).toDF("id", "parent")


@query("ion_range_find", "SELECT event_id FROM events WHERE event_id * 3 % 1000 <= 120 AND event_id * 3 % 1000 + event_id % 9 >= 100")
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=find.span(#range=possort, pos=100:120); printCSV(a.event_id);").toDF("event_id")


# ranges, coverage, counts


@query(
    "dom_range_join",
    """WITH e AS (SELECT event_id, user_id, event_id * 3 % 1000 AS s, event_id * 3 % 1000 + event_id % 9 AS e FROM events)
       SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s <= b.e AND b.s <= a.e""",
)
def _(t: Sources) -> DataFrame:
    e = t["events"].select("event_id", "user_id", (F.col("event_id") * 3 % 1000).alias("s"), (F.col("event_id") * 3 % 1000 + F.col("event_id") % 9).alias("e"))
    right = e.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return ranges.range_join(e.withColumnRenamed("event_id", "a"), right, ["user_id"], ("s", "e"), ("s2", "e2"), 10).where("a < b").select("a", "b")


@query(
    "dom_contigs_gaps",
    """WITH p AS (SELECT DISTINCT user_id, event_id // 50 AS pos FROM events), m AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
       r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM m), g AS (SELECT user_id, run, min(pos) AS run_start, max(pos) AS run_end, count(*) AS n FROM r GROUP BY ALL)
       SELECT user_id, run_start, run_end, n, run_start - lag(run_end) OVER (PARTITION BY user_id ORDER BY run_start) - 1 AS gap_before FROM g""",
)
def _(t: Sources) -> DataFrame:
    p = t["events"].select("user_id", F.floor(F.col("event_id") / 50).alias("pos")).distinct()
    return ranges.islands(p, ["user_id"], "pos", 2)


@query(
    "dom_rpkm_matrix",
    """WITH h AS (SELECT l_suppkey % 10 AS sub, l_returnflag AS exp FROM lineitem), t AS (SELECT exp, count(*) AS n FROM h GROUP BY 1), c AS (SELECT sub, exp, count(*) AS k FROM h GROUP BY ALL)
       SELECT sub, round(max(k * 1e9 / ((sub + 1) * 100 * n)) FILTER (WHERE exp = 'A'), 4) AS "A", round(max(k * 1e9 / ((sub + 1) * 100 * n)) FILTER (WHERE exp = 'N'), 4) AS "N", round(max(k * 1e9 / ((sub + 1) * 100 * n)) FILTER (WHERE exp = 'R'), 4) AS "R" FROM c JOIN t USING (exp) GROUP BY 1""",
)
def _(t: Sources) -> DataFrame:
    hits = t["lineitem"].select((F.col("l_suppkey") % 10).alias("sub"), F.col("l_returnflag").alias("exp"))
    lengths = t.spark.range(10).select(F.col("id").alias("sub"), ((F.col("id") + 1) * 100).alias("length"))
    return sequences.expression_matrix(hits, lengths, "sub", "exp").select("sub", *[F.round(c, 4).alias(c) for c in "ANR"])


@query(
    "dom_hit_counts",
    """WITH h AS (SELECT DISTINCT l_orderkey AS read, l_suppkey % 10 AS sub FROM lineitem), u AS (SELECT read, count(*) AS n FROM h GROUP BY 1), t AS (SELECT count(DISTINCT read) AS n FROM h)
       SELECT sub::VARCHAR AS sub, count(*) AS hits, count(*) FILTER (WHERE u.n = 1) AS hits_unique, round(count(*) * 100.0 / (SELECT n FROM t), 6) AS pct FROM h JOIN u USING (read) GROUP BY sub UNION ALL SELECT '+', n, NULL, NULL FROM t""",
)
def _(t: Sources) -> DataFrame:
    hits = t["lineitem"].select(F.col("l_orderkey").alias("read"), (F.col("l_suppkey") % 10).alias("sub"))
    subjects = t.spark.range(10).select(F.col("id").alias("sub"), F.lit(100).alias("length"))
    return sequences.hit_counts(hits, subjects).select("sub", "hits", "hits_unique", F.round("pct", 6).alias("pct"))


def _reads(t: Sources) -> DataFrame:
    return t["part"].select(F.col("p_partkey").alias("id"), F.translate(F.upper("p_name"), "BDEFHIJKLMNOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTACG").alias("seq"))


_READS = "SELECT p_partkey AS id, translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACG') AS seq FROM part"


@query("dom_read_lengths", f"SELECT len(seq)::INTEGER AS length, count(*) AS reads FROM ({_READS}) GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return sequences.length_histogram(_reads(t))


@query("dom_base_counts", f"SELECT b AS base, sum(len(seq) - len(replace(seq, b, '')))::BIGINT AS n FROM ({_READS}), (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS b) GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return sequences.base_counts(_reads(t))


@query("dom_position_counts", f"SELECT (i - 1)::INTEGER AS pos, seq[i] AS base, count(*) AS n FROM (SELECT seq, unnest(range(1, len(seq) + 1)) AS i FROM ({_READS})) GROUP BY ALL")
def _(t: Sources) -> DataFrame:
    return sequences.position_stats(_reads(t))


@query("dom_kmers", f"SELECT kmer, count(*) AS n FROM (SELECT seq[i : i + 4] AS kmer FROM (SELECT seq, unnest(range(1, len(seq) - 3)) AS i FROM ({_READS}))) GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return sequences.kmers(_reads(t), 5).groupBy("kmer").agg(F.count("*").alias("n"))


@query("dom_codon_usage", f"SELECT codon, count(*) AS n FROM (SELECT seq[i * 3 + 1 : i * 3 + 3] AS codon FROM (SELECT seq, unnest(range(0, len(seq) // 3)) AS i FROM ({_READS}))) GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return sequences.codon_usage(_reads(t)).select("codon", "n")


def _pileup(t: Sources) -> DataFrame:
    """Lines as aligned reads over a subject for each return flag."""
    cell = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    hits = t["lineitem"].select(F.col("l_returnflag").alias("sub"), (F.col("l_suppkey") % 40 + 1).alias("sub_start"), F.when(F.col("l_tax") > 0.04, "+").otherwise("-").alias("strand"), F.concat(cell, F.lit("A"), cell).alias("seq"))
    return sequences.pileup(hits)


_PILE = """p AS (SELECT l_returnflag AS sub, l_suppkey % 40 + 1 + i AS pos, CASE WHEN i = 1 THEN 'A' ELSE 'ACGT'[l_linenumber % 4 + 1] END AS b, l_tax > 0.04 AS f FROM lineitem, (SELECT unnest([0, 1, 2]) AS i)),
       c AS (SELECT sub, pos, count(*) FILTER (WHERE b = 'A') AS count_a, count(*) FILTER (WHERE b = 'C') AS count_c, count(*) FILTER (WHERE b = 'G') AS count_g, count(*) FILTER (WHERE b = 'T') AS count_t, count(*) AS count_total, count(*) FILTER (WHERE f) AS forward FROM p GROUP BY ALL)"""


@query("dom_pileup", f"WITH {_PILE} SELECT sub, pos::BIGINT AS pos, count_a, count_c, count_g, count_t, count_total, forward FROM c")
def _(t: Sources) -> DataFrame:
    return _pileup(t).select("sub", "pos", "count_a", "count_c", "count_g", "count_t", "count_total", "forward")


@query(
    "dom_snp_calls",
    f"""WITH {_PILE}, u AS (SELECT sub, pos, count_total, unnest([{{'b': 'C', 'n': count_c}}, {{'b': 'G', 'n': count_g}}, {{'b': 'T', 'n': count_t}}]) AS x FROM c)
       SELECT sub, pos::BIGINT AS pos, x.b AS snp, round(x.n / count_total, 6) AS frequency FROM u WHERE x.n / count_total >= 0.25""",
)
def _(t: Sources) -> DataFrame:
    profile = _pileup(t)
    return sequences.snp_calls(profile, profile.select("sub", "pos", F.lit("A").alias("ref")), 0.25).select("sub", "pos", "snp", F.round("frequency", 6).alias("frequency"))


@query(
    "dom_entropy",
    f"""WITH {_PILE}, u AS (SELECT sub, pos, count_total AS n, unnest([count_a, count_c, count_g, count_t]) AS k FROM c)
       SELECT sub, pos::BIGINT AS pos, round(CASE WHEN any_value(n) > 1 THEN -sum(CASE WHEN k > 0 THEN k / n * log10(k / n) ELSE 0 END) / log10(any_value(n)) ELSE 0 END, 6) AS entropy FROM u GROUP BY sub, pos""",
)
def _(t: Sources) -> DataFrame:
    counts = [F.col(f"count_{b}") for b in "acgt"]
    return _pileup(t).select("sub", "pos", F.round(sequences.entropy10(counts), 6).alias("entropy"))


@query("tax_common_parent", "SELECT c_mktsegment, 'top' AS common_parent FROM customer GROUP BY 1")
def _(t: Sources) -> DataFrame:
    tree = t["nation"].select((F.col("n_nationkey") + 100).alias("id"), (F.col("n_regionkey") + 10).alias("parent")).unionAll(t["region"].select(F.col("r_regionkey") + 10, F.lit(1)))
    tree = tree.unionAll(t.spark.range(1).select(F.lit(1), F.lit(1)))
    closure = graph.ancestors(tree, "id", "parent")
    members = t["customer"].select("c_mktsegment", (F.col("c_nationkey") + 100).alias("node"))
    found = graph.common_parent(closure, members, "c_mktsegment", "node")
    return found.select("c_mktsegment", F.when(F.col("common_parent") == 1, "top").otherwise(F.col("common_parent").cast("string")).alias("common_parent"))


@query(
    "tax_roll_up",
    """SELECT r_regionkey + 10 AS ancestor, count(*) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1
       UNION ALL SELECT c_nationkey + 100, count(*) FROM customer GROUP BY 1 UNION ALL SELECT 1, count(*) FROM customer""",
)
def _(t: Sources) -> DataFrame:
    tree = t["nation"].select((F.col("n_nationkey") + 100).alias("id"), (F.col("n_regionkey") + 10).alias("parent")).unionAll(t["region"].select(F.col("r_regionkey") + 10, F.lit(1)))
    tree = tree.unionAll(t.spark.range(1).select(F.lit(1), F.lit(1)))
    counts = t["customer"].groupBy((F.col("c_nationkey") + 100).alias("node")).agg(F.count("*").alias("n"))
    return graph.roll_up(graph.ancestors(tree, "id", "parent"), counts, "node", "n").select("ancestor", "total")


# procedures


@query("sql_capacity", "SELECT o_orderstatus, ceil(sum(CASE WHEN o_totalprice > 100000 THEN o_totalprice END) / 1e6)::BIGINT AS millions FROM orders GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return procedures.capacity(t["orders"], "o_orderstatus", {"millions": (F.col("o_totalprice"), F.col("o_totalprice") > 100000)}, 1e6)


@query("sql_objects_by_time", "SELECT o_orderkey FROM orders WHERE o_orderdate > '1995-01-01' AND o_orderdate <= '1995-02-01'")
def _(t: Sources) -> DataFrame:
    return procedures.by_time(t["orders"], "o_orderdate", datetime(1995, 1, 1), datetime(1995, 2, 1)).select("o_orderkey")


@query("sql_permission_semijoin", "SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t: Sources) -> DataFrame:
    nations, orders = t["nation"].where("n_regionkey = 1"), t["orders"].where("o_orderstatus = 'P'")
    c = t["customer"]
    return c.join(orders, c["c_custkey"] == orders["o_custkey"], "left_semi").join(nations, c["c_nationkey"] == nations["n_nationkey"], "left_semi").select("c_custkey").distinct()


@query("sql_permission_mask", "SELECT c_nationkey, bit_or(c_custkey & 6)::BIGINT AS mask FROM customer GROUP BY 1")
def _(t: Sources) -> DataFrame:
    return t["customer"].groupBy("c_nationkey").agg(F.bit_or(F.col("c_custkey").bitwiseAND(6)).alias("mask"))


@query("sql_queue_position", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS ahead FROM orders")
def _(t: Sources) -> DataFrame:
    return procedures.queue_position(t["orders"].select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ahead")


# events


@query("stream_trend_hour", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t: Sources) -> DataFrame:
    out = events.trend(t["events"].withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_dense_day",
    """WITH e AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM e)
       SELECT b.d AS start, t.event_type, coalesce(n, 0)::BIGINT AS n FROM b CROSS JOIN (SELECT DISTINCT event_type FROM e) t LEFT JOIN e ON e.d = b.d AND e.event_type = t.event_type""",
)
def _(t: Sources) -> DataFrame:
    out = events.dense(t["events"].withColumn("ts", F.col("ts").cast("timestamp")), "day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.col("n").cast("bigint").alias("n"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(t: Sources) -> DataFrame:
    out = events.sessions(t["events"].withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("tqs_ionwander", "SELECT n_name AS b_n_name FROM nation WHERE n_regionkey = 2")
def _(t: Sources) -> DataFrame:
    from ..plans.pipeline import Pipeline

    stages = [{"op": "ionwander", "arg": {"qry": "a=find.region(r_regionkey==$id); b=find.nation(n_regionkey==a.r_regionkey); printCSV(b.n_name);", "qryParams": {"id": 2}}}]
    return Pipeline(t.spark, t).run(stages).result()


@query(
    "dom_load_profile",
    f"""WITH {_PILE}, p2 AS (SELECT pos::BIGINT AS pos FROM c WHERE sub = 'R' AND pos NOT BETWEEN 10 AND 20)
       SELECT 'R' AS sub, pos, true AS known FROM p2 UNION ALL SELECT 'R', x, NULL FROM (SELECT unnest([10, 20])::BIGINT AS x) WHERE EXISTS (SELECT 1 FROM p2 WHERE pos > 20) AND EXISTS (SELECT 1 FROM p2 WHERE pos < 10)""",
)
def _(t: Sources) -> DataFrame:
    from ..operators import commands  # noqa: F401
    from ..plans.pipeline import Pipeline

    profile = _pileup(t).where("not (sub = 'R' and pos between 10 and 20)").select("sub", "pos", F.lit(True).alias("known"))
    return Pipeline(t.spark, {"p": profile}).run([{"op": "load-SNPprofile", "arg": {"tbl": "p", "sub": "R"}}]).result()


@query(
    "dom_codon_table",
    "SELECT codon, n FROM (SELECT sum(p_size)::BIGINT AS \"AAA\", sum(p_partkey % 7)::BIGINT AS \"ACG\" FROM part) UNPIVOT (n FOR codon IN (\"AAA\", \"ACG\"))",
)
def _(t: Sources) -> DataFrame:
    usage = t["part"].select(F.col("p_partkey").alias("taxid"), F.col("p_size").cast("bigint").alias("AAA"), (F.col("p_partkey") % 7).alias("ACG"))
    out = annotations.codon_table(usage, t["part"].select(F.col("p_partkey").alias("taxid")))
    return out


@query("dom_saturation", "WITH f AS (SELECT user_id AS pos, min(event_id) AS r FROM events GROUP BY 1), e AS (SELECT min(event_id) AS a, max(event_id) + 1 AS b FROM events), s AS (SELECT floor((r - a) * 20 / (b - a))::BIGINT AS step, count(*) AS new FROM f, e GROUP BY 1) SELECT step, (sum(new) OVER (ORDER BY step))::BIGINT AS positions FROM s")
def _(t: Sources) -> DataFrame:
    return annotations.saturation(t["events"].select(F.col("user_id").alias("pos"), F.col("event_id").alias("read")), 20)


@query("dom_annotation_types", "SELECT p_brand AS type, count(*) AS n, count(DISTINCT p_type) AS ids FROM part WHERE regexp_matches(p_brand, 'brand#1', 'i') GROUP BY 1")
def _(t: Sources) -> DataFrame:
    a = t["part"].select(F.lit("s").alias("sub"), F.col("p_partkey").alias("start"), F.col("p_partkey").alias("end"), F.col("p_type").alias("id"), F.col("p_brand").alias("type"))
    return annotations.id_types(annotations.search(a, "brand#1", ("type",)))


@query("sql_log_read", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND value >= 5 ORDER BY event_id DESC")
def _(t: Sources) -> DataFrame:
    return procedures.log_read(t["events"], "event_id", "value", 5, {"event_type": ["error", "signup"]}).select("event_id", "event_type")


@query("sql_group_progress", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) GROUP BY 1")
def _(t: Sources) -> DataFrame:
    found = procedures.group_progress(t["orders"], t["customer"].where("c_nationkey = 5"), ("o_custkey", "c_custkey"), "o_orderstatus", ["o_totalprice"])
    return found.select("o_orderstatus", "n", F.round("o_totalprice", 2).alias("amount"))


@query("sql_usage_by_path", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE starts_with(c_name, 'Customer#0000001') OR c_name = 'Customer#000000007' GROUP BY 1")
def _(t: Sources) -> DataFrame:
    found = procedures.usage_by_path(t["customer"], "c_name", ["Customer#0000001*", "Customer#000000007"], "c_mktsegment", ["c_acctbal"])
    return found.select("c_mktsegment", "n", F.round("c_acctbal", 2).alias("total"))


@query("sql_free_page", "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 5")
def _(t: Sources) -> DataFrame:
    text = "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_ JOIN customer_ ON c_custkey = o_custkey WHERE o_orderstatus = :status GROUP BY 1 ORDER BY 1"
    return procedures.sql_page(t.spark, {"orders_": t["orders"], "customer_": t["customer"]}, text, 5, 10, {"status": "F"})


# searches, key joins, stretches without cover


@query(
    "sql_object_search",
    """WITH o AS (SELECT o_orderkey AS obj_id, o_custkey, o_orderdate AS soft, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 365 DAY END AS hard FROM orders),
       f AS (SELECT obj_id FROM o JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND soft <= TIMESTAMP '1995-06-17' AND (hard IS NULL OR hard > TIMESTAMP '1995-06-17'))
       SELECT obj_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY obj_id DESC LIMIT 50 OFFSET 3""",
)
def _(t: Sources) -> DataFrame:
    hard = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 365 days"))
    objects_ = t["orders"].select(F.col("o_orderkey").alias("obj_id"), F.col("o_orderdate").alias("soft_expiration"), hard.alias("hard_expiration"))
    at = F.lit("1995-06-17").cast("timestamp_ntz")
    return object_search(objects_, _permissions(t), _groups(t), expired=1, start=3, cnt=50, total=True, now=at).select("obj_id", F.col("total").cast("bigint").alias("total"))


def _permissions(t: Sources) -> DataFrame:
    """Orders are seen by their customer's nation."""
    o, c = t["orders"], t["customer"]
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("group_id"), F.col("o_orderkey").alias("obj_id"), F.col("o_custkey").alias("bits"))


def _groups(t: Sources) -> DataFrame:
    return t["nation"].where("n_regionkey = 1").select(F.col("n_nationkey").alias("group_id"))


@query("sql_permission_sum", "SELECT c_custkey AS obj_id, sum(o_orderkey & 6)::BIGINT AS perm FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def _(t: Sources) -> DataFrame:
    rows = _permissions(t).select("group_id", F.col("bits").alias("obj_id"), F.col("obj_id").alias("bits"))
    return permission_sum(rows, _groups(t), 6)


@query(
    "sql_key_join",
    """WITH o AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
       SELECT c_custkey, c_name, k AS o_orderkey, o_orderstatus FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN orders ON o_orderkey = k""",
)
def _(t: Sources) -> DataFrame:
    orders = t["orders"].select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return keyed.key_join(t["customer"].select("c_custkey", "c_name"), [orders], "c_custkey")


@query(
    "ion_range_find_bound",
    """WITH s AS (SELECT event_id, user_id, event_id * 3 % 1000 AS s, event_id * 3 % 1000 + event_id % 9 AS e FROM events)
       SELECT a.event_id AS a, b.event_id AS b FROM s a JOIN s b ON a.user_id = b.user_id AND b.s <= a.e AND b.e >= a.s AND b.event_id > a.event_id""",
)
def _(t: Sources) -> DataFrame:
    return relations(t).run("a=foreach.span(''); b=find.span(#range=possort, user_id==a.user_id, pos=a.pos_start:a.pos_end, event_id>a.event_id); printCSV(a.event_id, b.event_id);").toDF("a", "b")


@query("ion_ddict", "SELECT c_nationkey, c_mktsegment, list_sort(list(DISTINCT c_custkey)) AS customers FROM customer GROUP BY 1, 2")
def _(t: Sources) -> DataFrame:
    out = relations(t).run("a=foreach.customer(''); ddict.d(a.c_nationkey, a.c_mktsegment, a.c_custkey); printCSV(a.c_nationkey, d.values);").toDF("c_nationkey", "values")
    return out.select("c_nationkey", F.explode("values").alias("c_mktsegment", "customers"))


_COVER = """p AS (SELECT o_orderstatus AS sub, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT + 1 AS pos, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT sub, max(pos) AS length FROM p GROUP BY 1),
       z AS (SELECT x.sub, x.pos - 1 AS i, coalesce(n, 0) AS n FROM (SELECT sub, unnest(range(1, length + 1)) AS pos FROM l) x LEFT JOIN p ON p.sub = x.sub AND p.pos = x.pos),
       s AS (SELECT *, sum(n) OVER (PARTITION BY sub ORDER BY i ROWS 29 PRECEDING) > 60 AS st FROM z), m AS (SELECT *, CASE WHEN i = 0 OR (i >= 30 AND st <> lag(st) OVER (PARTITION BY sub ORDER BY i)) THEN 1 ELSE 0 END AS b FROM s),
       r AS (SELECT *, sum(b) OVER (PARTITION BY sub ORDER BY i) AS run FROM m), g AS (SELECT sub, min(i) + 1 AS run_start, max(i) + 1 AS run_end, count(*) AS length, sum(n)::BIGINT AS cover FROM r GROUP BY sub, run),
       w AS (SELECT *, cover > greatest(length, 30) * 2 AS covered, length >= 10 AS counted FROM g)"""


def _cover(t: Sources) -> tuple[DataFrame, DataFrame]:
    """Orders a day as a profile for each status, and its length."""
    pos = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) + 1).cast("bigint")
    profile = t["orders"].groupBy(F.col("o_orderstatus").alias("sub"), pos.alias("pos")).agg(F.count("*").alias("count_total"))
    return profile, profile.groupBy("sub").agg(F.max("pos").alias("length"))


@query("dom_gap_windows", f"WITH {_COVER} SELECT sub, run_start, run_end, length, cover, covered, CASE WHEN covered THEN greatest(cover // length, 1) ELSE cover // length END AS mean_cover, counted FROM w")
def _(t: Sources) -> DataFrame:
    return sequences.gap_windows(*_cover(t), threshold=2)


@query(
    "dom_gap_summary",
    f"""WITH {_COVER} SELECT sub, count(*) FILTER (WHERE counted AND covered) AS contigs, count(*) FILTER (WHERE counted AND NOT covered) AS gaps, coalesce(sum(length) FILTER (WHERE counted AND covered), 0)::BIGINT AS contig_length,
       round(coalesce(sum(length) FILTER (WHERE counted AND covered), 0) * 100.0 / any_value(l.length), 6) AS contig_pct FROM (SELECT sub, w.length, covered, counted FROM w) w JOIN l USING (sub) GROUP BY sub""".replace("sum(length)", "sum(w.length)"),
)
def _(t: Sources) -> DataFrame:
    profile, lengths = _cover(t)
    out = sequences.gap_summary(sequences.gap_windows(profile, lengths, threshold=2), lengths)
    return out.select("sub", "contigs", "gaps", "contig_length", F.round("contig_pct", 6).alias("contig_pct"))


_AMINO = "'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[16 * (strpos('TCAG', {0}[1]) - 1) + 4 * (strpos('TCAG', {0}[2]) - 1) + strpos('TCAG', {0}[3])]"


@query(
    "dom_codon_effect",
    f"""WITH r AS (SELECT id, seq, id % 2 = 1 AS back, id % 9 + 1 AS pos, 'ACGT'[id % 4 + 1] AS snp FROM ({_READS}) WHERE regexp_full_match(seq[1:9], '[ACGT]{{9}}')),
       c AS (SELECT *, CASE WHEN back THEN reverse(translate(seq[1:9], 'ACGT', 'TGCA')) ELSE seq[1:9] END AS cds, CASE WHEN back THEN 9 - pos ELSE pos - 1 END AS k, CASE WHEN back THEN translate(snp, 'ACGT', 'TGCA') ELSE snp END AS x FROM r),
       d AS (SELECT *, cds[k // 3 * 3 + 1 : k // 3 * 3 + 3] AS old FROM c), e AS (SELECT *, old[1 : k % 3] || x || old[k % 3 + 2 : 3] AS new FROM d)
       SELECT id, pos::BIGINT AS pos, (k // 3 + 1)::BIGINT AS aa_pos, {_AMINO.format("old")} AS aa_ref, {_AMINO.format("new")} AS aa_sub FROM e""",
)
def _(t: Sources) -> DataFrame:
    head = F.substr("seq", F.lit(1), F.lit(9))
    reads = _reads(t).where(F.rlike(head, F.lit("^[ACGT]{9}$")))
    back = F.col("id") % 2 == 1
    letter = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.col("id") % 4 + 1).cast("int"))
    calls = reads.select(F.col("id").alias("sub"), (F.col("id") % 9 + 1).alias("pos"), letter.alias("snp"))
    frames = reads.select(F.col("id").alias("sub"), "id", F.when(back, "-").otherwise("+").alias("strand"), F.lit(1).alias("start"), F.lit(9).alias("end"), F.when(back, sequences.revcomp(head)).otherwise(head).alias("cds"))
    return sequences.codon_effect(calls, frames).select("id", "pos", F.col("aa_pos").cast("bigint").alias("aa_pos"), "aa_ref", "aa_sub")


@query("qlang_json", """SELECT p_partkey, '["' || p_brand || '","' || p_type || '"]' AS j, p_type AS second FROM part""")
def _(t: Sources) -> DataFrame:
    from ..plans.pipeline import Pipeline

    stages = [{"op": "appendcol", "arg": {"name": "j", "formula": "jsonprint([$p_brand, $p_type])"}}, {"op": "appendcol", "arg": {"name": "second", "formula": "jsonlist($j)[1]"}}]
    return Pipeline(t.spark, {"part": t["part"].select("p_partkey", "p_brand", "p_type")}).run(stages, "part").result().select("p_partkey", "j", "second")


def _trade(t: Sources) -> DataFrame:
    """Parts (even ids) and suppliers (odd ids), joined by the least price of their lines."""
    ends = t["lineitem"].select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"), F.col("l_extendedprice").alias("weight"))
    return ends.groupBy("u", "v").agg(F.min("weight").alias("weight"))


@query("dom_spanning_forest")
def _(t: Sources) -> DataFrame:
    return clustering.spanning_forest(_trade(t))


@query(
    "dom_single_linkage",
    """WITH RECURSIVE e AS (SELECT l_partkey * 2 AS u, l_suppkey * 2 + 1 AS v FROM lineitem GROUP BY ALL HAVING min(l_extendedprice) <= 2000),
       b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
       reach(id, node) AS (SELECT DISTINCT u, u FROM b UNION SELECT r.id, b.v FROM reach r JOIN b ON b.u = r.node),
       n AS (SELECT l_partkey * 2 AS id FROM lineitem UNION SELECT l_suppkey * 2 + 1 FROM lineitem)
       SELECT n.id, coalesce(min(r.node), n.id) AS cluster FROM n LEFT JOIN reach r ON r.id = n.id GROUP BY n.id""",
)
def _(t: Sources) -> DataFrame:
    edges = _trade(t)
    nodes = t["lineitem"].select(F.explode(F.array(F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1)).alias("id"))
    return clustering.cut(nodes, clustering.spanning_forest(edges, 2000.0), 2000.0)
