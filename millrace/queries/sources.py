"""Queries of sources, indexes and alignments: tables written in a format and read back, searched or stacked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import prefix
from ..operators import alignments, sequences
from ..operators.index import RangeIndex, SortedRelation
from ..sources import formats
from ..storage import shared_dir
from .registry import Sources, query


def _place(t: Sources, kind: str) -> str:
    return f"{shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("src_csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(t: Sources) -> DataFrame:
    """Whole texts, with their blanks, newlines and quotes, as CSV and back; types of the others come from the values.

    Spark's writer quotes nulls like texts, so they are written as a name made for this run, which no text is.
    """
    path, null = _place(t, "csv"), uuid.uuid4().hex
    t["documents"].write.options(**formats.CSV, nullValue=null).csv(path)
    read = formats.read_csv(t.spark, path, null=null, texts=("text", "lang", "source"))
    return read.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


@query(
    "src_csv_widening",
    """SELECT o_orderkey AS k, (CASE WHEN o_orderkey % 1000 = 7 THEN o_orderkey + 0.5 ELSE o_orderkey END)::DOUBLE AS number,
       CASE WHEN o_orderkey % 1000 = 7 THEN 'x' ELSE o_custkey::VARCHAR END AS mixed, (o_orderdate::DATE)::VARCHAR AS day FROM orders""",
)
def _(t: Sources) -> DataFrame:
    """A few late values turn a column of whole numbers into reals, or into texts, and none is lost."""
    path, late = _place(t, "csv"), F.col("o_orderkey") % 1000 == 7
    number = F.when(late, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))).otherwise(F.col("o_orderkey").cast("string"))
    mixed = F.when(late, "x").otherwise(F.col("o_custkey").cast("string"))
    t["orders"].select(F.col("o_orderkey").alias("k"), number.alias("number"), mixed.alias("mixed"), F.to_date("o_orderdate").alias("day")).write.option("header", "true").csv(path)
    read = formats.read_csv(t.spark, path)
    assert [k for _, k in read.dtypes][1:] == ["double", "string", "date"]
    return read.select(F.col("k").cast("bigint").alias("k"), "number", "mixed", F.col("day").cast("string").alias("day"))


def _reads(t: Sources) -> DataFrame:
    return t["part"].select(F.col("p_partkey").cast("string").alias("id"), F.translate(F.upper("p_name"), "BDEFHIJKLMNOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTACG").alias("seq"))


_READS = "SELECT p_partkey::VARCHAR AS id, translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACG') AS seq FROM part"


@query("src_fastq_round_trip", f"SELECT id, seq, list_sum([(i * 7) % 41 FOR i IN range(len(seq))])::BIGINT AS quality FROM ({_READS})")
def _(t: Sources) -> DataFrame:
    path = _place(t, "fastq")
    quals = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: i * 7 % 41)
    formats.write_lines(formats.fastq_lines(_reads(t).withColumn("qual", quals)), path)
    read = formats.read_fastq(t.spark, path)
    return read.select("id", "seq", F.aggregate("qual", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("quality"))


@query("src_fasta_round_trip", f"SELECT id, seq FROM ({_READS})")
def _(t: Sources) -> DataFrame:
    path = _place(t, "fasta")
    formats.write_lines(formats.fasta_lines(_reads(t), 7), path)
    return formats.read_fasta(t.spark, path).select("id", "seq")


@query("idx_range_search", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey <= 120 AND l_partkey + l_suppkey >= 100 AND l_linestatus = 'O'")
def _(t: Sources) -> DataFrame:
    """Lines as ranges from part to part + supplier, written as an index; those of one status that overlap 100..120."""
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", "l_linestatus", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_suppkey")).alias("e"))
    index = RangeIndex.build(rows, _place(t, "ranges"), ["l_linestatus"], "s", "e")
    return index.search(100, 120, "O").select("l_orderkey", "l_linenumber")


@query("idx_sorted_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 200 OFFSET 1000")
def _(t: Sources) -> DataFrame:
    rel = SortedRelation.build(t["orders"].select("o_orderkey", "o_totalprice"), _place(t, "sorted"), ["o_totalprice", "o_orderkey"], reverse=True)
    return rel.rows(1000, 200)


@query("sum_running", "SELECT o_orderkey, coalesce(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders")
def _(t: Sources) -> DataFrame:
    """Sums before each order, over a few hot keys."""
    rows = t["orders"].select("o_orderkey", "o_orderstatus", "o_custkey")
    return prefix.running(rows, ["o_orderstatus"], [F.col("o_orderkey")], {"before": F.col("o_custkey")}, rows=20_000).select("o_orderkey", "before")


def _hits(t: Sources) -> DataFrame:
    """Lines as reads of three letters, those of some tax with one or two letters inserted after the second."""
    cell = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    inserted = F.when(F.col("l_tax") > 0.07, "gg").when(F.col("l_tax") > 0.06, "t").otherwise("")
    return t["lineitem"].select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("read"), F.col("l_returnflag").alias("sub"),
        (F.col("l_suppkey") % 900 + 1).alias("sub_start"), F.concat(cell, F.lit("A"), inserted, cell).alias("seq"),
    )


_HITS = """h AS (SELECT l_orderkey || '-' || l_linenumber AS read, l_returnflag AS sub, l_suppkey % 900 + 1 AS s, 'ACGT'[l_linenumber % 4 + 1] AS c, CASE WHEN l_tax > 0.07 THEN 'GG' WHEN l_tax > 0.06 THEN 'T' ELSE '' END AS i FROM lineitem),
       x AS (SELECT sub, s + 1 AS pos, max(len(i)) AS extra FROM h WHERE i <> '' GROUP BY ALL)"""


@query(
    "dom_stack",
    f"""WITH {_HITS}, p AS (SELECT sub, pos, sum(extra) OVER (PARTITION BY sub ORDER BY pos) AS upto FROM x),
       f AS (SELECT h.*, p.upto FROM h ASOF LEFT JOIN p ON p.sub = h.sub AND p.pos < h.s)
       SELECT read, (s + coalesce(upto, 0))::BIGINT AS "column", c || repeat('-', coalesce(y.extra, 0)::INT) || 'A' || i || repeat('-', (coalesce(x.extra, 0) - len(i))::INT) || c AS "row"
       FROM f LEFT JOIN x ON x.sub = f.sub AND x.pos = f.s + 1 LEFT JOIN x y ON y.sub = f.sub AND y.pos = f.s""",
)
def _(t: Sources) -> DataFrame:
    return alignments.stack(_hits(t), width=64).select("read", "column", "row")


@query(
    "dom_consensus_columns",
    f"""WITH {_HITS}, l AS (SELECT sub, s AS pos, 0 AS k, c AS b FROM h UNION ALL SELECT sub, s + 1, 0, 'A' FROM h UNION ALL SELECT sub, s + 2, 0, c FROM h UNION ALL SELECT sub, s + 1, j, i[j] FROM h, (SELECT unnest([1, 2]) AS j) WHERE j <= len(i)),
       n AS (SELECT sub, pos, k, b, count(*) AS n FROM l GROUP BY ALL), v AS (SELECT sub, pos, sum(n) AS cover FROM n WHERE k = 0 GROUP BY ALL),
       g AS (SELECT sub, pos, k, b, n FROM n UNION ALL SELECT sub, pos, k, '-', cover - sum(n) FROM n JOIN v USING (sub, pos) WHERE k > 0 GROUP BY sub, pos, k, cover)
       SELECT sub, pos::BIGINT AS pos, k, arg_max(b, n * 10 + CASE b WHEN '-' THEN 5 WHEN 'A' THEN 4 WHEN 'C' THEN 3 WHEN 'G' THEN 2 ELSE 1 END) AS base, max(n)::BIGINT AS n, any_value(cover)::BIGINT AS cover
       FROM g JOIN v USING (sub, pos) GROUP BY sub, pos, k""",
)
def _(t: Sources) -> DataFrame:
    return alignments.consensus_columns(_hits(t))


@query(
    "dom_seed_hits",
    f"""WITH r AS ({_READS}), s AS (SELECT id AS sub, seq FROM r WHERE id::INT % 50 = 0), a AS (SELECT id, i AS pos, seq[i : i + 8] AS kmer FROM (SELECT id, seq, unnest(range(1, len(seq) - 7)) AS i FROM r)),
       b AS (SELECT sub, i AS spos, seq[i : i + 8] AS kmer FROM (SELECT sub, seq, unnest(range(1, len(seq) - 7)) AS i FROM s))
       SELECT id, sub, (spos - pos)::INTEGER AS diagonal, count(*) AS hits FROM a JOIN b USING (kmer) GROUP BY ALL""",
)
def _(t: Sources) -> DataFrame:
    """All parts' names as reads against those of every fiftieth part as subjects (the subjects are the query set)."""
    reads = _reads(t)
    return alignments.seed_hits(reads, reads.where(F.col("id").cast("int") % 50 == 0), 9, hot=500).select("id", "sub", F.col("diagonal").cast("int").alias("diagonal"), "hits")


@query("dom_mask_positions", f"SELECT id, substr(seq, 1, 2) || repeat('N', greatest(least(len(seq), 5) - 2, 0)::INT) || substr(seq, 6) AS seq FROM ({_READS})")
def _(t: Sources) -> DataFrame:
    return alignments.mask(_reads(t), positions=[(3, 5)])


@query("dom_local_alignments")
def _(t: Sources) -> DataFrame:
    """Every part's name against the next part's, as letters; no SQL says this, a plain loop does in the tests."""
    reads = _reads(t)
    after = reads.select((F.col("id").cast("int") - 1).cast("string").alias("id"), F.col("seq").alias("subject"))
    pairs = reads.withColumnRenamed("seq", "query").join(after, "id")
    return alignments.local_alignments(pairs, min_length=4).select("id", "score", "s_start", "s_end", "q_start", "q_end", "matches", sequences.complexity(F.col("query")).alias("complexity"))
