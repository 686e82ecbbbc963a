"""Line dedup by a log-template tree, in DataFrame functions alone.

A line's path in the tree has a fixed depth: its token count, then its LEAD leading tokens, in which a variable field
(a token with a digit or an @) is a placeholder.  In a leaf, tokens are ranked by how many of its lines have them at
their place; variable fields are never constants, and of the other tokens a line gives up its rarest ones, one after
the other, up to one in SPARE of its tokens.  Each step is a template: the tokens still kept, at their places.  So fields
of words ("Posted in category <*> by the editor") become variable as fields of digits do.  A template keeps half of its
tokens at least: rows of numbers have none.  A line's own wording is a template too, whatever it holds.

A template is recurring when it stands in at least ``min_docs`` different texts.  Exact copies are one text, and all
texts of which more than NEAR is lines shared by ``min_docs`` texts count as one together, so whole copies and near
copies do not make their lines recurring, while notices, footers, headings and other lines strewn over documents do.
Lines with a recurring template are dropped; blank lines never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from . import base

LEAD, MIN_DOCS = 2, 5
#: A line may give up one in SPARE of its tokens as variable fields, besides those with digits.
SPARE = 6
#: Share of a text in shared lines: two texts with it in common have Jaccard 0.75, where op1 calls them near copies.
NEAR = 6 / 7
#: Keys that are broadcast at most (8 bytes each); beyond, the join deals both sides by key, and AQE splits a hot one.
BROADCAST = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _plain(line: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(blank))
    return F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def _leaf(m: Column) -> Column:
    """The tree's leaf of a plain line."""
    lead = F.substring_index(m, " ", LEAD)
    lead = F.when(F.rlike(lead, F.lit("[0-9@]")), F.regexp_replace(lead, r"[^ ]*[0-9@][^ ]*", "<*>")).otherwise(lead)
    return F.xxhash64(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))), lead)


def paths_of(text: Column) -> Column:
    """array<struct<v, leaf, z>>, a line each: hash of the plain line, its leaf (both null for a blank line), its length."""
    plain = F.transform(lines_of(text), lambda x: F.struct(_plain(x).alias("m"), F.length(x).alias("z")))
    some = lambda x, c: F.when(x["m"] != "", c)
    return F.transform(plain, lambda x: F.struct(some(x, F.xxhash64(x["m"])).alias("v"), some(x, _leaf(x["m"])).alias("leaf"), x["z"].alias("z")))


def _among(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is one of ``found`` (one column, written)."""
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST else found, key, "left_semi")


def _templates(docs: DataFrame, texts: DataFrame, min_docs: int) -> DataFrame:
    """v, template: of the lines of ``texts`` (copy, l: paths), their templates beside their own wording."""
    lines = texts.select("copy", F.inline("l")).where(F.col("leaf").isNotNull())
    leaves = texts.select(F.explode(F.array_distinct(F.transform("l", lambda x: x["leaf"]))).alias("leaf")).where(F.col("leaf").isNotNull())
    busy = base.save(leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    times = _among(lines, busy, "leaf").groupBy("v").agg(F.count("*").alias("times"))
    wording = docs.select(F.explode(F.transform(lines_of(F.col("text")), _plain)).alias("m")).where("m <> ''")
    wording = _among(wording.withColumn("leaf", _leaf(F.col("m"))), busy, "leaf").withColumn("v", F.xxhash64("m")).dropDuplicates(["v"])
    forms = wording.join(times, "v").select("v", "leaf", "times", F.split("m", " ").alias("tok"))
    cells = forms.select("v", "times", "leaf", F.size("tok").alias("n"), F.posexplode("tok").alias("at", "token"))
    cells = cells.withColumn("fixed", ~F.rlike("token", F.lit("[0-9@]"))).withColumn("cell", F.xxhash64("leaf", "at", "token"))
    cells = base.save(cells.select("v", "leaf", "n", "times", "at", "cell", "fixed").where("fixed").drop("fixed"))
    often = cells.groupBy("cell").agg(F.sum("times").alias("c")).where(F.col("c") >= min_docs)
    digits = F.col("n") - F.col("words")
    words = cells.groupBy("v").agg(F.count("*").alias("words"))
    ranked = cells.join(often, "cell").join(words, "v")
    order = Window.partitionBy("v").orderBy(F.desc("c"), "at")  # a line's own tokens
    kept = ranked.select("v", "leaf", "n", digits.alias("digits"), F.row_number().over(order).alias("k"), F.bit_xor("cell").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    enough = (F.col("k") >= F.col("n") - F.col("digits") - F.floor(F.col("n") / SPARE)) & (2 * F.col("k") >= F.col("n"))
    return kept.where(enough).select("v", F.xxhash64("leaf", "k", "x").alias("template"))


def recurring(docs: DataFrame, rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """v (long): of the lines of ``rows`` (doc_id, copy: hash of the text, l: paths) those with a template in at least ``min_docs`` different texts."""
    texts = base.save(rows.where(F.col("doc_id").isNotNull()).select("copy", "l").dropDuplicates(["copy"]))
    made = _templates(docs, texts, min_docs)
    own = texts.select("copy", F.explode(F.array_distinct(F.transform("l", lambda x: x["v"]))).alias("v")).where(F.col("v").isNotNull())
    alone = base.save(own.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("v"))
    made = base.save(made.unionAll(alone.select("v", F.col("v").alias("template"))))
    pairs = base.save(own.join(made, "v").select("copy", "template").distinct())
    shared = base.save(pairs.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template"))
    wide = base.save(_among(made, shared, "template").select("v").distinct())
    held = _among(texts.select("copy", F.inline("l")), wide, "v").groupBy("copy").agg(F.sum("z").alias("held"))
    total = F.aggregate("l", F.lit(0).cast("bigint"), lambda acc, x: acc + x["z"])
    near = texts.select("copy", total.alias("total")).join(held, "copy").where(F.col("held") > NEAR * F.col("total")).select("copy", F.lit(1).alias("near"))
    counted = _among(pairs, shared, "template").join(near, "copy", "left").groupBy("template")
    n = F.count("*") - F.count("near") + F.coalesce(F.max("near"), F.lit(0))
    last = base.save(counted.agg(n.alias("n")).where(F.col("n") >= min_docs).select("template"))
    found = base.save(_among(made, last, "template").select("v").distinct())
    storage.drop(texts, alone, made, pairs, shared, wide, last)
    return found


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_removed, kept_text and the columns ``carry`` for each row of ``docs``.

    Lines end at \\n; what is kept is joined by \\n in order.  A null text is one empty line.  Rows with a null doc_id
    count for no template, but lose their recurring lines.  Ties and repeated rows: copies count once; tokens equally
    often at their places are given up from the last.  An empty table gives no rows.
    """
    docs, text = docs.select("doc_id", "text", *carry), F.col("text")
    copy = F.xxhash64(text)
    trees = base.save(docs.select("doc_id", copy.alias("copy"), paths_of(text).alias("l")))
    found = recurring(docs, trees, min_docs)
    marked = _among(trees.select("copy", F.explode(F.array_distinct(F.transform("l", lambda x: x["v"]))).alias("v")), found, "v")
    gone = marked.groupBy("copy").agg(F.collect_set("v").alias("gone"))  # the lines of one text
    both = docs.withColumn("_copy", copy).join(gone.withColumnRenamed("copy", "_copy"), "_copy", "left")
    lines = lines_of(text)
    left = F.filter(lines, lambda x: ~F.array_contains("gone", F.xxhash64(_plain(x))) | (_plain(x) == ""))
    keep = F.when(F.col("gone").isNull(), lines).otherwise(left)
    out = both.select("doc_id", "text", *carry, F.size(lines).cast("long").alias("n_lines"), keep.alias("keep"))
    return out.select("doc_id", "text", *carry, "n_lines", (F.col("n_lines") - F.size("keep")).cast("long").alias("n_removed"), F.array_join("keep", "\n").alias("kept_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring(base.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


_LINES = r"""
lines AS (
    SELECT doc_id, text, i, line, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS m
    FROM (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), texts AS (
    SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM lines) WHERE doc_id = first
), forms AS (
    SELECT m, string_split(m, ' ') AS tok, count(*) AS times FROM texts WHERE m <> '' GROUP BY m
), cells AS (
    SELECT m, times, len(tok) AS n, pos, tok[pos] AS token, regexp_replace(array_to_string(tok[1:2], ' '), '[^ ]*[0-9@][^ ]*', '<*>', 'g') AS lead
    FROM (SELECT *, unnest(range(1, len(tok) + 1)) AS pos FROM forms)
), words AS (
    SELECT *, sum(times) OVER (PARTITION BY n, lead, pos, token) AS c, count(*) OVER (PARTITION BY m) AS words FROM cells WHERE NOT regexp_matches(token, '[0-9@]')
), kept AS (
    SELECT m, n, lead, words, row_number() OVER w AS k, list(pos || ' ' || token) OVER w AS constants FROM words WHERE c >= 5 WINDOW w AS (PARTITION BY m ORDER BY c DESC, pos)
), made AS (
    SELECT m, n || ' ' || lead || ' ' || array_to_string(list_sort(constants), ' ') AS t FROM kept WHERE k >= words - n // 6 AND 2 * k >= n
    UNION ALL SELECT m, 'own ' || m FROM forms
), pairs AS (
    SELECT DISTINCT doc_id, t FROM texts JOIN made USING (m)
), shared AS (
    SELECT t FROM pairs GROUP BY t HAVING count(*) >= 5
), wide AS (
    SELECT DISTINCT m FROM made JOIN shared USING (t)
), near AS (
    SELECT doc_id FROM texts LEFT JOIN wide ON wide.m = texts.m GROUP BY doc_id HAVING sum(CASE WHEN wide.m IS NULL THEN 0 ELSE len(line) END) > 6 / 7 * sum(len(line))
), last AS (
    SELECT t FROM pairs JOIN shared USING (t) LEFT JOIN near ON near.doc_id = pairs.doc_id GROUP BY t HAVING count(*) - count(near.doc_id) + max(CASE WHEN near.doc_id IS NULL THEN 0 ELSE 1 END) >= 5
), recurring AS (
    SELECT DISTINCT m FROM made JOIN last USING (t)
), result AS (
    SELECT doc_id, count(*) AS n, count(r.m) AS gone, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.m IS NULL), '') AS k
    FROM lines LEFT JOIN recurring r ON lines.m = r.m GROUP BY doc_id
)"""

ORACLE_SQL = f"WITH {_LINES} SELECT doc_id, n::BIGINT AS n_lines, gone::BIGINT AS n_removed, sha256(k) AS kept_sha256 FROM result"
