"""The corpus pipeline: stages over ``documents``, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.  All
but the last return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import base, bpe, decontaminate, jaccard_join, language_id, line_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of dropped documents that are broadcast at most (8 bytes each); beyond, both sides meet by id.
BROADCAST = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text has a language (not ``und``); lang becomes the predicted one."""
    profiles = language_id.learn(docs.select("doc_id", "text", "lang"))
    keep = docs.select(*COLUMNS)
    named = language_id.predict_rows(keep, profiles)
    return named.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring template lines; a row left without any text goes."""
    kept = line_dedup.drop_recurring(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    there = (F.col("n_removed") == 0) | (F.trim("kept_text") != "")
    return kept.where(there).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group; rows with a null doc_id stay."""
    found = base.save(jaccard_join.jaccard_components(docs))
    gone = base.save(found.where("doc_id <> component_id").select("doc_id").distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    return docs.select(*COLUMNS).join(few, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), base.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens; every text is decoded again and must come back whole."""
    path, pattern = bpe.public_vocabulary()
    both = bpe.encode(docs.select(*COLUMNS), path, pattern, decoded="decoded")
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    checked = F.when(whole, F.col("ids")).otherwise(F.raise_error(F.lit("decoding did not give the text back")))
    return both.select("doc_id", "lang", "source", checked.alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: Language profiles and merges by rank are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = base.save(stage(spark, docs, sf_dir))
    return docs
