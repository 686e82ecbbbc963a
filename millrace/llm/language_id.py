"""Language ID by rank-order profiles.

A language's profile is the list of its PROFILE most frequent letter n-grams (1 to 3, words padded by one blank);
a document's own list is compared with each by the out-of-place distance: the sum of the differences in rank, an
absent n-gram counting as PROFILE places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

#: n-grams of a profile; texts a language's profile is learned from at most (those of least hash); languages at most.
PROFILE, SAMPLE, LANGUAGES = 400, 1500, 200
#: n-grams are numbers in base 2**21: code points of one, two or three letters.
_SHIFT = np.int64(21)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters is one blank, and blanks surround it."""
    low = text.lower()
    points = np.frombuffer((" " + low + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, back = np.unique(points, return_inverse=True)
    points = np.where(np.array([chr(k).isalpha() for k in kinds])[back], points, 32)
    blank = points == 32
    return points[~(blank & np.append(False, blank[:-1]))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (sorted) of a text and their counts; a lone blank is none."""
    c = letters(text)
    if len(c) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, two = c[c != 32], (c[:-1] << _SHIFT) | c[1:]
    three = (two[:-1] << _SHIFT) | c[2:]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(g: np.ndarray, n: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The ``top`` most frequent; ties in order of the n-gram's number."""
    return g[np.lexsort((g, -n))[:top]]


def learn(docs: DataFrame, sample: int = SAMPLE, top: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language from rows with doc_id, text and lang: at most ``sample`` different texts of a language, those of least hash.

    Rows with a null text or lang are left out.  Copies of a text count once, so a large group of them can't fill the
    sample.  More than LANGUAGES languages: an error.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    hashed = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("_k"))
    # a different text by its hash and the least doc_id that has it, so that copies cost no more than their hash
    keys = base.save(hashed.groupBy("lang", "_k").agg(F.min("doc_id").alias("_first")))
    first = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(first) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # a bound on the hash leaves a few times the sample, however large a language is, before the exact cut
    share = F.lit(None).cast("double")
    for r in first:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 4.0 * sample / r["n"]))).otherwise(share)
    near = keys.where((F.pmod(F.xxhash64("_k"), F.lit(1 << 20)) / (1 << 20)) < share)
    least = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_k"))).where(F.col("_r") <= sample).drop("_r")
    least = least.select(F.col("lang").alias("_l"), F.col("_k").alias("_h"), "_first")
    same = (F.col("lang") == F.col("_l")) & (F.col("_k") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    cut = hashed.join(F.broadcast(least), same).dropDuplicates(["lang", "_k"])  # LANGUAGES * sample keys at most

    @base.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g, n = grams(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    totals = cut.select("lang", "text").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    best = totals.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("_r") <= top)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "_r").collect():  # LANGUAGES * PROFILE rows at most
        out.setdefault(r["lang"], []).append(r["g"])
    return out


class Ranker:
    def __init__(self, profiles: dict[str, list[int]], top: int = PROFILE):
        self.langs, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.empty(0, np.int64)]))
        self.places = np.full((len(self.langs), len(self.grams) + 1), top, np.int64)  # the last column: absent
        for i, lang in enumerate(self.langs):
            self.places[i, np.searchsorted(self.grams, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 at distance 0, 0 where no n-gram is in the profile.  Ties: the first in order."""
        g, n = grams(text or "")
        own = ranked(g, n, self.top)
        if not len(own):
            return "und", 0.0
        if not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), max(0, len(self.grams) - 1))
        at = np.where(self.grams[at] == own, at, len(self.grams))
        there = self.places[:, at]
        d = np.where(there < self.top, abs(there - np.arange(len(own))), self.top).sum(axis=1)
        k = int(np.argmin(d))
        return self.langs[k], float(1 - d[k] / (self.top * len(own)))


def predict_rows(docs: DataFrame, profiles: dict[str, list[int]], top: int = PROFILE) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, from the whole text alone (columns of these names are replaced).

    ``und`` with score 0 where the text is null or has no letter.  Copies get equal results.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, top)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                langs, scores = zip(*map(ranker.predict, b.column(keep.index("text")).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    base.small_batches(docs.sparkSession)
    return docs.select(*keep).mapInArrow(run, schema)


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text; others are ignored)."""
    return predict_rows(docs.select("doc_id", "text"), profiles, top).select("doc_id", "lang_pred", "score")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``, is 0; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
