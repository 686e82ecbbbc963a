"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from . import base


def components(edges: DataFrame) -> DataFrame:
    """id, label (the least id of its component) for every id of ``edges`` (u, v long, undirected; loops and nulls are ignored).

    Each step is written to the shared folder; the number of steps grows with the logarithm of the longest path.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = base.save(e), None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, base.save(low.select("u", F.col("m").alias("v")).unionAll(small).distinct())
        storage.drop(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
