"""Tables gathered into one by a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_join(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """A row for each key of ``base``, with the columns of all tables; keys that only others have are dropped.

    Of rows with the same key in one table the greatest (column by column) stays; null keys count as one key.  A column
    name that an earlier table has is taken by the later one, in the earlier one's place.
    """

    def single(df: DataFrame, names: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.max(F.struct(*[df[c].alias(n) for c, n in zip(rest, names)])).alias("_x")) if rest else df.select(key).distinct()
        return one.select(key, *[F.col(f"_x.{n}").alias(n) for n in names])

    order: dict[str, str] = {}
    out = None
    for k, df in enumerate([base, *others]):
        rest = [c for c in df.columns if c != key]
        names = [f"_{k}_{i}" for i in range(len(rest))]
        one = single(df, names)
        order |= dict(zip(rest, names))
        out = one if out is None else out.join(one.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return out.select(key, *[F.col(n).alias(c) for c, n in order.items()])
