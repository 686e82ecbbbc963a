"""Places and running sums over range partitions: no window holds more than one partition of a bounded number of rows.

Rows are sorted over range partitions and written once.  A window works inside one partition only; what the partitions
before it add is a window over one row a partition, and reaches the rows by a broadcast of at most one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

PART, AT = "_part", "_at"
#: Rows of a range partition, about.
ROWS = 200_000
_IN_PARTITION = (1 << 33) - 1


def ranged(df: DataFrame, order: list[Column], rows: int = ROWS, parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` over range partitions and written: with _part (its partition) and _at (its place there).

    Rows equal in all of ``order`` stay in one partition, so ``order`` should tell large groups of rows apart.
    """
    n = parts or max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(dealt.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias(AT)))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], rows: int = ROWS) -> DataFrame:
    """Adds, by name, the sum of each column of ``sums`` over the rows of the same ``keys`` before this one (0 for the first).

    Out: the rows of ``ranged`` with these columns.  Null keys are a key of their own.  Ties of ``order`` are taken in any
    one order.  A key's rows may fill any number of partitions.
    """
    placed = ranged(df, [*[F.col(k).asc_nulls_first() for k in keys], *order], rows)
    if not sums:
        return placed
    inside = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    part = placed.groupBy(PART, *keys).agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    more = [F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))]
    carried = part.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *more, F.count(F.lit(1)).over(earlier).alias("_n")).where("_n > 0")
    same = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_o{i}") for i, c in enumerate(sums.values())])
    # only the key that a partition begins with can have come before: one row a partition at most
    total = [(F.col(f"_o{i}") + F.coalesce(F.col(f"_b{i}"), F.lit(0))).alias(name) for i, name in enumerate(sums)]
    return own.join(F.broadcast(carried), same, "left").select(*placed.columns, *total)


def following(df: DataFrame, column: str, name: str, rows: int = ROWS) -> DataFrame:
    """Adds the next larger row's ``column`` as ``name`` (null for the last), over range partitions; nulls are left out."""
    placed = ranged(df.where(F.col(column).isNotNull()), [F.col(column)], rows)
    firsts = [(r["p"], r["v"]) for r in placed.groupBy(F.col(PART).alias("p")).agg(F.min(column).alias("v")).orderBy("p").collect()]  # a row a partition
    kind = dict(df.dtypes)[column]
    after = df.sparkSession.createDataFrame([(p, v) for (p, _), (_, v) in zip(firsts, firsts[1:])], f"{PART} int, _next {kind}")
    own = placed.withColumn("_own", F.lead(column).over(Window.partitionBy(PART).orderBy(AT)))
    return own.join(F.broadcast(after), PART, "left").select(*df.columns, F.coalesce("_own", "_next").alias(name))
