"""Overlap joins of ranges and runs of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs whose closed ranges overlap, within equal ``keys``.

    Both sides are dealt to bins of ``width``; a pair is kept only in the bin where the later of the two starts lies, so no
    pass over the result removes repeats.  Choose ``width`` near the usual length: a range costs length / width rows.
    Column names must differ except for ``keys``; ranges with a null end or ending before their start pair with nothing.
    """
    (ls, le), (rs, re_) = left_range, right_range
    w = F.lit(width)

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        ok = F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(s) <= F.col(e))
        low, high = F.floor(F.col(s) / w), F.floor(F.col(e) / w)
        return df.where(ok).withColumn("_bin", F.explode(F.sequence(low, high)))

    joined = binned(left, ls, le).join(binned(right, rs, re_), [*keys, "_bin"])
    first = F.floor(F.greatest(ls, rs) / w)
    return joined.where((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) & (F.col("_bin") == first)).drop("_bin")


def islands(df: DataFrame, keys: list[str], position: str, gap: int = 1, value: Column | None = None, width: int = 1 << 16) -> DataFrame:
    """Runs of positions at most ``gap`` apart: keys, run_start, run_end, n, mean of ``value``, gap_before.

    Runs are found in bins of ``width`` positions and then joined over the bins' runs, so no task holds all positions of a key.
    """
    runs = df.withColumn("_bin", F.floor(F.col(position) / F.lit(width))).withColumn("_v", (value if value is not None else F.lit(None)).cast("double"))
    runs = runs.select(*keys, "_bin", F.col(position).alias("run_start"), F.col(position).alias("run_end"), F.lit(1).cast("bigint").alias("n"), F.col("_v").alias("_sum"), F.when(F.col("_v").isNotNull(), 1).otherwise(0).alias("_cnt"))
    for part in ([*keys, "_bin"], keys):
        w = Window.partitionBy(*part).orderBy("run_start")
        apart = F.col("run_start") - F.lag("run_end").over(w)
        marked = runs.withColumn("_new", F.when(apart <= gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        runs = marked.groupBy(*part, "_run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n"), F.sum("_sum").alias("_sum"), F.sum("_cnt").alias("_cnt"))
    mean = [F.call_function("try_divide", F.col("_sum"), F.col("_cnt")).alias("mean_value")] if value is not None else []
    before = F.lag("run_end").over(Window.partitionBy(*keys).orderBy("run_start"))
    return runs.select(*keys, "run_start", "run_end", "n", *mean, (F.col("run_start") - before - 1).alias("gap_before"))


def stacked(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Adds ``level``: the lowest level on which a range overlaps no earlier one (greedy, by start), within each key."""
    schema = T.StructType([*df.schema.fields, T.StructField("level", T.IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values([start, end])
        ends, levels = [], []
        for s, e in zip(pdf[start], pdf[end]):
            k = next((i for i, x in enumerate(ends) if x < s), len(ends))
            ends[k : k + 1] = [e]
            levels.append(k)
        return pdf.assign(level=levels)

    return df.groupBy(*keys).applyInPandas(run, schema)
