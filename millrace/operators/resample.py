"""Downsampling a table to a number of output rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..table import ROW, Table
from ..values import num


def downsample(t: Table, resolution: int, abscissa: object = None, minmax: object = None, main: object = None) -> Table:
    """The first and last row, and between them ``resolution`` - 2 equal bins by row count or by the abscissa's values.

    A bin gives the rows of least and greatest value of the main min-max column (the first such rows, in row order; one
    if they are the same), or without such columns its middle row.  A table of at most ``resolution`` rows stays.
    """
    t = t.numbered()
    n = t.df.count()
    if resolution >= n or resolution < 3:
        return t if resolution >= n else Table(t.df.where(F.col(ROW).isin([0] if resolution == 1 else [0, n - 1])), t.names)
    bins = resolution - 2
    if abscissa is None:
        place = F.floor((F.col(ROW) - 1) * bins / F.lit(n - 2))
    else:
        i = t.index(abscissa)
        x = num(t.col(i), t.types[i]).cast("double")
        a, b = t.df.agg(F.max(F.when(F.col(ROW) == 1, x)), F.max(F.when(F.col(ROW) == n - 2, x))).first()
        place = F.floor((x - a) * bins / (b - a)) if a != b else F.lit(0)
    inner = t.df.where(F.col(ROW).between(1, n - 2)).withColumn("_bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))
    names = [f"c{i}" for i in range(len(t.names))]
    whole = F.struct(*names, ROW)
    if main is None and minmax is None:
        middle = inner.groupBy("_bin").agg(F.count("*").alias("k"), F.min(ROW).alias("lo"))
        rows = inner.join(middle, "_bin").where(F.col(ROW) == F.col("lo") + F.floor((F.col("k") - 1) / 2)).select(*names, ROW)
    else:
        i = t.index(main if main is not None else minmax[0] if isinstance(minmax, list) else minmax)
        v = num(t.col(i), t.types[i]).cast("double")
        ends = inner.groupBy("_bin").agg(F.min_by(whole, F.struct(v, F.col(ROW))).alias("lo"), F.max_by(whole, F.struct(v, -F.col(ROW))).alias("hi"))
        rows = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")).select("x.*")
    edge = t.df.where(F.col(ROW).isin(0, n - 1)).select(*names, ROW)
    return Table(edge.unionAll(rows), t.names)
