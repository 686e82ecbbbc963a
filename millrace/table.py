"""A table of a pipeline: a DataFrame with positional columns c0..cn, display names (repeats are legal) and an order.

Order is data here.  ``_row`` orders the rows; it is only dense after ``numbered()``, which numbers written rows from
their partitions' counts, without a window over the whole table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

ROW = "_row"
_IN_PARTITION = (1 << 33) - 1


class PlanError(ValueError):
    """A pipeline that can't be planned: an unknown column, operation or argument."""


@dataclass(frozen=True)
class Table:
    df: DataFrame
    names: tuple[str, ...]
    dense: bool = False

    @staticmethod
    def of(df: DataFrame, order: list | None = None) -> Table:
        """The rows in the order of ``order``, else in that of the scan."""
        names = tuple(df.columns)
        rows = df.orderBy(*order) if order else df
        cols = [rows[c].alias(f"c{i}") for i, c in enumerate(names)]
        return Table(rows.select(*cols, F.monotonically_increasing_id().alias(ROW)), names)

    @property
    def types(self) -> list[str]:
        kinds = dict(self.df.dtypes)
        return [kinds[f"c{i}"] for i in range(len(self.names))]

    def col(self, i: int) -> Column:
        return self.df[f"c{i}"]

    def fixed(self) -> Table:
        """The rows written once, so that ``_row`` is the same in every job that reads them."""
        return Table(materialize(self.df), self.names, self.dense)

    def numbered(self) -> Table:
        """With ``_row`` as 0, 1, 2, ...

        The sorted rows are written with their partition and place in it, and the same rows are then counted and numbered:
        a second run of the sort may cut its partitions elsewhere.
        """
        if self.dense:
            return self
        place = F.monotonically_increasing_id()
        rows = materialize(self.df.orderBy(ROW).drop(ROW).withColumn("_m", place))
        part = F.shiftright("_m", 33)
        before, starts = 0, []
        for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row for each partition
            starts.append((r["p"], before))
            before += r["n"]
        offsets = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
        joined = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
        return Table(joined.withColumn(ROW, F.col("_m").bitwiseAND(_IN_PARTITION) + F.col("_start")).drop("_m", "_p", "_start"), self.names, True)

    def with_columns(self, cols: list[tuple[str, Column]]) -> Table:
        """These columns, in this order, and no others."""
        return Table(self.df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(cols)], ROW), tuple(n for n, _ in cols), self.dense)

    def columns(self) -> list[tuple[str, Column]]:
        return [(n, self.col(i)) for i, n in enumerate(self.names)]

    def where(self, condition: Column) -> Table:
        return Table(self.df.where(condition), self.names)

    def result(self) -> DataFrame:
        """The rows under their display names; a repeated name gets _2, _3, ..."""
        seen: dict[str, int] = {}
        out = []
        for i, n in enumerate(self.names):
            seen[n] = seen.get(n, 0) + 1
            out.append(self.col(i).alias(n if seen[n] == 1 else f"{n}_{seen[n]}"))
        return self.df.select(*out)

    def index(self, spec: object) -> int:
        """One column by index, name, {name, num} (the num-th of that name, from 0) or {regex}."""
        found = self.indexes(spec)
        if not found:
            raise PlanError(f"no column {spec!r}; there are {', '.join(self.names)}")
        return found[0]

    def indexes(self, spec: object) -> list[int]:
        """Columns by a selector or a list of them; "*" is all; {regex, negate, caseSensitive, optional}."""
        n = len(self.names)
        if spec is None or spec == "*":
            return list(range(n))
        if isinstance(spec, (list, tuple)):
            return list(dict.fromkeys(i for s in spec for i in self.indexes(s)))
        if isinstance(spec, bool):
            raise PlanError(f"no column {spec!r}")
        if isinstance(spec, int):
            if not -n <= spec < n:
                raise PlanError(f"no column {spec}; there are {n}")
            return [spec % n]
        if isinstance(spec, dict):
            if "regex" in spec:
                pattern = re.compile(spec["regex"], 0 if spec.get("caseSensitive") else re.I)
                found = [i for i, c in enumerate(self.names) if bool(pattern.search(c)) != bool(spec.get("negate"))]
            else:
                same = [i for i, c in enumerate(self.names) if c == spec.get("name")]
                k = int(spec.get("num", 0))
                found = same[k : k + 1]
            if not found and not spec.get("optional"):
                raise PlanError(f"no column {spec!r}; there are {', '.join(self.names)}")
            return found
        if isinstance(spec, str):
            if spec in self.names:
                return [self.names.index(spec)]
            if re.fullmatch(r"\d+(-\d+)?(,\d+(-\d+)?)*", spec):
                return [i for a in spec.split(",") for i in range(int(a.split("-")[0]), int(a.split("-")[-1]) + 1) if i < n]
        raise PlanError(f"no column {spec!r}; there are {', '.join(self.names)}")
