"""Written relations that answer a search from few files: sorted ones, and ranges clustered with the largest end of each file.

A build sorts a relation over range partitions and writes a file for each, with one row about every file: what it holds at
least and at most.  A search reads these rows, picks the files that can hold an answer and scans only them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, materialize
from ..table import PlanError

#: Rows of a file, about.
ROWS = 500_000


def _counts(written: DataFrame, key: str | None, about: list[Column]) -> DataFrame:
    """A row a file: _n rows, _nulls of them without ``key``, and ``about``; numbers only, so that a task hashes its files and sorts no rows."""
    none = F.col(key).isNull() if key else F.lit(False)
    return written.withColumn("_file", F.col("_metadata.file_path")).groupBy("_file").agg(F.count("*").alias("_n"), F.count_if(none).alias("_nulls"), *about)


def _write(df: DataFrame, order: list[Column], path: str, about: list[Column], rows: int, key: str | None = None, nulls_first: bool = True) -> None:
    """``key``: the column that the rows are sorted by first; the least and the greatest of a file are its ends (nulls aside)."""
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    counts = materialize(_counts(written, key, about))
    out = counts
    if key:
        first, last = (F.col("_nulls"), F.col("_n") - 1) if nulls_first else (F.lit(0), F.col("_n") - F.col("_nulls") - 1)
        ends = F.broadcast(counts.select("_file", first.alias("_first"), last.alias("_last")))
        placed = written.select(F.col(key).alias("_key"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        at_end = placed.join(ends, "_file").where("_at = _first OR _at = _last")  # two rows a file
        out = counts.join(at_end.groupBy("_file").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high")), "_file", "left")
    out.write.mode("overwrite").parquet(f"{path}/files")
    drop(counts)


@dataclass(frozen=True)
class SortedRelation:
    """A relation written in order of some columns: pages by number, equality on the first of them."""

    spark: SparkSession
    path: str
    by: tuple[str, ...]
    reverse: bool = False
    numeric: bool = False

    @staticmethod
    def build(df: DataFrame, path: str, by: list[str], reverse: bool = False, numeric: bool = False, rows: int = ROWS) -> SortedRelation:
        """Writes ``df`` to the folder ``path`` (replacing it), sorted by ``by``; nulls come first, with ``reverse`` last.

        ``numeric``: texts are compared as numbers, those that are none come with the nulls.  Ties keep no order.
        """
        made = SortedRelation(df.sparkSession, path, tuple(by), reverse, numeric)
        keys = df.select("*", *[made._key(c).alias(f"_k{i}") for i, c in enumerate(by)])
        order = [F.col(f"_k{i}").desc_nulls_last() if reverse else F.col(f"_k{i}").asc_nulls_first() for i in range(len(by))]
        _write(keys, order, path, [], rows, "_k0", not reverse)
        return made

    def _key(self, c: str) -> Column:
        return F.col(f"`{c}`").cast("string").try_cast("double") if self.numeric else F.col(f"`{c}`")

    def _order(self, i: int) -> Column:
        return F.col(f"_k{i}").desc_nulls_last() if self.reverse else F.col(f"_k{i}").asc_nulls_first()

    def _files(self) -> list:
        """A row a file, in order."""
        edge = F.col("_high") if self.reverse else F.col("_low")
        known = self.spark.read.parquet(f"{self.path}/files")
        first = F.when(F.lit(self.reverse), F.when(edge.isNull(), 1).otherwise(0)).otherwise(F.when(F.col("_nulls") > 0, 0).otherwise(1))
        return known.orderBy(first, edge.desc() if self.reverse else edge.asc(), "_file").collect()

    def _read(self, files: list[str]) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/rows")
        return self.spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)

    def rows(self, start: int = 0, count: int | None = None) -> DataFrame:
        """Rows ``start`` to ``start + count`` in order; only the files that hold them are read."""
        picked, before, skip = [], 0, None
        for f in self._files():
            if before + f["_n"] > start and (count is None or before < start + count):
                skip = start - before if skip is None else skip
                picked.append(f["_file"])
            before += f["_n"]
        order = [self._order(i) for i in range(len(self.by))]
        out = self._read(picked).orderBy(*order).offset(skip or 0)
        out = out if count is None else out.limit(count)
        return out.drop(*[f"_k{i}" for i in range(len(self.by))])

    def find(self, value: object) -> DataFrame:
        """Rows whose first column is ``value`` (null: is null), from the files that can hold it."""
        want = float(value) if self.numeric and value is not None else value
        test = F.col("_nulls") > 0 if want is None else (F.col("_low") <= F.lit(want)) & (F.col("_high") >= F.lit(want))
        files = [f["_file"] for f in self.spark.read.parquet(f"{self.path}/files").where(test).select("_file").collect()]
        same = F.col("_k0").isNull() if want is None else F.col("_k0") == F.lit(want)
        return self._read(files).where(same).drop(*[f"_k{i}" for i in range(len(self.by))])


@dataclass(frozen=True)
class RangeIndex:
    """Closed ranges written by key, class of length and start, with the largest end of each file.

    Ranges of like length lie together, so one long range doesn't stretch the files of short ones.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    start: str
    end: str

    @staticmethod
    def build(df: DataFrame, path: str, keys: list[str], start: str, end: str, rows: int = ROWS) -> RangeIndex:
        """Writes ``df`` to the folder ``path`` (replacing it).  Ranges with a null end, or that end before they start, are
        written and never found."""
        length = F.col(end) - F.col(start) + 1
        kind = F.when(length > 0, F.ceil(F.log2(length.cast("double")))).otherwise(-1)
        order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_class"), F.col(start).asc_nulls_first(), F.col(end)]
        about = [F.min(start).alias("_start"), F.max(end).alias("_end")]
        _write(df.withColumn("_class", F.coalesce(kind, F.lit(-1)).cast("int")), order, path, about, rows, keys[0] if keys else None)
        return RangeIndex(df.sparkSession, path, tuple(keys), start, end)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("_class")

    def files(self, low: float, high: float, key: object = None) -> list[str]:
        """Files that can hold a range of ``key`` (the first of the keys; None: any) that overlaps low..high."""
        known = self.spark.read.parquet(f"{self.path}/files").where((F.col("_start") <= F.lit(high)) & (F.col("_end") >= F.lit(low)))
        if key is not None and (isinstance(key, str) or dict(known.dtypes)["_low"] != "string"):  # texts found as numbers lie in any file
            known = known.where((F.col("_low") <= F.lit(key)) & (F.col("_high") >= F.lit(key)))
        return [r["_file"] for r in known.select("_file").collect()]  # a row a file

    def search(self, low: float, high: float | None = None, key: object = None, exact: bool = False) -> DataFrame:
        """The ranges that overlap low..high (``high`` left out: that hold ``low``); ``exact``: that are low..high."""
        high = low if high is None else high
        files = self.files(low, high, key)
        every = self.spark.read.parquet(f"{self.path}/rows")
        found = self.spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)
        s, e = F.col(self.start), F.col(self.end)
        test = (s == F.lit(low)) & (e == F.lit(high)) if exact else (s <= F.lit(high)) & (e >= F.lit(low)) & (s <= e)
        return found.where(test if key is None else test & (F.col(self.keys[0]) == F.lit(key))).drop("_class")


def indexed(relation: object) -> DataFrame:
    """A relation as rows, whether it is indexed or not."""
    if isinstance(relation, RangeIndex):
        return relation.table()
    if isinstance(relation, SortedRelation):
        return relation.rows()
    if isinstance(relation, DataFrame):
        return relation
    raise PlanError(f"no relation: {relation!r}")
