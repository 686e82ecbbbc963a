"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Paths written by this process and not deleted yet, and the one of each DataFrame read back.
_WRITTEN: dict[str, None] = {}
_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    root = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Spark's own switch (since 4.1): an execution's shuffle files go when it ends, which a written table doesn't need any more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of the executions inside are deleted at their end; the session's setting comes back afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors.

    ``by``: a column whose values get folders of their own, so that a filter on it reads only these.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    with _shuffles_end(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = None
    _OF[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.pop(path, None)


def drop(*written: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no DataFrame still to be computed reads."""
    for df in written:
        if df in _OF:
            _delete(df.sparkSession, _OF.pop(df))


def drop_part(written: DataFrame, column: str, value: str) -> None:
    """Deletes one folder of a table that ``materialize`` wrote by ``column``; only filters on other values may follow."""
    spark = written.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{_OF[written]}/{column}={value}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Deletes all that ``materialize`` wrote, when no DataFrame made from it is used any more; the number of tables."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)
