"""Event streams: windowed trends, dense buckets and resampling, batch or streaming (extensions of the table commands)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def trend(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, group: str = "event_type", value: str = "value") -> DataFrame:
    """start, group, n, total by tumbling or sliding windows of ts; ``late``: how far behind a stream's events may be."""
    events = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = events.groupBy(w.alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("start"), group, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, key: str = "user_id") -> DataFrame:
    """start, end, n of each key's sessions: events at most ``gap`` apart."""
    events = events.withWatermark("ts", late) if late else events
    by = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dense(events: DataFrame, unit: str, group: str = "event_type") -> DataFrame:
    """start, group, n for every ``unit`` (hour, day, ...) from the first to the last, zeros included.  Batch."""
    by = events.groupBy(F.date_trunc(unit, "ts").alias("start"), group).agg(F.count("*").alias("n"))
    ends = by.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("start"))
    return every.join(by.select(group).distinct(), how="cross").join(by, ["start", group], "left").select("start", group, F.coalesce("n", F.lit(0)).alias("n"))


def running(events: DataFrame, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """A stateful stream: each key's running count and sum after every trigger."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there, into a table in memory of this name (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
