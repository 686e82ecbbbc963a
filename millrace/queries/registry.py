"""Named queries over the star-schema tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


class Sources(dict):
    """Tables by name, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df

    def get(self, name: str, default: object = None) -> DataFrame | None:
        return self[name] if name in TABLES else default


def query(name: str, sql: str | None = None):
    """Registers ``f(tables)`` under ``name``."""

    def keep(f: Callable[[Sources], DataFrame]) -> Callable[[Sources], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Sources(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
