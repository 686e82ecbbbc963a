"""Read-only procedures over the tables of a service: requests, logs, groups, usage.

Each takes the tables and the names of their columns, and returns rows; nothing here changes state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prefix
from ..table import PlanError


def queue_position(requests: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """``requests`` with ``ahead``: how many of its lane (a null lane is one of its own) come before it by ``order``.

    A lane of any size is counted over range partitions; ties of ``order`` are taken in any one order.
    """
    placed = prefix.running(requests, [lane], [F.col(c).asc_nulls_first() for c in order], {"ahead": F.lit(1).cast("bigint")})
    return placed.drop(prefix.PART, prefix.AT)


def by_time(rows: DataFrame, time: str, since: object = None, to: object = None) -> DataFrame:
    """Rows with a time after ``since`` up to ``to`` (null: no bound); rows without a time never."""
    out = rows.where(F.col(time).isNotNull())
    out = out if since is None else out.where(F.col(time) > F.lit(since))
    return out if to is None else out.where(F.col(time) <= F.lit(to))


def capacity(requests: DataFrame, status: str, amounts: dict[str, tuple[Column, Column]], unit: float = 1.0) -> DataFrame:
    """Per status, for each name of ``amounts`` (value, condition) the sum where the condition holds, in whole units, rounded up.

    A status without such rows has null.
    """
    return requests.groupBy(status).agg(*[F.ceil(F.sum(F.when(test, value)) / F.lit(float(unit))).cast("bigint").alias(name) for name, (value, test) in amounts.items()])


def log_read(log: DataFrame, order: str, level: str | None = None, at_least: float | None = None, equal: dict[str, list] | None = None) -> DataFrame:
    """Entries of at least a level whose columns have one of the given values, the latest first."""
    out = log
    for column, values in (equal or {}).items():
        out = out.where(F.col(column).isin(values))
    if at_least is not None:
        if level is None:
            raise PlanError("a least level needs the level's column")
        out = out.where(F.col(level) >= F.lit(at_least))
    return out.orderBy(F.desc(order))


def group_progress(requests: DataFrame, members: DataFrame, on: tuple[str, str], status: str, amounts: list[str]) -> DataFrame:
    """Per status, how many requests of the group's members there are, and the sums of ``amounts``; a member named twice counts once."""
    of = requests.join(members, requests[on[0]] == members[on[1]], "left_semi")
    return of.groupBy(status).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in amounts])


def usage_by_path(rows: DataFrame, path: str, paths: list[str], by: str, amounts: list[str]) -> DataFrame:
    """Per value of ``by``, rows and sums over those at one of ``paths``: with a ``*`` at its end all that begin so, else that path alone.

    A row that several paths hold counts once; no paths hold nothing.
    """
    test = F.lit(False)
    for p in paths:
        test = test | (F.startswith(path, F.lit(p[:-1])) if p.endswith("*") else F.col(path) == F.lit(p))
    return rows.where(test).groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in amounts])


def sql_page(spark: SparkSession, tables: dict[str, DataFrame], query: str, start: int = 0, count: int = 0, params: dict | None = None) -> DataFrame:
    """A page of any SELECT over named tables; ``params`` fill ``:name`` marks.  Pages follow each other only where the query orders its rows.

    The tables are temporary views for the time of planning, and anything but one query is refused.
    """
    head = query.lstrip().lstrip("(").lstrip()[:6].lower()
    if not (head.startswith("select") or head.startswith("with")):
        raise PlanError("only a SELECT can be paged")
    shown = spark.catalog
    kept = [n for n in tables if shown.tableExists(n)]
    if kept:
        raise PlanError(f"there are tables of these names already: {', '.join(kept)}")
    try:
        for name, df in tables.items():
            df.createTempView(name)
        out = spark.sql(query, args=params or {})
        out.schema  # noqa: B018  resolved while the views are there
    finally:
        for name in tables:
            shown.dropTempView(name)
    out = out.offset(start) if start else out
    return out.limit(count) if count else out
