"""Aggregating commands of a table pipeline: pivots, trends, gap filling, statistics, survival."""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import prefix
from .. import values as V
from ..functions.expr import Compiler
from ..plans.pipeline import command, renumbered, row_set, sort_table, transpose
from ..storage import materialize
from ..table import ROW, PlanError, Table

#: Values a pivot spreads into columns at most.
PIVOT_COLUMNS = 10_000


def _number(t: Table, i: int) -> Column:
    return V.maybe_num(t.col(i), t.types[i])


def _rows(t: Table, spec: object) -> Table:
    wanted = row_set(spec)
    if wanted is None:
        return t
    n = t.numbered()
    return n.where(F.col(ROW).isin(wanted))


def _table(df: DataFrame, order: list) -> Table:
    """A DataFrame as a table, in the order of the columns ``order``."""
    names = tuple(df.columns)
    return renumbered(df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]), names, [f"c{names.index(o)}" if isinstance(o, str) else o for o in order])


def _distinct(df: DataFrame, c: Column) -> list:
    found = [r["v"] for r in df.select(c.alias("v")).distinct().orderBy("v").limit(PIVOT_COLUMNS + 1).collect()]
    if len(found) > PIVOT_COLUMNS:
        raise PlanError(f"more than {PIVOT_COLUMNS} columns")
    return found


@command("dictionaryTable")
def dictionary_table(t: Table, arg: dict) -> Table:
    """Pivot: rows by rowSet, columns by colSet, cells from valSet: option 0 the first, 1 the last, else all by comma."""
    r, c, v = (t.index(arg[k][0] if isinstance(arg[k], list) else arg[k]) for k in ("rowSet", "colSet", "valSet"))
    cols = [V.text(t.col(i), t.types[i]) for i in (r, c, v)]
    long = t.df.select(*[x.alias(n) for x, n in zip(cols, ("r", "c", "v"))], F.col(ROW).alias("o"))
    option = arg.get("option", 0)
    made = F.min_by("v", "o") if option == 0 else F.max_by("v", "o") if option == 1 else F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), ",")
    wide = long.groupBy("r").pivot("c", _distinct(long, F.col("c"))).agg(made)
    missing = arg.get("defaultMissing", "")
    title = t.names[r]
    out = wide.select(F.col("r").alias(title), *[F.coalesce(F.col(f"`{n}`"), F.lit(missing)).alias(n) for n in wide.columns if n != "r"])
    return _table(out, [title])


def _period(c: Column) -> Column:
    """Y/M/D or M/D/Y (or with -) as YYYY-MM."""
    p = F.split(c, "[/-]")
    year_first = F.length(F.get(p, F.lit(0))) == 4
    y = F.when(year_first, F.get(p, F.lit(0))).otherwise(F.substring(F.get(p, F.lit(2)), 1, 4))
    m = F.when(year_first, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0)))
    return F.when(F.size(p) >= 2, F.concat_ws("-", y, F.lpad(m, 2, "0"))).otherwise(c)


def _keyword(c: Column, keywords: str, mismatch: bool) -> Column:
    """The first of the keywords (by comma) that occurs in the text, in any case; else "other" or null."""
    out = F.lit("other") if mismatch else F.lit(None).cast("string")
    for k in reversed([k.strip() for k in keywords.split(",") if k.strip()]):
        out = F.when(F.rlike(c, F.lit("(?i)" + re.escape(k))), F.lit(k)).otherwise(out)
    return out


@command("data-trending")
def data_trending(t: Table, arg: dict) -> Table:
    """Counts, or sums of yColumns, by period (rows) and group (columns).

    periodAsDate makes months; periodKeywords and groupKeywords replace values by the keyword they hold (``mismatch``
    keeps the others as "other"); missingValue keeps rows with an empty period as "missing".
    """
    last = lambda k: t.index((arg[k] if isinstance(arg[k], list) else [arg[k]])[-1])
    p = last("period")
    period = V.text(t.col(p), t.types[p])
    if arg.get("periodAsDate"):
        period = F.date_format(t.col(p), "yyyy-MM") if t.types[p] in ("date", "timestamp", "timestamp_ntz") else _period(period)
    elif arg.get("periodKeywords"):
        period = _keyword(period, arg["periodKeywords"], bool(arg.get("mismatch")))
    empty = F.lit("missing") if arg.get("missingValue") else F.lit(None).cast("string")
    period = F.when(period.isNull() | (period == ""), empty).otherwise(period)
    group = F.lit("count")
    if arg.get("groupBy") is not None:
        g = last("groupBy")
        group = F.coalesce(V.text(t.col(g), t.types[g]), F.lit(""))
        if arg.get("groupKeywords"):
            group = _keyword(group, arg["groupKeywords"], bool(arg.get("mismatch")))
    y = None
    if arg.get("yColumns") is not None:
        i = last("yColumns")
        y = V.num(t.col(i), t.types[i]).cast("double")
    long = t.df.select(period.alias("period"), group.alias("g"), (y if y is not None else F.lit(1)).alias("y")).where("period is not null and g is not null")
    made = F.sum("y") if y is not None else F.count(F.lit(1))
    wide = long.groupBy("period").pivot("g", _distinct(long, F.col("g"))).agg(made).fillna(0)
    title = t.names[p]
    return _table(wide.withColumnRenamed("period", title), [title])


@command("addMissingRows")
def add_missing_rows(t: Table, arg: dict) -> Table:
    """Rows for the missing values of a sorted whole-number column.

    abscissa: {col, maxGap, minValue, maxValue, dense}; add: [{col, value | formula}] fills other columns of new rows
    (``cur_abscissa_val`` is the new value).  Between neighbours a < b with gap g come a + g and b - g where they fit, with
    ``dense`` every g-th value; rows outside the bounds are cut, the bounds themselves are filled in.
    """
    a = arg["abscissa"]
    i = t.index(a["col"])
    x = V.num(t.col(i), t.types[i]).cast("bigint")
    df = t.df.withColumn("_x", x)
    ends = df.agg(F.min_by("_x", ROW).alias("f"), F.max_by("_x", ROW).alias("l")).first()
    if ends["f"] is None:
        return t
    down = ends["f"] > ends["l"]
    lo, hi = a.get("minValue"), a.get("maxValue")
    if lo is not None:
        df = df.where(F.col("_x") >= int(lo))
    if hi is not None:
        df = df.where(F.col("_x") <= int(hi))
    w = Window.orderBy("_x", ROW)
    gap = a.get("maxGap")
    if gap is None:
        steps = df.orderBy(ROW).limit(10_000).select((F.lead("_x").over(w) - F.col("_x")).alias("d")).where("d > 0")
        mode = steps.groupBy("d").count().orderBy(F.desc("count"), "d").first()
        gap = max(1, 2 * mode["d"] - 1) if mode else 1
    gap = int(gap)
    points = df.select("_x").distinct()
    if lo is not None:
        points = points.unionAll(df.sparkSession.range(1).select(F.lit(int(lo) - gap).cast("bigint").alias("_x")))
    if hi is not None:
        points = points.unionAll(df.sparkSession.range(1).select(F.lit(int(hi) + gap).cast("bigint").alias("_x")))
    pairs = prefix.following(points.withColumnRenamed("_x", "a"), "a", "b").where(F.col("b") - F.col("a") > gap)
    first, final = F.col("a") + gap, F.col("b") - gap
    if a.get("dense"):
        # a wide gap is filled in blocks, so that no row holds all of its values
        block = gap * 100_000
        begins = pairs.where(first < F.col("b")).select(F.explode(F.sequence(first, F.col("b") - 1, F.lit(block).cast("bigint"))).alias("_s"), "b")
        made = begins.select(F.explode(F.sequence("_s", F.least(F.col("_s") + (block - gap), F.col("b") - 1), F.lit(gap).cast("bigint"))).alias("_x"))
    else:
        new = F.when(first > final, F.array().cast("array<bigint>")).when(first == final, F.array(first)).otherwise(F.array(first, final))
        made = pairs.select(F.explode(new).alias("_x"))
    if lo is not None:
        made = made.where(F.col("_x") >= int(lo))
    if hi is not None:
        made = made.where(F.col("_x") <= int(hi))
    fill = {}
    for item in arg.get("add", []):
        k = t.index(item["col"])
        if "formula" in item:
            c = Compiler(None)
            from ..functions.expr import Typed, parse

            fill[k] = c.run(parse(item["formula"]), {"cur_abscissa_val": Typed(F.col("_x"), "bigint")}).col
        else:
            fill[k] = F.lit(item.get("value"))
    kinds = t.types
    cols = [(F.col("_x") if k == i else fill.get(k, F.lit(None))).cast(kinds[k]).alias(f"c{k}") for k in range(len(kinds))]
    old = df.select(*[f"c{k}" for k in range(len(kinds))], "_x", F.lit(0).alias("_new"), F.col(ROW).alias("_o"))
    both = old.unionAll(made.select(*cols, "_x", F.lit(1).alias("_new"), F.lit(0).cast("bigint").alias("_o")))
    return renumbered(both, t.names, [F.desc("_x") if down else F.col("_x"), "_new", "_o"])


@command("collapsewithstat")
def collapse_with_stat(t: Table, arg: dict) -> Table:
    """For each prefix of colSet, mean and population deviation of every other number column over the rows of the prefix, on each row.

    New columns ``<name> <level>`` hold text mean±sd (six significant digits), or null for columns without numbers.
    """
    keys = t.indexes(arg["colSet"])
    if arg.get("formula") or arg.get("formulas"):
        fs = arg.get("formulas") or [arg["formula"]]
        t = sort_table(t, [Compiler(t).formula(str(f)) for f in fs])
    df, out = t.df, [(n, F.col(f"c{i}")) for i, n in enumerate(t.names)]
    numeric = [i for i in range(len(t.names)) if i not in keys and V.is_number(t.types[i])]
    for level in range(1, len(keys) + 1 if numeric else 1):
        # aggregated before they meet the rows: a key of few values would put a window of the whole table into few tasks
        aggs = []
        for i in numeric:
            x = F.col(f"c{i}").cast("double")
            pair = F.format_string("%s±%s", F.format_string("%.6g", F.avg(x)), F.format_string("%.6g", F.stddev_pop(x)))
            aggs.append(F.when(F.count(x) > 0, pair).alias(f"_s{level}_{i}"))
            out.append((f"{t.names[i]} {level}", F.col(f"_s{level}_{i}")))
        found = t.df.groupBy(*[F.col(f"c{k}").alias(f"_g{level}_{k}") for k in keys[:level]]).agg(*aggs)
        same = [F.col(f"c{k}").eqNullSafe(F.col(f"_g{level}_{k}")) for k in keys[:level]]
        df = df.join(found, reduce(lambda a, b: a & b, same), "left")
    return Table(df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(out)], ROW), tuple(n for n, _ in out), t.dense)


def collapse_rollup(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The same statistics once per prefix: a rollup with level, mean and sd of each column."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))]
    level = reduce(lambda a, b: a + b, [F.lit(1) - F.grouping(k) for k in keys])
    return df.rollup(*keys).agg(level.cast("int").alias("level"), F.count("*").alias("n"), *aggs).where("level > 0")


@command("bStat")
def b_stat(t: Table, arg: dict) -> Table:
    """P(value >= control * (1 + margin)) by category value, normalised over the values of its category.

    control: the cell of controlRow, else the mean over rowSet.  Rows: category, value, column, probability.
    """
    cats, cols = t.indexes(arg["categories"]), [i for i in t.indexes(arg.get("colSet")) if V.is_number(t.types[i])]
    used = _rows(t, arg.get("rowSet"))
    margin = 1 + float(arg.get("margin", 0))
    if arg.get("controlRow") is not None:
        n = t.numbered()
        control = n.where(F.col(ROW) == int(arg["controlRow"])).df.agg(*[F.max(_number(n, i)).alias(f"m{i}") for i in cols])
    else:
        control = used.df.agg(*[F.avg(_number(used, i)).alias(f"m{i}") for i in cols])
    m = control.first()
    total, parts = used.df.count(), None
    for c in cats:
        name = F.coalesce(V.text(used.col(c), used.types[c]), F.lit(""))
        hits = used.df.groupBy(name.alias("value")).agg(*[F.count_if(_number(used, i) >= (m[f"m{i}"] or 0) * margin).alias(f"h{i}") for i in cols])
        long = hits.select(F.lit(t.names[c]).alias("category"), "value", F.explode(F.array(*[F.struct(F.lit(t.names[i]).alias("column"), (F.col(f"h{i}") / max(total, 1)).alias("p")) for i in cols])).alias("x"))
        parts = long if parts is None else parts.unionAll(long)
    w = Window.partitionBy("category", "x.column")
    out = parts.select("category", "value", F.col("x.column").alias("column"), F.call_function("try_divide", F.col("x.p"), F.sum("x.p").over(w)).alias("probability"))
    return _table(out, ["category", "column", "value"])


@command("cleaner")
def cleaner(t: Table, arg: dict) -> Table:
    """Drops number columns (of colSet) whose deviation within some category is 0."""
    cats, cols = t.indexes(arg.get("categories", [])), [i for i in t.indexes(arg.get("colSet")) if V.is_number(t.types[i])]
    used, flat = _rows(t, arg.get("rowSet")), set()
    for c in [c for c in cats] or [None]:
        grouped = used.df.groupBy(*([used.col(c)] if c is not None else []))
        by = grouped.agg(*[F.stddev_pop(_number(used, i)).alias(f"s{i}") for i in cols])
        found = by.agg(*[F.bool_or(F.col(f"s{i}") == 0).alias(f"z{i}") for i in cols]).first()
        flat |= {i for i in cols if found[f"z{i}"]}
    return t.with_columns([c for i, c in enumerate(t.columns()) if i not in flat or i in cats])


def _mean_of(t: Table, cols: list[int]) -> Column:
    cells = F.filter(F.array(*[_number(t, i) for i in cols]), lambda v: v.isNotNull())
    return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda s, v: s + v) / F.size(cells))


@command("variance")
def variance(t: Table, arg: dict) -> Table:
    """Appends mean(A) - mean(B), and that divided by the mean of its absolute value over rowSet."""
    a, b = t.indexes(arg["colSetA"]), t.indexes(arg["colSetB"])
    used = _rows(t, arg.get("rowSet"))
    diff = lambda x: _mean_of(x, a) - _mean_of(x, b)
    scale = used.df.agg(F.avg(F.abs(diff(used))).alias("m")).first()["m"]
    ratio = diff(used) / F.lit(scale) if scale else F.lit(None).cast("double")
    return used.with_columns([*used.columns(), ("difference", diff(used)), ("relative", ratio)])


@command("fold_change")
def fold_change(t: Table, arg: dict) -> Table:
    """Signed ratio of two columns, with flags for a value that stands alone; rows below the threshold are dropped, then sorted by ratio."""
    i, j = t.index(arg["col_1"]), t.index(arg["col_2"])
    a, b = V.num(t.col(i), t.types[i]).cast("double"), V.num(t.col(j), t.types[j]).cast("double")
    low = float(arg.get("threshold", 0))
    ratio = F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(None)).when(a > b, F.call_function("try_divide", a, b)).otherwise(-F.call_function("try_divide", b, a))
    cols = [*t.columns(), ("fold_change", ratio), ("unique_1", (a != 0) & (b == 0)), ("unique_2", (a == 0) & (b != 0))]
    out = t.where((a >= low) & (b >= low)).with_columns(cols)
    k = len(t.names)
    return renumbered(out.df, out.names, [F.desc_nulls_last(f"c{k}"), ROW])


def beta_tail(x: Column, a: Column, b: Column):
    """The regularised incomplete beta I_x(a, b), by a continued fraction over Arrow batches."""
    @F.pandas_udf("double")
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([incomplete_beta(*v) for v in zip(x, a, b)])

    return run(x, a, b)


def incomplete_beta(x: float, a: float, b: float) -> float:
    if not (x == x and a > 0 and b > 0):
        return math.nan
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(500):  # Lentz
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = 1 + num / (c or tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


@command("statTest")
def stat_test(t: Table, arg: dict) -> Table:
    """Per row over two or more groups of columns: t (two groups) or F (one-way ANOVA), degrees, P and -log2 P.

    t uses the groups' own variances with n1 + n2 - 2 degrees.  foldChange: cells are first divided by the smaller group
    mean (0 counts as 0.01).  strict_reference: for two groups the confidence 1 - P is given as P.
    """
    groups = [t.indexes(arg[k]) for k in sorted(arg) if re.fullmatch(r"colSet\d+", k)]
    used = _rows(t, arg.get("rowSet"))
    cells = [F.filter(F.array(*[_number(used, i) for i in g]), lambda v: v.isNotNull()) for g in groups]
    df = used.df.select(*used.df.columns, *[c.alias(f"_g{k}") for k, c in enumerate(cells)])
    mean = lambda g: F.call_function("try_divide", F.aggregate(g, F.lit(0.0), lambda s, v: s + v), F.size(g))
    if arg.get("foldChange"):
        low = F.least(*[mean(F.col(f"_g{k}")) for k in range(len(groups))])
        df = df.withColumn("_low", F.when(low == 0, F.lit(0.01)).otherwise(low))
        for k in range(len(groups)):
            df = df.withColumn(f"_g{k}", F.transform(f"_g{k}", lambda v: v / F.col("_low")))
    for k in range(len(groups)):
        df = df.withColumn(f"_m{k}", mean(F.col(f"_g{k}"))).withColumn(f"_n{k}", F.size(f"_g{k}").cast("double"))
        df = df.withColumn(f"_s{k}", F.aggregate(f"_g{k}", F.lit(0.0), lambda s, v: s + (v - F.col(f"_m{k}")) * (v - F.col(f"_m{k}"))))
    if len(groups) == 2:
        var = [F.call_function("try_divide", F.col(f"_s{k}"), F.col(f"_n{k}") - 1) for k in range(2)]
        se = F.sqrt(var[0] / F.col("_n0") + var[1] / F.col("_n1"))
        df = df.withColumn("_stat", F.call_function("try_divide", F.col("_m0") - F.col("_m1"), se)).withColumn("_df", F.col("_n0") + F.col("_n1") - 2)
        p = beta_tail(F.col("_df") / (F.col("_df") + F.col("_stat") * F.col("_stat")), F.col("_df") / 2, F.lit(0.5))
        p = 1 - p if arg.get("strict_reference") else p
    else:
        n = reduce(lambda a, b: a + b, [F.col(f"_n{k}") for k in range(len(groups))])
        grand = reduce(lambda a, b: a + b, [F.col(f"_m{k}") * F.col(f"_n{k}") for k in range(len(groups))]) / n
        between = reduce(lambda a, b: a + b, [F.col(f"_n{k}") * (F.col(f"_m{k}") - grand) * (F.col(f"_m{k}") - grand) for k in range(len(groups))])
        within = reduce(lambda a, b: a + b, [F.col(f"_s{k}") for k in range(len(groups))])
        k1, k2 = F.lit(len(groups) - 1.0), n - len(groups)
        df = df.withColumn("_df", k2).withColumn("_stat", F.call_function("try_divide", between / k1, F.call_function("try_divide", within, k2)))
        p = beta_tail(k2 / (k2 + k1 * F.col("_stat")), k2 / 2, k1 / 2)
    df = df.withColumn("_p", p)
    k = len(used.names)
    names = (*used.names, "statistic", "degrees", "p_value", "neg_log2_p")
    extra = [F.col("_stat").alias(f"c{k}"), F.col("_df").alias(f"c{k + 1}"), F.col("_p").alias(f"c{k + 2}"), F.when(F.col("_p") > 0, -F.log2("_p")).alias(f"c{k + 3}")]
    return Table(df.select(*[f"c{i}" for i in range(k)], *extra, ROW), names)


@command("kaplanmeier")
def kaplan_meier(t: Table, arg: dict) -> Table:
    """Survival steps: duration, at risk, events, survival; starts at (0, 1).

    initEvents, finEvents, cenEvents: date columns.  A row counts if exactly one of final and censor date is there.
    days365: durations with years of 365 days.
    """
    a, f, c = (t.index(arg[k][0] if isinstance(arg[k], list) else arg[k]) for k in ("initEvents", "finEvents", "cenEvents"))
    day = lambda i: t.col(i).cast("date") if t.types[i] != "string" else t.col(i).try_cast("date")
    fin, cen, ini = day(f), day(c), day(a)
    end = F.coalesce(fin, cen)
    days = F.datediff(end, ini)
    if arg.get("days365"):
        flat = lambda d: F.year(d) * 365 + F.dayofyear(d)
        days = flat(end) - flat(ini)
    rows = t.df.where(ini.isNotNull() & (fin.isNull() != cen.isNull())).select(days.cast("bigint").alias("duration"), fin.isNotNull().alias("event"))
    return _table(survival_steps(rows), ["duration"])


def survival_steps(rows: DataFrame) -> DataFrame:
    """duration, at_risk, events, survival from rows of (duration, event); one row per distinct duration reaches the window."""
    by = rows.groupBy("duration").agg(F.count_if("event").alias("events"), F.count("*").alias("leaving"))
    w = Window.orderBy("duration")
    everyone = F.sum("leaving").over(Window.partitionBy())
    risk = by.select("duration", "events", "leaving", everyone.alias("n"), F.coalesce(F.sum("leaving").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gone"))
    risk = risk.withColumn("at_risk", F.col("n") - F.col("gone"))
    step = F.log((F.col("at_risk") - F.col("events")) / F.col("at_risk").cast("double"))
    dead = F.max(F.when(F.col("events") >= F.col("at_risk"), 1).otherwise(0)).over(w)
    alive = F.when(F.col("events") < F.col("at_risk"), step).otherwise(0.0)
    out = risk.select("duration", "at_risk", "events", F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(alive).over(w))).alias("survival")).where("events > 0")
    start = rows.agg(F.lit(0).cast("bigint").alias("duration"), F.count("*").alias("at_risk"), F.lit(0).cast("bigint").alias("events"), F.lit(1.0).alias("survival"))
    return start.unionAll(out)


_READING = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _reading(t: Table, i: int) -> tuple[Column, Column]:
    """Value and deviation of a cell like ``5.2 +/- 0.3``; null where it has none."""
    c = V.text(t.col(i), t.types[i])
    value, deviation = (F.regexp_extract(c, p, 1).try_cast("double") for p in (rf"^\s*({_READING})", rf"\+/-\s*({_READING})"))
    return value, deviation


def _turned(t: Table) -> Table:
    """Rows as columns, named by the first column; columns of numbers alone become doubles."""
    wide = transpose(t)
    body = range(1, len(wide.names))
    if not body:
        return wide
    odd = wide.df.agg(*[F.count_if(wide.col(i).isNotNull() & wide.col(i).try_cast("double").isNull()).alias(f"o{i}") for i in body]).first()
    numbers = [(wide.names[i], wide.col(i) if odd[f"o{i}"] else wide.col(i).try_cast("double")) for i in body]
    return wide.with_columns([wide.columns()[0], *numbers])


def _shown(df: DataFrame, order: list[Column], names: list[str]) -> Table:
    """``df`` in the order of its columns c0, c1, ... under ``names``, without the first."""
    out = renumbered(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), tuple(df.columns), order)
    return out.with_columns([(n, out.col(i + 1)) for i, n in enumerate(names)])


@command("pearsonCorr")
def pearson(t: Table, arg: dict) -> Table:
    """Pairs of columns of colSet1 and colSet2: x, y, r, slope, intercept, n and, with cellHasStdev, confidence.

    Sums run over rows where both are numbers; the means are each column's own over all its numbers, and over all rows,
    empty cells as 0, with imputeZeroForEmptyCellColSet1 or 2 (strict_reference: the latter is ignored).  No variance: 0.
    ``output``: pairs; matrix, a row for each column of colSet1 with its r to those of colSet2 (1 to itself); best, each
    pair of different columns once, by falling absolute r.  doTranspose correlates rows, named by the first column.
    Cells with a deviation (``5.2 +/- 0.3``) give a confidence: the fitted rise from the least to the largest x by
    twice the sum of y's deviations there (ties: the first row), null where one is missing.  An empty table gives r 0.
    """
    spread, strict, output = bool(arg.get("cellHasStdev")), bool(arg.get("strict_reference")), arg.get("output", "pairs")
    if output not in ("pairs", "matrix", "best"):
        raise PlanError(f"no output {output!r}; there are pairs, matrix and best")
    used = _rows(t, arg.get("rowSet"))
    if arg.get("doTranspose"):
        used = transpose(used) if spread else _turned(used)
    first = list(range(1, len(used.names))) if spread else None
    columns = lambda spec: [i for i in used.indexes(first if spec is None else spec) if spread or V.is_number(used.types[i])]
    cols1, cols2 = columns(arg.get("colSet1")), columns(arg.get("colSet2", arg.get("colSet1")))
    if not cols1 or not cols2:
        raise PlanError("no columns of numbers to correlate")
    read = {i: _reading(used, i) if spread else (_number(used, i), None) for i in {*cols1, *cols2}}
    means = used.df.agg(F.count("*").alias("rows"), *[a for i, (c, _) in read.items() for a in (F.avg(c).alias(f"m{i}"), F.sum(c).alias(f"s{i}"))]).first()
    own = lambda i, impute: ((means[f"s{i}"] or 0.0) / max(means["rows"], 1) if impute else means[f"m{i}"]) or 0.0
    mean1 = {i: own(i, arg.get("imputeZeroForEmptyCellColSet1")) for i in cols1}
    mean2 = {j: own(j, arg.get("imputeZeroForEmptyCellColSet2") and not strict) for j in cols2}
    aggs = []
    for i in cols1:
        for j in cols2:
            (x, _), (y, dev) = read[i], read[j]
            both = x.isNotNull() & y.isNotNull()
            a, b = x - F.lit(mean1[i]), y - F.lit(mean2[j])
            aggs += [F.sum(F.when(both, a * b)).alias(f"ab{i}_{j}"), F.sum(F.when(both, a * a)).alias(f"aa{i}_{j}"), F.sum(F.when(both, b * b)).alias(f"bb{i}_{j}"), F.count_if(both).alias(f"n{i}_{j}")]
            if spread:
                ends = F.min(F.when(both, F.struct(x.alias("x"), F.col(ROW), dev.alias("d")))), F.min(F.when(both, F.struct((-x).alias("x"), F.col(ROW), dev.alias("d"))))
                aggs += [c.alias(f"{n}{i}_{j}") for n, c in zip(("lo", "hi"), ends)]
    sums, found = used.df.agg(*aggs), {}
    for i in cols1:
        for j in cols2:
            ab, aa, bb = (F.col(f"{s}{i}_{j}") for s in ("ab", "aa", "bb"))
            flat = (F.coalesce(aa, F.lit(0.0)) == 0) | (F.coalesce(bb, F.lit(0.0)) == 0)
            r = F.when(flat, 0.0).otherwise(F.call_function("try_divide", ab, F.sqrt(aa) * F.sqrt(bb)))
            slope = F.when(flat, 0.0).otherwise(F.call_function("try_divide", ab, aa))
            fields = [F.lit(used.names[i]).alias("x"), F.lit(used.names[j]).alias("y"), r.alias("r"), slope.alias("slope"), (F.lit(mean2[j]) - slope * F.lit(mean1[i])).alias("intercept"), F.col(f"n{i}_{j}").alias("n")]
            if spread:
                lo, hi = F.col(f"lo{i}_{j}"), F.col(f"hi{i}_{j}")
                fields.append(F.call_function("try_divide", F.abs(slope * (-hi["x"] - lo["x"])), 2 * (lo["d"] + hi["d"])).alias("confidence"))
            found[i, j] = r, fields
    if output == "matrix":
        lines = [F.struct(F.lit(k).alias("pos"), F.lit(used.names[i]).alias("x"), *[(F.lit(1.0) if i == j else found[i, j][0]).alias(f"v{n}") for n, j in enumerate(cols2)]) for k, i in enumerate(cols1)]
        return _shown(sums.select(F.inline(F.array(*lines))), [F.col("c0")], ["column", *[used.names[j] for j in cols2]])
    if output == "pairs":
        return _table(sums.select(F.inline(F.array(*[F.struct(*fields) for _, fields in found.values()]))), ["x", "y"])
    wide = len(cols1) >= len(cols2)
    once = [found[i, j][1] for a, i in enumerate(cols1) for b, j in enumerate(cols2) if i != j and (a >= b if wide else a <= b)]
    if not once:
        raise PlanError("no two different columns to correlate")
    names = ["x", "y", "r", "slope", "intercept", "n", *(["confidence"] if spread else [])]
    lines = [F.struct(F.lit(k).alias("pos"), *fields) for k, fields in enumerate(once)]
    return _shown(sums.select(F.inline(F.array(*lines))), [F.desc(F.abs("c3")), F.col("c0")], names)


#: Categories that are broadcast at most; rows from which on one is broadcast among more.
CATEGORIES, HEAVY = 100_000, 100_000


def _category_means(t: Table, cats: list[int], used: list[int], strict: bool) -> Table:
    """Cells of ``used`` that are missing or over two deviations from the mean of their row's category become that mean.

    Rows meet an aggregate of their category without being shuffled: up to CATEGORIES of them are broadcast.  Beyond, those of
    more than HEAVY rows are, and rows of the others meet theirs by key, so no task holds a large category.
    """
    keys = [F.coalesce(V.text(t.col(i), t.types[i]), F.lit("")).alias(f"_k{i}") for i in cats]
    x = {i: _number(t, i) for i in used}
    aggs = [a for i in used for a in (F.avg(x[i]).alias(f"_m{i}"), (F.sqrt(F.sum(x[i] * x[i])) if strict else F.stddev_pop(x[i])).alias(f"_s{i}"))]
    by = materialize(t.df.groupBy(*keys).agg(*aggs, F.count("*").alias("_n")))
    names, rows = [f"_k{i}" for i in cats], t.df.select("*", *keys)
    if by.count() <= CATEGORIES:
        met = rows.join(F.broadcast(by), names)
    else:
        heavy = F.broadcast(by.where(F.col("_n") > HEAVY))
        met = rows.join(heavy, names).unionByName(rows.join(heavy.select(*names), names, "left_anti").join(by, names))
    both = Table(met, t.names)
    cols = both.columns()
    for i in used:
        v, m, s = _number(both, i), F.col(f"_m{i}"), F.col(f"_s{i}")
        far = F.abs(v) > F.abs(m - 2 * s) if strict else F.abs(v - m) > 2 * s
        cols[i] = (t.names[i], F.when(v.isNull() | far, m).otherwise(v))
    return both.with_columns(cols)


@command("dataCalib")
def data_calib(t: Table, arg: dict) -> Table:
    """Merges columns of one name (redundencyWay 1 mean, 2 median), replaces outliers beyond sigmaOutliers deviations by
    the mean, subtracts the baseline of calibrationCols, normalises (1 share of the sum, 2 by the root of squares, 3 min-max).

    ``translate`` turns rows into columns first, so that rows of one name merge.  With categoryCols nothing else is done
    than replacing missing cells and outliers of calibrationCols (all columns of numbers) by the mean of their category.
    strict_reference: outlier deviation sqrt(sum of squares), and normalising sums run on from column to column.
    """
    if arg.get("translate"):
        t = _turned(t)
    if arg.get("categoryCols"):
        cats = t.indexes(arg["categoryCols"])
        used = [i for i in t.indexes(arg.get("calibrationCols")) if V.is_number(t.types[i]) and i not in cats]
        return _category_means(t, cats, used, bool(arg.get("strict_reference")))
    if arg.get("redundencyWay"):
        cols, seen = [], set()
        for i, n in enumerate(t.names):
            same = [j for j, m in enumerate(t.names) if m == n]
            if n in seen:
                continue
            seen.add(n)
            if len(same) > 1 and all(V.is_number(t.types[j]) for j in same):
                cells = F.array_sort(F.filter(F.array(*[_number(t, j) for j in same]), lambda v: v.isNotNull()))
                k = F.size(cells)
                mid = (F.try_element_at(cells, F.floor((k + 1) / 2).cast("int")) + F.try_element_at(cells, F.floor(k / 2 + 1).cast("int"))) / 2
                cols.append((n, F.when(k > 0, _mean_of(t, same) if int(arg["redundencyWay"]) == 1 else mid)))
            else:
                cols.append((n, t.col(i)))
        t = t.with_columns(cols)
    strict, number = bool(arg.get("strict_reference")), lambda spec: [i for i in t.indexes(spec) if V.is_number(t.types[i])]
    if arg.get("sigmaOutliers"):
        cols, used = t.columns(), number(arg.get("normalizeCols"))
        aggs = [x for i in used for x in (F.avg(_number(t, i)).alias(f"m{i}"), (F.sqrt(F.sum(F.pow(_number(t, i), 2))) if strict else F.stddev_pop(_number(t, i))).alias(f"s{i}"))]
        s = t.df.agg(*aggs).first()
        for i in used:
            far = F.abs(_number(t, i) - F.lit(s[f"m{i}"])) > F.lit(s[f"s{i}"]) * float(arg["sigmaOutliers"])
            cols[i] = (t.names[i], F.when(far, F.lit(s[f"m{i}"])).otherwise(_number(t, i)))
        t = t.with_columns(cols)
    if arg.get("calibrationCols"):
        base, cols = _mean_of(t, number(arg["calibrationCols"])), t.columns()
        for i in number(arg.get("normalizeCols")):
            cols[i] = (t.names[i], _number(t, i) - base)
        t = t.with_columns(cols)
    if arg.get("normalize"):
        way, used, cols = int(arg["normalize"]), number(arg.get("normalizeCols")), t.columns()
        aggs = [x for i in used for x in (F.sum(_number(t, i)).alias(f"a{i}"), F.sum(F.pow(_number(t, i), 2)).alias(f"q{i}"), F.min(_number(t, i)).alias(f"l{i}"), F.max(_number(t, i)).alias(f"h{i}"))]
        s, total, square = t.df.agg(*aggs).first(), 0.0, 0.0
        lo, hi = None, None
        for i in used:
            total = (total if strict else 0.0) + (s[f"a{i}"] or 0.0)
            square = (square if strict else 0.0) + (s[f"q{i}"] or 0.0)
            lo = s[f"l{i}"] if not strict or lo is None else min(lo, s[f"l{i}"])
            hi = s[f"h{i}"] if not strict or hi is None else max(hi, s[f"h{i}"])
            x = _number(t, i)
            made = {1: lambda: x / total if total else F.lit(None), 2: lambda: x / math.sqrt(square) if square else F.lit(None), 3: lambda: (x - lo) / (hi - lo) if hi != lo else F.lit(0.0)}[way]()
            cols[i] = (t.names[i], made.cast("double"))
        t = t.with_columns(cols)
    return t


@command("compAnalysis")
def comp_analysis(t: Table, arg: dict) -> Table:
    """Mutations whose frequency rose by more than ``delta`` from the baseline visit, called by at least algoToReport callers.

    Columns by name: USUBJID, AAPOS, VARDECT (caller), VISIT, AAREF, AASUB, AAFREQ; ``baseline`` names the baseline visit.
    """
    c = {n: t.col(t.index(n)) for n in ("USUBJID", "AAPOS", "VARDECT", "VISIT", "AAREF", "AASUB", "AAFREQ")}
    df = t.df.select(*[x.alias(n) for n, x in c.items()])
    key, first = ["USUBJID", "AAPOS", "AAREF", "AASUB", "VARDECT"], arg.get("baseline", "BASELINE")
    at = F.upper("VISIT") == first.upper()
    freq = F.col("AAFREQ").cast("double")
    base = df.where(at).groupBy(*key).agg(F.max(freq).alias("base"))
    later = df.where(~at).groupBy(*key, "VISIT").agg(F.max(freq).alias("freq"))
    rise = later.join(base, key, "left").where(F.col("freq") - F.coalesce("base", F.lit(0.0)) > float(arg.get("delta", 0.1)))
    out = rise.groupBy("USUBJID", "AAPOS", "AAREF", "AASUB", "VISIT").agg(F.count_distinct("VARDECT").alias("callers"), F.max("freq").alias("frequency"), F.max(F.coalesce("base", F.lit(0.0))).alias("baseline"))
    return _table(out.where(F.col("callers") >= int(arg.get("algoToReport", 1))), ["USUBJID", "AAPOS", "AASUB", "VISIT"])


@command("sdtm_summary")
def sdtm_summary(t: Table, arg: dict) -> Table:
    """Lab tests by study: patients, share without a base value, share whose base value is normal, low and high.

    Columns by name: STUDYID, LBTEST, USUBJID, LBBLFL (Y marks the baseline), LBSTRESN, LBSTNRLO, LBSTNRHI.
    """
    c = {n: t.col(t.index(n)) for n in ("STUDYID", "LBTEST", "USUBJID", "LBBLFL", "LBSTRESN", "LBSTNRLO", "LBSTNRHI")}
    df = t.df.select(*[x.alias(n) for n, x in c.items()])
    v = F.when(F.col("LBBLFL") == "Y", F.col("LBSTRESN").cast("double"))
    one = df.groupBy("STUDYID", "LBTEST", "USUBJID").agg(F.max(v).alias("v"), F.max(F.col("LBSTNRLO").cast("double")).alias("lo"), F.max(F.col("LBSTNRHI").cast("double")).alias("hi"))
    n = F.count("*")
    share = lambda x: (100.0 * F.count_if(x) / n)
    out = one.groupBy("STUDYID", "LBTEST").agg(n.alias("patients"), share(F.col("v").isNull()).alias("missing_pct"), share(F.col("v").between(F.col("lo"), F.col("hi"))).alias("normal_pct"), share(F.col("v") < F.col("lo")).alias("low_pct"), share(F.col("v") > F.col("hi")).alias("high_pct"))
    return _table(out, ["STUDYID", "LBTEST"])


@command("generic-cmd-test")
def generic(t: Table, arg: dict) -> Table:
    """Adds ``Sum`` of the chosen columns; cells that are no number are left out.  A Python table function over Arrow batches."""
    cols = t.indexes(arg.get("cols"))
    names, k = [f"c{i}" for i in cols], len(t.names)

    def run(batches):
        for b in batches:
            b[f"c{k}"] = sum((pd.to_numeric(b[n], errors="coerce").fillna(0.0) for n in names), 0.0)
            yield b

    schema = T.StructType([*t.df.schema.fields, T.StructField(f"c{k}", T.DoubleType())])
    return Table(t.df.mapInPandas(run, schema), (*t.names, "Sum"))
