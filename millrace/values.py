"""Value semantics shared by formulas, filters and sorts: coercions, nullish equality, truth, safe division.

All are Column -> Column without UDFs, so Catalyst can fold, prune and push them down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def is_number(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def is_int(dtype: str) -> bool:
    return dtype in ("tinyint", "smallint", "int", "bigint", "boolean")


def num(c: Column, dtype: str) -> Column:
    """A number: text that is none, and null, count as 0."""
    if is_int(dtype):
        return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    if is_number(dtype):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return F.coalesce(F.unix_timestamp(c.cast("timestamp")), F.lit(0)).cast("bigint")
    if dtype == "void":
        return F.lit(0).cast("bigint")
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def maybe_num(c: Column, dtype: str) -> Column:
    """A double, or null where the value is no number."""
    return c.cast("double") if is_number(dtype) else num(c, dtype).cast("double") if dtype in ("timestamp", "timestamp_ntz", "date") else c.try_cast("double")


def text(c: Column, dtype: str) -> Column:
    """The printed form."""
    if dtype == "boolean":
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if dtype.startswith(("array", "map", "struct")):
        return F.to_json(c)
    return c.cast("string")


def nullish(c: Column, dtype: str) -> Column:
    """What equals null: null, 0, "" and empty lists."""
    if dtype == "void":
        return F.lit(True)
    if is_number(dtype):
        return c.isNull() | (c.cast("double") == 0)
    if dtype == "string":
        return c.isNull() | (c == "")
    if dtype.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def truthy(c: Column, dtype: str) -> Column:
    """Two-valued truth: of texts only null, "", "0", false, off and cancel are false; NaN is false."""
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype == "void":
        return F.lit(False)
    if is_number(dtype):
        d = c.cast("double")
        return F.coalesce((d != 0) & ~F.isnan(d), F.lit(False))
    if dtype == "string":
        return F.coalesce(~F.lower(c).isin("", "0", "false", "off", "cancel"), F.lit(False))
    if dtype.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def equal(a: Column, ta: str, b: Column, tb: str) -> Column:
    """Loose equality, never unknown: null equals what is nullish; numbers compare as numbers, mixed types as text."""
    if ta == "void":
        return nullish(b, tb)
    if tb == "void":
        return nullish(a, ta)
    if is_number(ta) and is_number(tb):
        same = a.cast("double") == b.cast("double") if not (is_int(ta) and is_int(tb)) else a.cast("bigint") == b.cast("bigint")
    elif ta == tb:
        same = a == b
    else:
        same = text(a, ta) == text(b, tb)
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull(), nullish(b, tb)).when(b.isNull(), nullish(a, ta)).otherwise(same)


def compare(a: Column, ta: str, b: Column, tb: str, op: str) -> Column:
    """<, >, <=, >= without unknowns: numbers as numbers, else as text; null counts as 0 or ""."""
    if is_number(ta) and is_number(tb) or (is_number(ta) and tb == "void") or (ta == "void" and is_number(tb)):
        x, y = num(a, ta), num(b, tb)
    elif ta == tb and ta in ("date", "timestamp", "timestamp_ntz"):
        x, y = a, b
    else:
        x, y = F.coalesce(text(a, ta), F.lit("")), F.coalesce(text(b, tb), F.lit(""))
    done = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return F.coalesce(done, F.lit(False))


def divide(a: Column, ta: str, b: Column, tb: str) -> tuple[Column, str]:
    """Whole numbers divide to a whole number, towards zero; by zero, to a signed infinity (then all are doubles)."""
    x, y = num(a, ta), num(b, tb)
    inf = F.when(x.cast("double") < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    if is_int(ta) and is_int(tb):
        q = F.call_function("div", x, F.nullif(y, F.lit(0)))  # exact; a quotient of doubles is not beyond 2^53
        return F.when(y == 0, inf).when(y == -1, F.lit(0.0) - x.cast("double")).otherwise(q.cast("double")), "double"
    return F.when(y.cast("double") == 0, inf).otherwise(F.call_function("try_divide", x.cast("double"), y.cast("double"))), "double"


def sort_keys(c: Column, dtype: str) -> list[Column]:
    """Ascending keys of the mixed order: non-empty text (by lower case; null as "0"), then numbers and dates, then empty text."""
    if dtype == "string":
        t = F.lower(F.coalesce(c, F.lit("0")))
        return [F.when(t == "", 2).otherwise(0), t]
    if is_number(dtype) or dtype in ("date", "timestamp", "timestamp_ntz"):
        return [F.when(c.isNull(), 0).otherwise(1), c]
    t = F.lower(F.coalesce(text(c, dtype), F.lit("0")))
    return [F.lit(0), t]
