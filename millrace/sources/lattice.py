"""Types of text columns from all their values: a fold over a lattice, so no value is lost.

Nothing fits every type; whole numbers widen to reals, dates or times of day and date; any other mixture is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT, REAL, BOOL, DATE, STAMP, TEXT, LONG = (1 << k for k in range(7))
_SHORT = r"^[+-]?\d{1,9}$"
WHOLE = r"^[+-]?\d{1,18}$"
_NUMBER = r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?$"
_DATE, _STAMP = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def kind(c: Column) -> Column:
    """The type of one value as a bit; 0 for null and empty ones."""
    return (
        F.when(c.isNull() | (c == ""), 0).when(c.rlike(_SHORT), INT).when(c.rlike(WHOLE), LONG).when(c.rlike(_NUMBER), REAL).when(F.lower(c).isin("true", "false"), BOOL)
        .when(c.rlike(_DATE) & c.try_cast("date").isNotNull(), DATE).when(c.rlike(_STAMP) & c.try_cast("timestamp").isNotNull(), STAMP).otherwise(TEXT)
    )


def merged(bits: int) -> str:
    """The least type that holds all kinds of ``bits``."""
    if bits == INT:
        return "int"
    if bits & LONG:
        bits = bits & ~LONG | INT
        if bits == INT:
            return "bigint"
    if bits in (REAL, INT | REAL):
        return "double"
    if bits == BOOL:
        return "boolean"
    if bits in (DATE, DATE | INT):
        return "date"
    if bits & STAMP and not bits & ~(STAMP | DATE | INT):
        return "timestamp"
    return "string"


def types(df: DataFrame) -> list[str]:
    """The type of every (text) column of ``df``, from all rows in one aggregate."""
    if not df.columns:
        return []
    bits = df.agg(*[F.bit_or(kind(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return [merged(int(b or 0)) for b in bits]


def typed(c: Column, to: str) -> Column:
    """A text column as ``to``: empty is null, a whole number among dates is seconds since 1970."""
    if to == "string":
        return c
    whole = F.timestamp_seconds(c.try_cast("bigint"))
    return F.when(c.rlike(WHOLE), whole.cast(to)).otherwise(c.try_cast(to)) if to in ("date", "timestamp") else c.try_cast(to)


def strict(name: str, c: Column, to: str) -> Column:
    """``typed`` that raises where a value doesn't fit."""
    if to == "string":
        return c
    out = typed(c, to)
    return F.when(c.isNotNull() & (c != "") & out.isNull(), F.raise_error(F.concat(F.lit(f"column {name}: not {to}: "), c)).cast(to)).otherwise(out)


def widened(df: DataFrame, sample: DataFrame | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (text columns) with the types of all its values; with ``sample``, of its values, and a later misfit raises.

    Columns named in ``texts`` stay as they are.
    """
    open_ = [c for c in df.columns if c not in texts]
    kinds = dict(zip(open_, types((df if sample is None else sample).select(*[f"`{c}`" for c in open_]))))
    cells = [(c, F.col(f"`{c}`"), kinds.get(c, "string")) for c in df.columns]
    return df.select(*[(typed(x, k) if sample is None else strict(c, x, k)).alias(c) for c, x, k in cells])
