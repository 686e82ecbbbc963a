"""The built-in functions of the expression language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..table import ROW, PlanError
from .expr import Compiler, Lambda, Typed, element_of, literal, recast, to_text, value_of, wider

FUNCTIONS: dict[str, object] = {}

#: Amino acids by three letters and one.
AMINO = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L",
    "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}
#: strftime codes and Spark's patterns.
DATE_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "%": "%"}


def function(*names: str):
    def keep(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return keep


def once(x: Column, f) -> Column:
    """f(x), with x computed once: an expression inside a lambda is computed again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def double(x: Typed) -> Column:
    return V.num(x.col, x.dtype).cast("double")


def _real(name: str, make) -> None:
    FUNCTIONS[name] = lambda c, a: Typed(make(*[double(x) for x in a]), "double")


_real("exp", F.exp)
_real("sqrt", lambda x: F.when(x >= 0, F.sqrt(x)))
_real("pow", F.pow)
_real("log", lambda x: F.when(x > 0, F.ln(x)))
_real("log2", lambda x: F.when(x > 0, F.log2(x)))
_real("log10", lambda x: F.when(x > 0, F.log10(x)))


@function("abs")
def _abs(c: Compiler, a: list) -> Typed:
    x = V.num(a[0].col, a[0].dtype)
    return Typed(F.abs(x), "bigint" if V.is_int(a[0].dtype) else "double")


@function("ceil")
def _ceil(c: Compiler, a: list) -> Typed:
    return Typed(F.ceil(double(a[0])).cast("bigint"), "bigint")


@function("floor")
def _floor(c: Compiler, a: list) -> Typed:
    return Typed(F.floor(double(a[0])).cast("bigint"), "bigint")


@function("clamp")
def _clamp(c: Compiler, a: list) -> Typed:
    return Typed(F.least(F.greatest(double(a[0]), double(a[1])), double(a[2])), "double")


def as_list(a: list) -> Typed:
    """The one list given, or the arguments as a list."""
    if len(a) == 1 and a[0].dtype.startswith("array"):
        return a[0]
    kind = wider([x.dtype for x in a])
    return Typed(F.array(*[recast(x, kind) for x in a]), f"array<{kind}>")


def numbers(x: Typed) -> Column:
    e = element_of(x.dtype)
    return F.filter(F.transform(x.col, lambda v: V.maybe_num(v, e)), lambda v: v.isNotNull())


@function("sum")
def _sum(c: Compiler, a: list) -> Typed:
    return Typed(F.aggregate(numbers(as_list(a)), F.lit(0.0), lambda s, v: s + v), "double")


@function("mean")
def _mean(c: Compiler, a: list) -> Typed:
    mean = lambda n: F.when(F.size(n) > 0, F.aggregate(n, F.lit(0.0), lambda s, v: s + v) / F.size(n))
    return Typed(once(numbers(as_list(a)), mean), "double")


@function("min")
def _min(c: Compiler, a: list) -> Typed:
    return Typed(F.array_min(numbers(as_list(a))), "double")


@function("max")
def _max(c: Compiler, a: list) -> Typed:
    return Typed(F.array_max(numbers(as_list(a))), "double")


@function("dim")
def _dim(c: Compiler, a: list) -> Typed:
    x = a[0]
    n = F.size(x.col) if x.dtype.startswith(("array", "map")) else F.length(F.coalesce(to_text(x), F.lit("")))
    return Typed(F.coalesce(n, F.lit(0)).cast("bigint"), "bigint")


@function("append", "push")
def _append(c: Compiler, a: list) -> Typed:
    e = wider([element_of(a[0].dtype), *[x.dtype for x in a[1:]]])
    return Typed(F.concat(a[0].col.cast(f"array<{e}>"), F.array(*[recast(x, e) for x in a[1:]])), f"array<{e}>")


def _lambda_of(a: list, k: int = 1) -> Lambda:
    if len(a) <= k or not isinstance(a[k], Lambda):
        raise PlanError("a function(x){...} is needed here")
    return a[k]


def _mapped(c: Compiler, a: list) -> Typed:
    f, e, made = _lambda_of(a), element_of(a[0].dtype), []

    def one(v: Column) -> Column:
        made.append(c.apply(f, [Typed(v, e)]))
        return made[-1].col

    out = F.transform(a[0].col, one)
    return Typed(out, f"array<{made[0].dtype}>")


for _n in ("map", "apply", "foreach"):
    FUNCTIONS[_n] = _mapped


@function("filter")
def _filter(c: Compiler, a: list) -> Typed:
    f, e = _lambda_of(a), element_of(a[0].dtype)

    def keep(v: Column) -> Column:
        x = c.apply(f, [Typed(v, e)])
        return V.truthy(x.col, x.dtype)

    return Typed(F.filter(a[0].col, keep), a[0].dtype)


@function("reduce")
def _reduce(c: Compiler, a: list) -> Typed:
    """list.reduce(f[, start]): without a start, the first element is it."""
    f, e = _lambda_of(a), element_of(a[0].dtype)
    kind = "double" if V.is_number(e) else e
    cells = a[0].col.cast(f"array<{kind}>")
    start = recast(a[2], kind) if len(a) > 2 else F.try_element_at(cells, F.lit(1))
    rest = cells if len(a) > 2 else F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    step = lambda s, v: recast(c.apply(f, [Typed(s, kind), Typed(v, kind)]), kind)
    return Typed(F.aggregate(rest, start.cast(kind), step), kind)


@function("range")
def _range(c: Compiler, a: list) -> Typed:
    """range(end), range(start, end[, step]); the end is left out."""
    n = [V.num(x.col, x.dtype).cast("bigint") for x in a]
    low, high = (F.lit(0).cast("bigint"), n[0]) if len(n) == 1 else (n[0], n[1])
    step = n[2] if len(n) > 2 else F.lit(1).cast("bigint")
    some = F.when(step > 0, high > low).when(step < 0, high < low).otherwise(F.lit(False))
    last = F.when(step > 0, high - 1).otherwise(high + 1)
    return Typed(F.when(some, F.sequence(low, F.when(some, last).otherwise(low), F.when(some, step).otherwise(F.lit(1).cast("bigint")))).otherwise(F.array().cast("array<bigint>")), "array<bigint>")


@function("sort")
def _sort(c: Compiler, a: list) -> Typed:
    if len(a) > 1:
        f, e = _lambda_of(a), element_of(a[0].dtype)
        order = lambda x, y: V.num((r := c.apply(f, [Typed(x, e), Typed(y, e)])).col, r.dtype).cast("int")
        return Typed(F.array_sort(a[0].col, order), a[0].dtype)
    return Typed(F.array_sort(a[0].col), a[0].dtype)


@function("strsort")
def _strsort(c: Compiler, a: list) -> Typed:
    e = element_of(a[0].dtype)
    return Typed(F.array_sort(F.transform(a[0].col, lambda v: V.text(v, e))), "array<string>")


def _same_lists(a: list) -> tuple[list[Column], str]:
    kinds = [element_of(x.dtype) for x in a]
    kind = kinds[0] if len(set(kinds)) == 1 else wider(kinds)
    return [x.col.cast(f"array<{kind}>") for x in a], kind


@function("union")
def _union(c: Compiler, a: list) -> Typed:
    cols, kind = _same_lists(a)
    out = F.array_distinct(cols[0])
    for x in cols[1:]:
        out = F.array_union(out, x)
    return Typed(out, f"array<{kind}>")


@function("intersect")
def _intersect(c: Compiler, a: list) -> Typed:
    cols, kind = _same_lists(a)
    out = F.array_distinct(cols[0])
    for x in cols[1:]:
        out = F.array_intersect(out, x)
    return Typed(out, f"array<{kind}>")


@function("keys")
def _keys(c: Compiler, a: list) -> Typed:
    return Typed(F.array_sort(F.map_keys(a[0].col)), "array<string>")


@function("kv")
def _kv(c: Compiler, a: list) -> Typed:
    v = value_of(a[0].dtype)
    pairs = F.array_sort(F.map_entries(a[0].col))
    return Typed(F.transform(pairs, lambda p: F.array(p["key"], V.text(p["value"], v))), "array<array<string>>")


@function("dic")
def _dic(c: Compiler, a: list) -> Typed:
    """A list of [key, value] pairs as a dictionary; the last of a key wins."""
    e = element_of(element_of(a[0].dtype))
    key = lambda p: V.text(F.try_element_at(p, F.lit(1)), e)
    last = lambda pairs, k: F.element_at(F.filter(pairs, lambda p: key(p) == k), -1)
    made = lambda pairs: once(F.array_distinct(F.transform(pairs, key)), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(last(pairs, k), F.lit(2)))))
    return Typed(once(a[0].col, made), f"map<string,{e}>")


@function("counts")
def _counts(c: Compiler, a: list) -> Typed:
    """value -> how often; with a function, of its results."""
    x = _mapped(c, a) if len(a) > 1 else a[0]
    e = element_of(x.dtype)
    cells = F.transform(x.col, lambda v: F.coalesce(V.text(v, e), F.lit("")))
    many = lambda cells, k: F.size(F.filter(cells, lambda v: v == k)).cast("bigint")
    made = lambda cells: once(F.array_sort(F.array_distinct(cells)), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: many(cells, k))))
    return Typed(once(cells, made), "map<string,bigint>")


@function("histogram")
def _histogram(c: Compiler, a: list) -> Typed:
    """list.histogram(n[, min, max]): equal bins; the maximum is in the last; others outside drop; bad bounds give the data's."""
    k = V.num(a[1].col, a[1].dtype).cast("int")

    def bounds(n: Column) -> Column:
        low, high = F.array_min(n), F.array_max(n)
        if len(a) > 3:
            x, y = double(a[2]), double(a[3])
            low, high = F.when(x < y, x).otherwise(low), F.when(x < y, y).otherwise(high)
        return F.struct(n.alias("n"), low.alias("low"), high.alias("high"), ((high - low) / k).alias("width"), k.alias("k"))

    def bins(s: Column) -> Column:
        bin_of = lambda v: F.when((v < s["low"]) | (v > s["high"]), -1).when(s["width"] == 0, 0).otherwise(F.least(F.floor((v - s["low"]) / s["width"]).cast("int"), s["k"] - 1))
        return F.transform(s["n"], bin_of)

    made = lambda of: F.transform(F.sequence(F.lit(0), k - 1), lambda b: F.size(F.filter(of, lambda v: v == b)).cast("bigint"))
    return Typed(once(once(once(numbers(a[0]), bounds), bins), made), "array<bigint>")


@function("cat")
def _cat(c: Compiler, a: list) -> Typed:
    return Typed(F.concat(*[F.coalesce(to_text(x), F.lit("")) for x in a]), "string")


@function("join")
def _join(c: Compiler, a: list) -> Typed:
    """list.join(separator)"""
    listed, sep = (a[0], a[1]) if a[0].dtype.startswith("array") else (a[1], a[0])
    e = element_of(listed.dtype)
    return Typed(F.array_join(F.transform(listed.col, lambda v: F.coalesce(V.text(v, e), F.lit(""))), str(sep.const)), "string")


@function("split")
def _split(c: Compiler, a: list) -> Typed:
    """text.split(separator, ...): any of them; "" cuts at every character."""
    import re

    seps = [s for x in a[1:] for s in (x.const if isinstance(x.const, list) else [x.const])]
    s = F.coalesce(to_text(a[0]), F.lit(""))
    if "" in seps:
        return Typed(F.filter(F.split(s, ""), lambda v: v != ""), "array<string>")
    return Typed(F.split(s, "|".join(re.escape(str(x)) for x in seps), -1), "array<string>")


@function("strip")
def _strip(c: Compiler, a: list) -> Typed:
    return Typed(F.btrim(F.coalesce(to_text(a[0]), F.lit("")), F.lit(" \t\r\n")), "string")


def pattern_of(codes: str) -> str:
    out, i = "", 0
    while i < len(codes):
        if codes[i] == "%" and i + 1 < len(codes):
            if codes[i + 1] not in DATE_CODES:
                raise PlanError(f"no date code %{codes[i + 1]}")
            out, i = out + DATE_CODES[codes[i + 1]], i + 2
        else:
            out, i = out + (f"'{codes[i]}'" if codes[i].isalpha() else codes[i]), i + 1
    return out


@function("now")
def _now(c: Compiler, a: list) -> Typed:
    return Typed(F.current_timestamp(), "timestamp")


@function("strftime")
def _strftime(c: Compiler, a: list) -> Typed:
    fmt, at = (a[1], a[0]) if isinstance(a[1].const, str) else (a[0], a[1])
    return Typed(F.date_format(at.col.cast("timestamp"), pattern_of(str(fmt.const))), "string")


@function("strptime")
def _strptime(c: Compiler, a: list) -> Typed:
    return Typed(F.try_to_timestamp(to_text(a[0]), F.lit(pattern_of(str(a[1].const)))), "timestamp")


def _test(name: str, make) -> None:
    FUNCTIONS[name] = lambda c, a: Typed(make(a[0]), "boolean")


_dates = ("date", "timestamp", "timestamp_ntz")
_test("isnull", lambda x: F.lit(True) if x.dtype == "void" else x.col.isNull())
_test("isnumeric", lambda x: x.col.isNotNull() if V.is_number(x.dtype) else x.col.try_cast("double").isNotNull() if x.dtype == "string" else F.lit(False))
_test("isstring", lambda x: x.col.isNotNull() if x.dtype == "string" else F.lit(False))
_test("isdatetime", lambda x: F.lit(x.dtype.startswith("timestamp")))
_test("isdate", lambda x: F.lit(x.dtype == "date"))
_test("istime", lambda x: F.lit(False))
_test("isdateortime", lambda x: F.lit(x.dtype in _dates))
_test("isobj", lambda x: F.lit(x.dtype.startswith("struct")))
_test("isscalar", lambda x: F.lit(not x.dtype.startswith(("array", "map", "struct"))))
_test("islist", lambda x: F.lit(x.dtype.startswith("array")))
_test("isdic", lambda x: F.lit(x.dtype.startswith("map")))
FUNCTIONS["iscallable"] = lambda c, a: literal(isinstance(a[0], Lambda))


def _amino(table: dict[str, str], unknown: str):
    def run(c: Compiler, a: list) -> Typed:
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return Typed(F.coalesce(F.try_element_at(pairs, F.initcap(to_text(a[0]))), F.lit(unknown)), "string")

    return run


FUNCTIONS["aa1letter"] = _amino(AMINO, "X")
FUNCTIONS["aa3letter"] = _amino({v: k for k, v in AMINO.items()}, "Xaa")


@function("cell")
def _cell(c: Compiler, a: list) -> Typed:
    """cell(row, col) with the row relative to the present one as a constant offset: cell(cur_row - 1, 2) is written prev(2)."""
    raise PlanError("cell(row, col) needs a constant offset: use shifted(col, offset)")


@function("shifted")
def _shifted(c: Compiler, a: list) -> Typed:
    """shifted(col, offset): the column's cell so many rows further on (before, if negative); null outside."""
    from pyspark.sql import Window

    i, k = c.table.index(a[0].const), int(a[1].const)
    w = Window.orderBy(ROW)
    return Typed(F.lead(c.table.col(i), k).over(w) if k >= 0 else F.lag(c.table.col(i), -k).over(w), c.table.types[i])


@function("colId")
def _col_id(c: Compiler, a: list) -> Typed:
    return literal(c.table.index(a[0].const))


@function("headercell")
def _headercell(c: Compiler, a: list) -> Typed:
    return literal(c.table.names[int(a[-1].const)])


@function("incoltype")
def _incoltype(c: Compiler, a: list) -> Typed:
    return literal(c.table.types[c.table.index(a[0].const)])


@function("rowcells")
def _rowcells(c: Compiler, a: list) -> Typed:
    """The present row's cells as texts."""
    cells = [F.coalesce(V.text(c.table.col(i), t), F.lit("")) for i, t in enumerate(c.table.types)]
    return Typed(F.array(*cells), "array<string>")


@function("input_name")
def _input_name(c: Compiler, a: list) -> Typed:
    return Typed(F.input_file_name(), "string")


# text and number functions of the older formula languages


def _text(name: str, make, dtype: str = "string") -> None:
    FUNCTIONS[name] = lambda c, a: Typed(make(*[F.coalesce(to_text(x), F.lit("")) for x in a]), dtype)


_text("len", lambda s: F.length(s).cast("bigint"), "bigint")
_text("equal", lambda a, b: a == b, "boolean")
_text("inequal", lambda a, b: a != b, "boolean")
_text("hasnt", lambda a, b: ~F.contains(a, b), "boolean")
_text("contains", lambda a, b: F.contains(a, b), "boolean")
_text("concat", F.concat)
_text("after", lambda s, x: F.when(F.contains(s, x), F.substr(s, F.call_function("locate", x, s) + F.length(x))).otherwise(F.lit("")))
_text("before", lambda s, x: F.when(F.contains(s, x), F.substr(s, F.lit(1), F.call_function("locate", x, s) - 1)).otherwise(s))
_text("cmp", lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("bigint"), "bigint")
_text("cnt", lambda s, x: F.when(x == "", 0).otherwise((F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(x)).cast("bigint"), "bigint")
_text("search", lambda s, x: (F.call_function("locate", x, s) - 1).cast("bigint"), "bigint")
_text("replace", F.replace)
_text("upper", F.upper)
_text("lower", F.lower)
_text("cleanends", F.trim)
_text("cleanmarkup", lambda s: F.regexp_replace(s, "<[^>]*>", ""))
_text("crlf", lambda s: F.regexp_replace(s, "\r\n?", "\n"))
_text("reverse", F.reverse)


@function("repeat")
def _repeat(c: Compiler, a: list) -> Typed:
    return Typed(F.repeat(F.coalesce(to_text(a[0]), F.lit("")), V.num(a[1].col, a[1].dtype).cast("int")), "string")


@function("skip")
def _skip(c: Compiler, a: list) -> Typed:
    return Typed(F.substr(F.coalesce(to_text(a[0]), F.lit("")), V.num(a[1].col, a[1].dtype).cast("int") + 1), "string")


@function("printf")
def _printf(c: Compiler, a: list) -> Typed:
    return Typed(F.format_string(str(a[0].const), *[x.col for x in a[1:]]), "string")


for _n, _make in {
    "lg10": lambda x: F.when(x > 0, F.log10(x)), "lg2": lambda x: F.when(x > 0, F.log2(x)), "ln": lambda x: F.when(x > 0, F.ln(x)), "neg": lambda x: -x,
    "inv": lambda x: F.when(x == 0, F.lit(float("inf"))).otherwise(F.call_function("try_divide", F.lit(1.0), x)), "plus": lambda x, y: x + y, "minus": lambda x, y: x - y, "mult": lambda x, y: x * y,
    "div": lambda x, y: F.when(y == 0, F.lit(float("inf"))).otherwise(F.call_function("try_divide", x, y)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "ceiling": lambda x: F.ceil(x).cast("double"),
}.items():
    _real(_n, _make)


@function("sigma")
def _sigma(c: Compiler, a: list) -> Typed:
    """Population deviation of a list's numbers."""

    def deviation(n: Column) -> Column:
        mean = F.aggregate(n, F.lit(0.0), lambda s, v: s + v) / F.size(n)
        square = F.aggregate(n, F.lit(0.0), lambda s, v: s + v * v) / F.size(n)
        return F.when(F.size(n) > 0, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))

    return Typed(once(numbers(as_list(a)), deviation), "double")


@function("RMS")
def _rms(c: Compiler, a: list) -> Typed:
    n = numbers(as_list(a))
    return Typed(F.when(F.size(n) > 0, F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, v: s + v * v) / F.size(n))), "double")


@function("rand")
def _rand(c: Compiler, a: list) -> Typed:
    return Typed(F.rand(int(a[0].const)) if a else F.rand(), "double")


@function("irand")
def _irand(c: Compiler, a: list) -> Typed:
    """A whole number from the first up to, not with, the second."""
    low, high = double(a[0]), double(a[1])
    return Typed(F.floor(low + F.rand() * (high - low)).cast("bigint"), "bigint")


# JSON


@function("jsonprint")
def _jsonprint(c: Compiler, a: list) -> Typed:
    """Any value as JSON text; null is the text null."""
    x = a[0]
    if x.dtype.startswith(("array", "map", "struct")):
        return Typed(F.coalesce(F.to_json(x.col), F.lit("null")), "string")
    listed = F.to_json(F.array(x.col if x.dtype != "void" else F.lit(None).cast("string")))
    return Typed(F.substr(listed, F.lit(2), F.length(listed) - 2), "string")


@function("jsonget")
def _jsonget(c: Compiler, a: list) -> Typed:
    """jsonget(text, "$.a[0].b"): the value at a constant path as text; null where there is none or the text is no JSON."""
    return Typed(F.get_json_object(to_text(a[0]), str(a[1].const)), "string")


@function("jsonlist")
def _jsonlist(c: Compiler, a: list) -> Typed:
    """A JSON list as a list of texts (inner lists and objects as JSON); null if the text is no list."""
    return Typed(F.from_json(to_text(a[0]), "array<string>"), "array<string>")


@function("jsondic")
def _jsondic(c: Compiler, a: list) -> Typed:
    """A JSON object as a dictionary of texts; null if the text is no object."""
    return Typed(F.from_json(to_text(a[0]), "map<string,string>"), "map<string,string>")


@function("clust")
def _clust(c: Compiler, a: list) -> Typed:
    """list.clust({activity | distance, distalgo, clustalgo}): the rows' tree in Newick form.

    The list holds rows of numbers, or with ``distance: 1`` a distance matrix.
    """
    import numpy as np
    import pandas as pd

    from ..operators.numeric import distances, linkage

    options = a[1].const if len(a) > 1 and isinstance(a[1].const, dict) else {}
    kind, how = options.get("distalgo") or "euclidean", {"single-link": "single", "complete-link": "complete", "nj": "nj", "fast-nj": "nj"}.get(options.get("clustalgo") or "nj")
    if how is None:
        raise PlanError(f"no clustering {options.get('clustalgo')!r}")
    given = bool(options.get("distance"))

    def tree(rows) -> str:
        m = np.array([list(r) for r in rows], float)
        return linkage(m if given else distances(m, kind), [str(i) for i in range(len(m))], how)[0]

    run = F.pandas_udf(lambda s: pd.Series([None if x is None else tree(x) for x in s]), "string", F.PandasUDFType.SCALAR)
    return Typed(run(a[0].col.cast("array<array<double>>")), "string")
