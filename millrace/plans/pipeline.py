"""Table pipelines: a JSON list of {"op", "arg"} stages planned as one lazy DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.expr import Compiler, Typed, has_loops, literal
from ..functions.script import script
from ..storage import materialize
from ..table import ROW, PlanError, Table

#: Commands (table -> table by argument); operators register themselves here.
COMMANDS: dict[str, Callable[[Table, dict], Table]] = {}
#: Known names that have no definition to follow.
UNDEFINED = ("rlda", "u-usage", "geneOntology", "rankCollapser")
METHODS = ("rowlist", "inrowlist", "equals", "regex", "substring", "formula", "range")


def command(*names: str):
    def keep(f: Callable[[Table, dict], Table]) -> Callable[[Table, dict], Table]:
        for n in names:
            COMMANDS[n] = f
        return f

    return keep


def row_set(spec: object) -> list[int] | tuple[int, int] | None:
    """Row ordinals: a list of numbers and {start, end} ranges, or text like "0-3,7"; None is all."""
    if spec is None or spec == "*":
        return None
    if isinstance(spec, str):
        return [i for a in spec.split(",") for i in range(int(a.split("-")[0]), int(a.split("-")[-1]) + 1)]
    out: list[int] = []
    for x in spec if isinstance(spec, (list, tuple)) else [spec]:
        out += range(int(x["start"]), int(x["end"]) + 1) if isinstance(x, dict) else [int(x)]
    return out


class Predicate:
    """A named test of cells: the filter methods, with their negation, junctions and columns."""

    def __init__(self, arg: dict, pipeline: Pipeline):
        self.arg, self.pipeline = arg, pipeline
        self.method = arg.get("method", "formula" if "formula" in arg or "formulas" in arg else "equals")
        if self.method not in METHODS:
            raise PlanError(f"no filter method {self.method!r}; there are {', '.join(METHODS)}")
        raw = arg.get("values", arg.get("value", arg.get("formulas", arg.get("formula"))))
        self.values = raw if isinstance(raw, list) else [raw]

    def cell(self, c: Column, dtype: str, value: object) -> Column:
        sensitive = bool(self.arg.get("caseSensitive"))
        shown = F.coalesce(V.text(c, dtype), F.lit(""))
        if self.method == "regex":
            return F.rlike(shown, F.lit(str(value) if sensitive else f"(?i){value}"))
        if self.method == "substring":
            return F.contains(shown, F.lit(str(value))) if sensitive else F.contains(F.lower(shown), F.lit(str(value).lower()))
        if self.method == "range":
            return self.inside(c, dtype, value or {})
        v = literal(value)
        if isinstance(value, str) and dtype != "string":
            parsed = F.lit(value).try_cast(dtype) if not dtype.startswith(("array", "map")) else F.lit(value)
            return F.coalesce(c == parsed, F.lit(False))
        return F.coalesce(V.equal(c, dtype, v.col, v.dtype), F.lit(False))

    def inside(self, c: Column, dtype: str, bounds: dict) -> Column:
        tests = []
        for key, op in (("min", ">"), ("max", "<")):
            if (b := bounds.get(key)) is not None:
                op = op if bounds.get("exclusive") else op + "="
                if V.is_number(dtype) and not isinstance(b, str):
                    x, y = c, F.lit(b)
                elif dtype in ("timestamp", "timestamp_ntz", "date"):
                    x, y = c, F.lit(b).try_cast(dtype)
                elif isinstance(b, str):
                    x, y = V.text(c, dtype), F.lit(b)
                else:
                    x, y = V.maybe_num(c, dtype), F.lit(b)
                tests.append(x >= y if op == ">=" else x > y if op == ">" else x <= y if op == "<=" else x < y)
        return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)

    def over(self, c: Column, dtype: str) -> Column:
        """Any of the values; a negation is applied to each before that."""
        tests = [self.cell(c, dtype, v) for v in self.values]
        return reduce(or_, [~t for t in tests] if self.arg.get("negate") else tests)

    def rows(self, t: Table) -> Column:
        """The test of whole rows: over the chosen columns any (or, with colConjunction, all)."""
        if self.method in ("rowlist", "inrowlist"):
            inside = F.col(ROW).isin(row_set(self.values if len(self.values) > 1 else self.values[0]) or [])
            return ~inside if self.arg.get("negate") else inside
        if self.method == "formula":
            tests = [self.pipeline.compiler(t).condition(str(v)) for v in self.values]
            return reduce(or_, [~x for x in tests] if self.arg.get("negate") else tests)
        columns = t.indexes(next((self.arg[k] for k in ("col", "cols", "incol", "incols") if k in self.arg), "*"))
        tests = [self.over(t.col(i), t.types[i]) for i in columns]
        if not tests:
            return F.lit(False)
        return reduce(and_ if self.arg.get("colConjunction") else or_, tests)


class Pipeline:
    """Plans stages over named sources.  ``sources``: name -> DataFrame, Table or a function that makes one."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, object]):
        self.spark, self.sources = spark, sources
        self.constants: dict[str, object] = {}
        self.categories: dict[str, DataFrame | list[int]] = {}

    def compiler(self, t: Table | None) -> Compiler:
        return Compiler(t, self.constants)

    def source(self, spec: object, order: list | None = None) -> Table:
        """A source, a list of sources (one after the other, by position) or {"tbl", "order", "concat"}."""
        if isinstance(spec, Table):
            return spec
        if isinstance(spec, DataFrame):
            return Table.of(spec, order)
        if isinstance(spec, list):
            return reduce(concat, [self.source(s, order) for s in spec])
        if isinstance(spec, dict):
            own = spec.get("order", order)
            first = self.source(spec.get("concat") or spec.get("tbl") or spec.get("obj") or spec.get("req"), own)
            return first
        found = self.sources.get(spec)
        if found is None:
            raise PlanError(f"no source {spec!r}; there are {', '.join(self.sources)}")
        return self.source(found() if callable(found) else found, order)

    def run(self, stages: str | list, source: object = None, params: dict | None = None) -> Table:
        """``params``: cols, start, cnt, search, searchRegExp, searchCols, resolution, abscissaCol, minmaxCols, minmaxMainCol."""
        stages, params = json.loads(stages) if isinstance(stages, str) else stages, params or {}
        if not isinstance(stages, list) or any(not isinstance(s, dict) or "op" not in s for s in stages):
            raise PlanError("stages are a list of {op, arg}")
        for s in stages:  # constants come before all stages
            if s["op"] == "predefine":
                a = s["arg"]
                self.constants[a["name"]] = a["value"] if "value" in a else self.evaluate(a["formula"])
        stages = [{"op": s["op"], "arg": self.rendered(s.get("arg") or {})} for s in stages if s["op"] != "predefine"]
        t = self.source(source, params.get("order")) if source is not None else None
        if t is not None and params.get("search"):
            t = self.search(t, params)
        for s in stages:
            t = self.stage(t, s["op"], s["arg"])
        if t is None:
            raise PlanError("no table was loaded")
        if params.get("cols") is not None:
            keep = t.indexes(params["cols"])
            t = t.with_columns([t.columns()[i] for i in keep])
        if params.get("resolution"):
            from ..operators.resample import downsample

            t = downsample(t, int(params["resolution"]), params.get("abscissaCol"), params.get("minmaxCols"), params.get("minmaxMainCol"))
        return page(t, int(params.get("start", 0)), int(params.get("cnt", 0)))

    def evaluate(self, formula: str) -> object:
        x = self.compiler(None).formula(formula)
        return self.spark.range(1).select(x.col.alias("v")).first()["v"]

    def rendered(self, arg: object) -> object:
        """Templates $(name) in texts stand for constants."""
        if isinstance(arg, str):
            return re.sub(r"\$\((\w+)\)", lambda m: str(self.constants[m[1]]) if m[1] in self.constants else m[0], arg)
        if isinstance(arg, list):
            return [self.rendered(x) for x in arg]
        return {k: self.rendered(v) for k, v in arg.items()} if isinstance(arg, dict) else arg

    def search(self, t: Table, params: dict) -> Table:
        method = "regex" if params.get("searchRegExp") else "substring"
        return t.where(Predicate({"method": method, "value": params["search"], "cols": params.get("searchCols", "*")}, self).rows(t))

    def stage(self, t: Table | None, op: str, arg: dict) -> Table:
        if op in UNDEFINED:
            raise PlanError(f"{op} is a known name without a definition")
        if op == "load":
            more = self.source(arg.get("concat") or arg.get("tbl") or arg, arg.get("order"))
            return more if t is None else concat(t, more)
        if t is None and op not in ("ionwander", "load-SNPprofile"):
            raise PlanError(f"{op} needs a table")
        if op == "collapserows":
            return t
        made = getattr(self, "op_" + op.replace("-", "_"), None)
        if made is not None:
            return made(t, arg)
        if op not in COMMANDS:
            raise PlanError(f"no operation {op!r}")
        return COMMANDS[op](t, arg)

    # rows

    def op_filter(self, t: Table, arg: dict) -> Table:
        p = Predicate(arg, self)
        if p.method in ("rowlist", "inrowlist"):
            t = t.numbered()
        return t.where(p.rows(t))

    def op_colfilter(self, t: Table, arg: dict) -> Table:
        keep = self.matching_columns(t, arg)
        return t.with_columns([t.columns()[i] for i in keep])

    def matching_columns(self, t: Table, arg: dict) -> list[int]:
        p, rows = Predicate(arg, self), row_set(next((arg[k] for k in ("row", "rows", "inrow", "inrows") if k in arg), None))
        chosen = t if rows is None else (n := t.numbered()).where(F.col(ROW).isin(rows))
        fold = F.bool_and if arg.get("rowConjunction") else F.bool_or
        found = chosen.df.agg(*[F.coalesce(fold(p.over(chosen.col(i), chosen.types[i])), F.lit(False)).alias(f"c{i}") for i in range(len(t.names))]).first()
        return [i for i in range(len(t.names)) if found[f"c{i}"]]

    def op_rowcategory(self, t: Table, arg: dict) -> Table:
        t = t.numbered()
        self.categories[arg["name"]] = t.where(Predicate(arg, self).rows(t)).df.select(F.col(ROW).alias("row"))
        return t

    def op_colcategory(self, t: Table, arg: dict) -> Table:
        self.categories[arg["name"]] = self.matching_columns(t, arg)
        return t

    def op_sort(self, t: Table, arg: dict) -> Table:
        formulas = arg.get("formulas", arg.get("formula", "$0"))
        xs = [self.compiler(t).formula(str(f)) for f in (formulas if isinstance(formulas, list) else [formulas])]
        return sort_table(t, xs, bool(arg.get("reverse")), int(arg.get("maxCountEach", 0)))

    op_inputsort = op_sort

    def op_slice(self, t: Table, arg: dict) -> Table:
        """Rows from one boundary to the other, both included; a boundary that isn't found leaves nothing."""
        t, marks = t.fixed(), []
        for end, default in (("start", F.min(ROW)), ("end", F.max(ROW))):
            a = arg.get(end) or {}
            if not a.get("method"):
                marks.append(default)
                continue
            m = re.fullmatch(r"(first|last)(Equals|LessThan|GreaterThan)", a["method"])
            if not m:
                raise PlanError(f"no slice method {a['method']!r}")
            i = t.index(a["col"])
            c, dtype = t.col(i), t.types[i]
            v = F.lit(a["value"]).try_cast(dtype) if isinstance(a["value"], str) else F.lit(a["value"])
            test = {"Equals": c == v, "LessThan": c < v, "GreaterThan": c > v}[m[2]]
            marks.append((F.min if m[1] == "first" else F.max)(F.when(test, F.col(ROW))))
        lo, hi = t.df.agg(marks[0].alias("lo"), marks[1].alias("hi")).first()
        return t.where(F.lit(False)) if lo is None or hi is None else t.where(F.col(ROW).between(lo, hi))

    def op_extract(self, t: Table, arg: dict) -> Table:
        rows = row_set(arg.get("rowSet"))
        if rows is not None:
            t = t.numbered()
            t = t.where(F.col(ROW).isin(rows))
        return t.with_columns([t.columns()[i] for i in t.indexes(arg.get("colSet"))])

    # columns

    def made_column(self, t: Table, arg: dict) -> Column:
        source = str(arg.get("formula", "null"))
        kinds = {"int": "bigint", "uint": "bigint", "real": "double", "string": "string", "bool": "boolean", "date": "date", "datetime": "timestamp"}
        if arg.get("type") and arg["type"] not in kinds:
            raise PlanError(f"no type {arg['type']!r}")
        if has_loops(source):  # loops have no column form; of the type asked for, else a number
            dtype = kinds[arg["type"]] if arg.get("type") else "double"
            x = Typed(script(source, t, dtype, self.constants), dtype)
        else:
            x = self.compiler(t).formula(source)
        c, dtype = x.col, x.dtype
        if arg.get("type"):
            dtype = kinds[arg["type"]]
            c = V.text(c, x.dtype) if dtype == "string" else c.try_cast(dtype) if not V.is_number(x.dtype) else c.cast(dtype)
        if arg.get("format"):
            c = formatted(c, dtype, arg["format"])
        return c

    def op_appendcol(self, t: Table, arg: dict) -> Table:
        return t.with_columns([*t.columns(), (arg.get("name", f"col{len(t.names)}"), self.made_column(t, arg))])

    def op_insertcol(self, t: Table, arg: dict) -> Table:
        at, cols = t.index(arg["col"]), t.columns()
        return t.with_columns([*cols[:at], (arg.get("name", f"col{at}"), self.made_column(t, arg)), *cols[at:]])

    def op_definecol(self, t: Table, arg: dict) -> Table:
        at, cols = t.index(arg["col"]), t.columns()
        cols[at] = (cols[at][0], self.made_column(t, arg))
        return t.with_columns(cols)

    def op_hidecol(self, t: Table, arg: dict) -> Table:
        hidden = set(t.indexes(arg.get("col", arg.get("cols"))))
        return t.with_columns([c for i, c in enumerate(t.columns()) if (i in hidden) == bool(arg.get("negate"))])

    def op_renamecol(self, t: Table, arg: dict) -> Table:
        at, cols = t.index(arg["col"]), t.columns()
        cols[at] = (arg["to"], cols[at][1])
        return t.with_columns(cols)

    def op_movecol(self, t: Table, arg: dict) -> Table:
        at, cols = t.index(arg["col"]), t.columns()
        to = arg["to"] if isinstance(arg["to"], int) else t.index(arg["to"])
        cols.insert(to, cols.pop(at))
        return t.with_columns(cols)

    def op_setcell(self, t: Table, arg: dict) -> Table:
        t = t.numbered()
        at, cols = t.index(arg["col"]), t.columns()
        v = F.lit(arg["value"]).try_cast(t.types[at]) if arg["value"] is not None else F.lit(None)
        cols[at] = (cols[at][0], F.when(F.col(ROW) == int(arg["row"]), v).otherwise(cols[at][1]))
        return t.with_columns(cols)

    def op_transpose(self, t: Table, arg: dict) -> Table:
        return transpose(t, arg.get("topHeader", True), arg.get("leftHeader", True))

    # other stores

    def op_ionwander(self, t: Table | None, arg: dict) -> Table:
        """The printed rows of a traversal over the sources as relations: {qry, qryParams, cnt}; appended to a table at hand."""
        from .relations import Traversal

        names = arg.get("relations") or re.findall(r"\.(\w+)\s*\(", arg["qry"])
        known = {n: self.sources.get(n) for n in names if self.sources.get(n) is not None}
        out = Traversal(self.spark, known).run(arg["qry"], arg.get("qryParams"))
        made = Table.of(out.limit(int(arg["cnt"])) if arg.get("cnt") else out)
        return made if t is None else concat(t, made)

    def op_load_SNPprofile(self, t: Table | None, arg: dict) -> Table:  # noqa: N802
        """One subject's rows of a profile (columns sub, pos, ...), by position; gaps are filled unless autoAddMissingRows is false."""
        rows = self.source(arg.get("tbl") or arg.get("obj"))
        i, p = rows.index("sub"), rows.index("pos")
        found = renumbered(rows.df.where(V.text(rows.col(i), rows.types[i]) == str(arg["sub"])), rows.names, [f"c{p}"])
        if arg.get("autoAddMissingRows", True):
            found = COMMANDS["addMissingRows"](found, {"abscissa": {"col": p}, "add": [{"col": i, "value": arg["sub"]}]})
        return found if t is None else concat(t, found)

    # joins

    def op_glue(self, t: Table, arg: dict) -> Table:
        sides = []
        for name in ("lhs", "rhs"):
            a = arg.get(name) or {}
            side = t if name == "lhs" and not any(k in a for k in ("tbl", "obj", "req")) else self.source(a)
            sides += [side, self.compiler(side).formula(str(a.get("formula", "$0")))]
            if "hidecol" in a:
                sides[-2] = (sides[-2], set(side.indexes(a["hidecol"])))
            else:
                sides[-2] = (side, set())
        return glue(*sides)


def formatted(c: Column, dtype: str, fmt: str) -> Column:
    m = re.fullmatch(r"([^%]*)%([-+ 0#]*\d*(?:\.\d+)?)([diuxXofeEgG])([^%]*)", fmt)
    if not m:
        raise PlanError(f"no printf format for one number: {fmt!r}")
    if m[3] in "diuxXo":
        return F.format_string(f"{m[1]}%{m[2]}{'d' if m[3] in 'iu' else m[3]}{m[4]}", V.num(c, dtype).cast("bigint"))
    return F.format_string(fmt, V.num(c, dtype).cast("double"))


def concat(a: Table, b: Table) -> Table:
    """One after the other by position; names from the first, types widened to text where they differ."""
    if len(a.names) != len(b.names):
        raise PlanError(f"tables of {len(a.names)} and {len(b.names)} columns")
    left, right = [], []
    for i, (x, y) in enumerate(zip(a.types, b.types)):
        kind = x if x == y else "double" if V.is_number(x) and V.is_number(y) else "string"
        left.append(a.col(i).cast(kind).alias(f"c{i}"))
        right.append(b.col(i).cast(kind).alias(f"c{i}"))
    one = a.df.select(*left, F.struct(F.lit(0).alias("s"), F.col(ROW).alias("r")).alias(ROW))
    two = b.df.select(*right, F.struct(F.lit(1).alias("s"), F.col(ROW).alias("r")).alias(ROW))
    return renumbered(one.unionAll(two), a.names, [ROW])


def renumbered(df: DataFrame, names: tuple[str, ...], order: list) -> Table:
    """A new order: rows range-partitioned and sorted by ``order``, then numbered where they stand."""
    keep = [f"c{i}" for i in range(len(names))]
    return Table(df.orderBy(*order).select(*keep, F.monotonically_increasing_id().alias(ROW)), names)


def page(t: Table, start: int, count: int) -> Table:
    """Rows start.. of the order, ``count`` of them (0: all)."""
    if not start and not count:
        return t
    df = t.df.orderBy(ROW)
    df = df.offset(start) if start else df
    return Table(df.limit(count) if count else df, t.names)


def sort_table(t: Table, xs: list[Typed], reverse: bool = False, each: int = 0) -> Table:
    """By the mixed order; ties by row; ``reverse`` turns everything, ties too.  ``each``: rows kept of each key."""
    df, keys = t.df, []
    for k, x in enumerate(xs):
        for j, c in enumerate(V.sort_keys(x.col, x.dtype)):
            df = df.withColumn(f"_k{k}_{j}", c)
            keys.append(f"_k{k}_{j}")
    order = [F.desc(k) for k in [*keys, ROW]] if reverse else [*keys, ROW]
    if each:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order[-1]))).where(F.col("_n") <= each)
    return renumbered(df, t.names, order)


def transpose(t: Table, top: bool = True, left: bool = True) -> Table:
    """Rows become columns.  ``left``: the first column names them; ``top``: the first new column holds the old names."""
    body = range(1 if left else 0, len(t.names))
    n = t.numbered()
    rows = n.df.orderBy(ROW).limit(10_001).collect()  # each row becomes a column: their number is a plan's size
    if len(rows) > 10_000:
        raise PlanError("a table of more than 10000 rows can't become columns")
    cells = n.df.select(ROW, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), V.text(n.col(i), n.types[i]).alias("v")) for i in body])).alias("x")) if body else None
    if cells is None:
        raise PlanError("nothing to transpose")
    wide = cells.groupBy(F.col("x.i").alias("i")).agg(*[F.max(F.when(F.col(ROW) == k, F.col("x.v"))).alias(f"v{k}") for k in range(len(rows))])
    names = [str(r["c0"]) if left else f"row{k}" for k, r in enumerate(rows)]
    title = F.element_at(F.array(*[F.lit(x) for x in t.names]), F.col("i") + 1)
    cols = ([title.alias("c0")] if top else []) + [F.col(f"v{k}").alias(f"c{k + bool(top)}") for k in range(len(rows))]
    return Table(wide.select(*cols, F.col("i").cast("bigint").alias(ROW)), tuple(([t.names[0] if left else "name"] if top else []) + names))


def glue(left: tuple[Table, set[int]], lkey: Typed, right: tuple[Table, set[int]], rkey: Typed) -> Table:
    """Full outer join with at most one right row for a left row.

    Of the left rows of a key the first is matched, with the first right row of it; other right rows of a key that
    matched or repeat are dropped; right rows without a left key follow in order.  Null keys match each other; numbers
    and texts never match.
    """
    (lt, lhide), (rt, rhide) = left, right

    def keyed(t: Table, k: Typed, side: str) -> DataFrame:
        number, shown = (V.maybe_num(k.col, k.dtype), F.lit(None).cast("string")) if V.is_number(k.dtype) else (F.lit(None).cast("double"), V.text(k.col, k.dtype))
        key = F.concat_ws(":", F.when(number.isNotNull(), F.lit("n")).when(shown.isNotNull(), F.lit("s")).otherwise(F.lit("0")), number.cast("string"), shown)
        cols = [t.col(i).alias(f"{side}{i}") for i in range(len(t.names))]
        return t.df.select(*cols, F.col(ROW).alias(f"{side}row"), key.alias(f"{side}key"))

    # the left rows are read twice and must keep their numbers
    ldf, rdf = materialize(keyed(lt, lkey, "l")), keyed(rt, rkey, "r")
    # a hot or null key is one row of an aggregate on either side; all rows then meet by their own number
    first = ldf.groupBy("lkey").agg(F.min("lrow").alias("_first"))
    rcols = [c for c in rdf.columns if c != "rkey"]
    right = rdf.groupBy("rkey").agg(F.min_by(F.struct(*rcols), F.col("rrow")).alias("_r")).select("rkey", "_r.*")
    met = first.join(right, F.col("lkey") == F.col("rkey"), "full_outer").withColumn("_first", F.coalesce("_first", -1 - F.col("rrow"))).drop("lkey", "rkey")
    both = ldf.join(met, F.col("lrow") == F.col("_first"), "full_outer")
    cols = [(n, F.col(f"l{i}")) for i, n in enumerate(lt.names) if i not in lhide] + [(n, F.col(f"r{i}")) for i, n in enumerate(rt.names) if i not in rhide]
    df = both.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(cols)], F.coalesce("lrow", F.lit((1 << 62))).alias("_a"), F.coalesce("rrow", F.lit(0)).alias("_b"))
    return renumbered(df, tuple(n for n, _ in cols), ["_a", "_b"])
