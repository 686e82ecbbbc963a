"""A small traversal language over named relations, planned as joins.

``o = find.rel(col==a.col, tag='x', key==$param); unique.u(o.c); printCSV(o.c, a.d);`` - each statement extends the
rows of bindings; columns are kept as ``label.column``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..operators.index import RangeIndex, SortedRelation, indexed
from ..operators.ranges import range_join
from ..storage import materialize
from ..table import PlanError

STATEMENT = re.compile(r"\s*(?:(\w+)\s*=\s*)?(\w+!?)(?:\.(\w+))?\s*\((.*)\)\s*$", re.S)
ARGUMENT = re.compile(r"""\s*(?:(\#?[\w.]+)\s*(==|=|!=|>=|<=|>|<)\s*)?('[^']*'|"[^"]*"|\$?[\w.#:-]+)\s*$""")


def _split(text: str, sep: str) -> list[str]:
    out, part, quote = [], "", ""
    for ch in text:
        quote = "" if ch == quote else ch if not quote and ch in "'\"" else quote
        if ch == sep and not quote:
            out.append(part)
            part = ""
        else:
            part += ch
    return [p for p in [*out, part] if p.strip()]


class Traversal:
    """``relations``: name -> DataFrame or written index, or a list of them (several stores, their union); a jump beyond ``max_steps`` is an error.

    A find whose range is bound to earlier columns joins by bins of ``range_width``, about the usual length of a range.
    """

    def __init__(self, spark: SparkSession, relations: Mapping[str, DataFrame | RangeIndex | SortedRelation | list], max_steps: int | None = None, range_width: int = 1000):
        self.spark, self.relations, self.max_steps, self.range_width = spark, relations, max_steps, range_width

    def relation(self, name: str) -> DataFrame:
        if name not in self.relations:
            raise PlanError(f"no relation {name!r}; there are {', '.join(self.relations)}")
        found = self.relations[name]
        if isinstance(found, list):
            out = indexed(found[0])
            for more in found[1:]:
                out = out.unionByName(indexed(more))
            return out
        return indexed(found)

    def picked(self, name: str, args: list) -> DataFrame:
        """The relation for a find that isn't bound to earlier labels: an index reads only the files that can hold an answer."""
        found = self.relations.get(name)
        constant = {c: x for c, op, x in args if c and op in ("==", "=") and re.fullmatch(r"'[^']*'|\"[^\"]*\"|-?\d+(:-?\d+)?", x)}
        plain = {c: x[1:-1] if x[0] in "'\"" else int(x) for c, x in constant.items() if ":" not in x or x[0] in "'\""}
        if isinstance(found, SortedRelation) and found.by[0] in plain:
            return found.find(plain[found.by[0]])
        if isinstance(found, RangeIndex):
            for c, x in constant.items():
                if x[0] not in "'\"" and ":" in x and (f"{c}_start", f"{c}_end") == (found.start, found.end):
                    return found.search(*map(int, x.split(":")), key=plain.get(found.keys[0]) if found.keys else None)
        return self.relation(name)

    def run(self, query: str, params: dict[str, object] | None = None) -> DataFrame:
        self.params, self.rows, self.finds, self.out = params or {}, None, {}, None
        for s in _split(query, ";"):
            m = STATEMENT.match(s)
            if not m:
                raise PlanError(f"can't read {s.strip()!r}")
            label, cmd, name, args = m[1], m[2], m[3], [self.argument(a) for a in _split(m[4], ",")]
            step = getattr(self, "do_" + cmd.rstrip("!"), None)
            if step is None:
                raise PlanError(f"no command {cmd!r}")
            step(label or name or cmd, name, args, cmd.endswith("!"))
        if self.out is None:
            raise PlanError("nothing is printed")
        return self.out

    def argument(self, text: str) -> tuple[str | None, str | None, str]:
        m = ARGUMENT.match(text)
        if not m:
            raise PlanError(f"can't read {text.strip()!r}")
        return m[1], m[2], m[3]

    def value(self, text: str) -> Column:
        if text[:1] in "'\"":
            return F.lit(text[1:-1])
        if text[:1] == "$":
            if text[1:] not in self.params:
                raise PlanError(f"no parameter {text}")
            return F.lit(self.params[text[1:]])
        if re.fullmatch(r"-?\d+", text):
            return F.lit(int(text))
        if re.fullmatch(r"-?\d*\.\d+", text):
            return F.lit(float(text))
        return F.col(f"`{text}`")

    def labelled(self, df: DataFrame, label: str) -> DataFrame:
        return df.select(*[df[c].alias(f"{label}.{c}") for c in df.columns])

    def test(self, label: str, args: list, search: bool) -> tuple[list[Column], bool]:
        """The conditions on a relation's columns, and whether they refer to earlier labels."""
        tests, bound = [], False
        for col, op, text in args:
            if col is None or col.startswith("#"):
                continue
            c = F.col(f"`{label}.{col}`")
            if ":" in text and text[:1] not in "'\"":  # a range s:e over <col>_start, <col>_end
                s, e = (self.value(x) for x in text.split(":"))
                tests.append((F.col(f"`{label}.{col}_start`") <= e) & (F.col(f"`{label}.{col}_end`") >= s))
                bound |= bool(re.search(r"[A-Za-z]\w*\.", text))
                continue
            v = self.value(text)
            bound |= text[:1] not in "'\"$" and not re.fullmatch(r"-?[\d.]+", text)
            if search and text[:1] in "'\"":
                raw = text[1:-1]
                tests.append(F.rlike(c.cast("string"), F.lit(raw[6:])) if raw.startswith("regex:") else F.contains(F.lower(c.cast("string")), F.lit(raw.lower())))
            else:
                tests.append({"==": c == v, "=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op or "=="])
        return tests, bound

    def extend(self, label: str, name: str, args: list, search: bool) -> None:
        df = self.labelled(self.picked(name, args) if self.rows is None and not search else self.relation(name), label)
        self.finds[label] = (name, args)
        if self.rows is not None and not search and (joined := self.overlapping(df, label, args)) is not None:
            self.rows = joined
            return
        tests, bound = self.test(label, args, search)
        every = None
        for t in tests:
            every = t if every is None else every & t
        if self.rows is None:
            self.rows = df if every is None else df.where(every)
        elif bound:
            if not search and not any(op in ("==", "=") and ":" not in x and x in self.rows.columns for c, op, x in args if c):
                raise PlanError(f"{label} is bound by inequalities alone, which pairs all rows; bind a range as low:high or a column by ==")
            self.rows = self.rows.join(df, every)
        else:
            raise PlanError(f"{label} isn't bound to an earlier label")

    def overlapping(self, df: DataFrame, label: str, args: list) -> DataFrame | None:
        """The join of a find with a range of numbers bound to earlier columns, else None; ranges that end before their start meet nothing."""
        earlier, kinds = set(self.rows.columns), dict(df.dtypes) | dict(self.rows.dtypes)
        for k, (col, _, text) in enumerate(args):
            ends = text.split(":") if text[:1] not in "'\"" else []
            if col is None or len(ends) != 2 or not set(ends) <= earlier:
                continue
            spans = [f"{label}.{col}_start", f"{label}.{col}_end"]
            if all(V.is_number(kinds.get(c, "void")) for c in (*spans, *ends)):
                break
        else:
            return None
        rest = [a for j, a in enumerate(args) if j != k]
        same = [(c, x) for c, op, x in rest if c and not c.startswith("#") and op in ("==", "=") and x in earlier]
        left = self.rows.withColumns({"_ls": F.col(f"`{ends[0]}`"), "_le": F.col(f"`{ends[1]}`")} | {f"_k{j}": F.col(f"`{x}`") for j, (_, x) in enumerate(same)})
        right = df.withColumns({"_rs": F.col(f"`{spans[0]}`"), "_re": F.col(f"`{spans[1]}`")} | {f"_k{j}": F.col(f"`{label}.{c}`") for j, (c, _) in enumerate(same)})
        keys = [f"_k{j}" for j in range(len(same))]
        out = range_join(left, right, keys, ("_ls", "_le"), ("_rs", "_re"), self.range_width).drop("_ls", "_le", "_rs", "_re", *keys)
        for t in self.test(label, rest, False)[0]:
            out = out.where(t)
        return out

    def do_find(self, label: str, name: str, args: list, negate: bool) -> None:
        self.extend(label, name, args, False)

    def do_search(self, label: str, name: str, args: list, negate: bool) -> None:
        self.extend(label, name, args, True)

    def do_foreach(self, label: str, name: str | None, args: list, negate: bool) -> None:
        """foreach.rel('') takes all records of a relation; foreach(x, y) seeds ``label.value``."""
        if name in self.relations:
            self.rows = self.labelled(self.relation(name), label)
        else:
            values = [a[2] for a in args]
            made = self.spark.range(1).select(F.explode(F.array(*[self.value(v) for v in values])).alias(f"{label}.value"))
            self.rows = made

    def do_count(self, label: str, name: str, args: list, negate: bool) -> None:
        """``label.#``: how many records each row of bindings meets (0 for none)."""
        df = self.labelled(self.relation(name), label)
        tests, _ = self.test(label, args, False)
        every = F.lit(True)
        for t in tests:
            every = every & t
        if self.rows is None:
            self.rows = df.where(every).agg(F.count("*").alias(f"{label}.#"))
            return
        keys = [c for c in self.rows.columns]
        hit = self.rows.join(df, every, "left")
        first = F.col(f"`{df.columns[0]}`")
        self.rows = hit.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(first).alias(f"{label}.#"))

    def do_unique(self, label: str, name: str | None, args: list, negate: bool) -> None:
        """Keeps one row for each tuple of the arguments; unique! keeps tuples that occur once."""
        cols = [a[2] for a in args]
        if not negate:
            self.rows = self.rows.dropDuplicates(cols)
            return
        once = self.rows.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
        test = F.lit(True)
        left, right = self.rows.alias("l"), once.alias("r")
        for c in cols:
            test = test & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
        self.rows = left.join(right, test, "left_semi")

    def do_sum(self, label: str, name: str | None, args: list, negate: bool) -> None:
        """sum.s(key, ..., value): ``s.sum`` for each key tuple."""
        *keys, value = [a[2] for a in args]
        self.rows = self.rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum(F.col(f"`{value}`")).alias(f"{label}.sum"))

    def do_dict(self, label: str, name: str | None, args: list, negate: bool) -> None:
        """dict.d(key, value): ``d.values``, the distinct values of each key in order."""
        *keys, value = [a[2] for a in args]
        self.rows = self.rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.array_sort(F.collect_set(F.col(f"`{value}`"))).alias(f"{label}.values"))

    def do_ddict(self, label: str, name: str | None, args: list, negate: bool) -> None:
        """ddict.d(key, ..., inner, value): ``d.values``, a map from each inner key to its distinct values; null inner keys are left out."""
        *keys, inner, value = [F.col(f"`{a[2]}`") for a in args]
        each = self.rows.where(inner.isNotNull()).groupBy(*keys, inner.alias("_inner")).agg(F.array_sort(F.collect_set(value)).alias("_values"))
        made = F.map_from_entries(F.array_sort(F.collect_list(F.struct("_inner", "_values")))).alias(f"{label}.values")
        self.rows = each.groupBy(*keys).agg(made)

    def do_jump(self, label: str, name: str, args: list, negate: bool) -> None:
        """jump!.L(v, x): repeats label L's find with its bound key taken from v, until v is x; jump.L(v, x): while v is x.

        All rows met on the way stay, each (binding, record) once, so cycles end.
        """
        relation, bound = self.finds[name]
        key = next(c for c, op, text in bound if c and "." in text or c and op == "==")
        df = self.relation(relation)
        v, x = args[0][2], self.value(args[1][2])
        inner = [c for c in self.rows.columns if c.startswith(f"{name}.")]
        seen = frontier = materialize(self.rows)
        step = 0
        while True:
            step += 1
            if self.max_steps is not None and step > self.max_steps:
                raise PlanError(f"a jump of more than {self.max_steps} steps")
            going = frontier.where(F.col(f"`{v}`") != x if negate else F.col(f"`{v}`") == x).withColumn("_to", F.col(f"`{v}`")).drop(*inner)
            nxt = going.join(self.labelled(df, name), F.col("_to") == F.col(f"`{name}.{key}`")).drop("_to").select(*[F.col(f"`{c}`") for c in self.rows.columns])
            frontier = materialize(nxt.subtract(seen))
            if frontier.isEmpty():
                break
            seen = seen.unionAll(frontier)
        self.rows = seen

    def do_printCSV(self, label: str, name: str | None, args: list, negate: bool) -> None:  # noqa: N802
        cols = [a[2] for a in args]
        made = self.rows.select(*[F.col(f"`{c}`").alias(c.replace(".#", "_count").replace(".", "_")) for c in cols])
        self.out = made if self.out is None else self.out.unionByName(made, allowMissingColumns=True)

    do_print = do_printCSV

    def do_limit(self, label: str, name: str | None, args: list, negate: bool) -> None:
        self.rows = self.rows.limit(int(args[0][2]))

    def do_skip(self, label: str, name: str | None, args: list, negate: bool) -> None:
        self.rows = self.rows.offset(int(args[0][2]))

    def do_set(self, label: str, name: str | None, args: list, negate: bool) -> None:
        """set.x(value): ``x.value``."""
        self.rows = self.rows.withColumn(f"{label}.value", self.value(args[0][2]))
