"""Formulas with loops: run row by row in Python over Arrow batches, for what has no column form.

This is the slow way; ``compile_formula`` is the usual one.  Steps are counted, so an endless loop is an error.
"""

from __future__ import annotations

import math
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..table import PlanError, Table
from .expr import Parser

STEPS = 1_000_000
COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


class Break(Exception):
    pass


class Continue(Exception):
    pass


class Return(Exception):
    def __init__(self, value: object):
        self.value = value


def number(v: object) -> float | int:
    if isinstance(v, (bool, int, float)):
        return int(v) if isinstance(v, bool) else v
    try:
        return float(v) if v is not None else 0
    except (TypeError, ValueError):
        return 0


def truth(v: object) -> bool:
    if isinstance(v, str):
        return v.lower() not in ("", "0", "false", "off", "cancel")
    return bool(v) and not (isinstance(v, float) and math.isnan(v))


def same(a: object, b: object) -> bool:
    if a is None or b is None:
        return (a in (None, 0, "", 0.0) or a == []) and (b in (None, 0, "", 0.0) or b == [])
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    return a == b if type(a) is type(b) else str(a) == str(b)


def divide(a: float | int, b: float | int) -> float | int:
    if b == 0:
        return -math.inf if a < 0 else math.inf
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if isinstance(a, int) and isinstance(b, int) else a / b


FUNCTIONS = {
    "abs": lambda x: abs(number(x)), "floor": lambda x: math.floor(number(x)), "ceil": lambda x: math.ceil(number(x)), "sqrt": lambda x: math.sqrt(number(x)) if number(x) >= 0 else None,
    "pow": lambda x, y: number(x) ** number(y), "dim": lambda x: len(x or ""), "sum": lambda *x: sum(map(number, x[0] if isinstance(x[0], list) else x)), "min": lambda *x: min(map(number, x[0] if isinstance(x[0], list) else x)),
    "max": lambda *x: max(map(number, x[0] if isinstance(x[0], list) else x)), "append": lambda x, *v: [*x, *v], "push": lambda x, *v: [*x, *v], "cat": lambda *x: "".join("" if v is None else str(v) for v in x),
    "join": lambda x, s: s.join(map(str, x)), "split": lambda x, *s: list(x) if "" in s else re.split("|".join(map(re.escape, s)), x), "strip": lambda x: x.strip(" \t\r\n"), "range": lambda *n: list(range(*map(int, n))), "sort": sorted,
    "isnull": lambda x: x is None,
}


class Evaluator:
    def __init__(self, row: dict[object, object]):
        self.row, self.left = row, STEPS

    def run(self, node: tuple, env: dict) -> object:
        self.left -= 1
        if self.left < 0:
            raise PlanError("a formula runs too long")
        return getattr(self, "_" + node[0])(env, *node[1:])

    def _block(self, env: dict, body: list) -> object:
        last = None
        for n in body:
            last = self.run(n, env)
        return last

    def _let(self, env: dict, name: str, node: tuple) -> object:
        env[name] = self.run(node, env)
        return env[name]

    def _return(self, env: dict, node: tuple) -> object:
        raise Return(self.run(node, env))

    def _break(self, env: dict) -> None:
        raise Break

    def _continue(self, env: dict) -> None:
        raise Continue

    def _loop(self, env: dict, first: tuple, test: tuple, step: tuple, body: tuple) -> None:
        self.run(first, env)
        while truth(self.run(test, env)):
            try:
                self.run(body, env)
            except Break:
                break
            except Continue:
                pass
            self.run(step, env)

    def _if(self, env: dict, test: tuple, yes: tuple, no: tuple) -> object:
        return self.run(yes if truth(self.run(test, env)) else no, env)

    _cond = _if

    def _lit(self, env: dict, v: object) -> object:
        return v

    def _col(self, env: dict, spec: object) -> object:
        return self.row[spec]

    def _name(self, env: dict, name: str) -> object:
        if name not in env:
            raise PlanError(f"no name {name!r}")
        return env[name]

    def _lambda(self, env: dict, names: list, body: tuple):
        def call(*args: object) -> object:
            try:
                return self.run(body, {**env, **dict(zip(names, args))})
            except Return as r:
                return r.value

        return call

    def _list(self, env: dict, items: list) -> list:
        return [self.run(n, env) for n in items]

    def _dict(self, env: dict, pairs: list) -> dict:
        return {k: self.run(n, env) for k, n in pairs}

    def _not(self, env: dict, node: tuple) -> bool:
        return not truth(self.run(node, env))

    def _equal(self, env: dict, op: str, left: tuple, options: list) -> bool:
        a = self.run(left, env)
        return any(same(a, self.run(o, env)) for o in options) == (op == "==")

    def _op(self, env: dict, op: str, left: tuple, right: tuple) -> object:
        a = self.run(left, env)
        if op in ("&&", "||"):
            return (truth(a) and truth(self.run(right, env))) if op == "&&" else (truth(a) or truth(self.run(right, env)))
        b = self.run(right, env)
        if op in COMPARE:
            both = isinstance(a, (int, float)) and isinstance(b, (int, float))
            return COMPARE[op](number(a), number(b)) if both else COMPARE[op](str(a or ""), str(b or ""))
        if op == "has":
            return b in a
        a, b = number(a), number(b)
        if op == "/":
            return divide(a, b)
        if op == "%":
            return None if b == 0 else math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else abs(a) % abs(b) * (-1 if a < 0 else 1)
        return {"+": operator.add, "-": operator.sub, "*": operator.mul}[op](a, b)

    def _at(self, env: dict, node: tuple, index: tuple) -> object:
        x, i = self.run(node, env), self.run(index, env)
        if isinstance(x, dict):
            return x.get(i)
        i = int(number(i))
        return x[i] if x is not None and -len(x) <= i < len(x) else None

    def _dot(self, env: dict, node: tuple, name: str) -> object:
        return (self.run(node, env) or {}).get(name)

    def _call(self, env: dict, target: tuple, args: list) -> object:
        if target[0] == "dot":
            name, args = target[2], [target[1], *args]
        elif target[0] == "name":
            name = target[1]
        else:
            return self.run(target, env)(*[self.run(a, env) for a in args])
        f = env.get(name) or FUNCTIONS.get(name)
        if f is None:
            raise PlanError(f"no function {name!r} in a script")
        return f(*[self.run(a, env) for a in args])

    def _cast(self, env: dict, kind: str, node: tuple) -> object:
        x = self.run(node, env)
        return {"int": lambda: int(number(x)), "real": lambda: float(number(x)), "string": lambda: "" if x is None else str(x), "bool": lambda: truth(x)}[kind]()


def columns_of(node: object) -> list:
    """The column selectors of a tree."""
    if isinstance(node, tuple) and node and node[0] == "col":
        return [node[1]]
    return [c for x in node for c in columns_of(x)] if isinstance(node, (tuple, list)) else []


def script(source: str, table: Table, dtype: str = "double", constants: dict[str, object] | None = None) -> Column:
    """A column of type ``dtype`` from a formula that may loop; only the columns it names are sent to Python."""
    import pandas as pd

    tree = Parser(source, loops=True).program()
    specs = list(dict.fromkeys(columns_of(tree)))
    kinds = {"double": lambda v: None if v is None else float(number(v)), "bigint": lambda v: None if v is None else int(number(v)), "string": lambda v: None if v is None else str(v), "boolean": truth}
    if dtype not in kinds:
        raise PlanError(f"no type {dtype!r} for a script")
    shape = kinds[dtype]

    def one(row: dict) -> object:
        try:
            v = Evaluator(row).run(tree, dict(constants or {}))
        except Return as r:
            v = r.value
        return shape(v)

    def run(rows: pd.DataFrame) -> pd.Series:
        cells = [[x.item() if hasattr(x, "item") else x for x in rows[c]] for c in rows.columns[1:]]
        cells = [[None if isinstance(x, float) and math.isnan(x) else x for x in c] for c in cells]
        return pd.Series([one(dict(zip(specs, r))) for r in zip(*cells)] if cells else [one({}) for _ in range(len(rows))], dtype=object)

    udf = F.pandas_udf(run, dtype, F.PandasUDFType.SCALAR)
    return udf(F.struct(F.lit(0).alias("_"), *[table.col(table.index(s)).alias(f"p{i}") for i, s in enumerate(specs)]))
