"""The expression language: text -> syntax tree -> typed Spark columns.

``$0`` and ``$name`` are columns of the row; lists, dictionaries, regexes, ranges of a list, lambdas with one returned
expression, ``as`` casts and any-of junctions (``x == 1 | 2``) compile to built-in functions.  Loops and writes have
no column form and are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..table import ROW, PlanError, Table

TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|\d+(?:[eE][-+]?\d+)?)
    |(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<col>\$(?:\d+|[A-Za-z_]\w*))
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><=>|==|!=|<=|>=|=~|!~|&&|\|\||\+\+|--|[-+*/%]=|[-+*/%<>!?:.,;()\[\]{}|=$]))""",
    re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
LEVELS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "=~": 3, "!~": 3, "has": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "<=>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
CASTS = ("bool", "int", "uint", "intlist", "real", "string", "datetime", "date", "time")


class Parser:
    """Precedence climbing over the tokens; the tree is made of tuples (kind, ...)."""

    def __init__(self, source: str, loops: bool = False):
        self.source, self.tokens, self.at, self.loops = source, [], 0, loops
        pos, source = 0, source.rstrip()
        while pos < len(source):
            if self.expects_operand() and (m := re.compile(r"\s*/((?:[^/\\\n]|\\.)+)/(i?)").match(source, pos)):
                self.tokens.append(("regex", (m[1], m[2])))
            elif m := TOKEN.match(source, pos):
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            else:
                raise PlanError(f"can't read {source[pos:pos + 20]!r} in {source!r}")
            pos = m.end()
        self.tokens.append(("end", ""))

    def expects_operand(self) -> bool:
        return not self.tokens or self.tokens[-1][0] == "op" and self.tokens[-1][1] not in (")", "]", "}") or self.tokens[-1] == ("name", "return")

    def peek(self, *ops: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("op", "name") and value in ops

    def take(self, *ops: str) -> bool:
        if self.peek(*ops):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise PlanError(f"{op!r} expected before {self.tokens[self.at][1]!r} in {self.source!r}")

    def program(self) -> tuple:
        body = self.statements("end")
        if self.tokens[self.at][0] != "end":
            raise PlanError(f"can't read {self.tokens[self.at][1]!r} in {self.source!r}")
        return body

    def statements(self, stop: str) -> tuple:
        out = []
        while not (self.tokens[self.at][0] == "end" or self.peek(stop)):
            if self.take(";"):
                continue
            out.append(self.statement())
        return ("block", out)

    def statement(self) -> tuple:
        if self.peek("for", "while", "break", "continue"):
            if not self.loops:
                raise PlanError(f"{self.tokens[self.at][1]} has no column form")
            return self.loop()
        if self.take("if"):
            return self.branch()
        if self.take("return"):
            return ("return", self.expression())
        name, after = self.tokens[self.at], self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else ("end", "")
        if name[0] == "name" and after[0] == "op" and (after[1] in ("=", "++", "--") or len(after[1]) == 2 and after[1] in ("+=", "-=", "*=", "/=", "%=")):
            self.at += 2
            if after[1] == "=":
                return ("let", name[1], self.expression())
            right = ("lit", 1) if after[1] in ("++", "--") else self.expression()
            return ("let", name[1], ("op", after[1][0], ("name", name[1]), right))
        return self.expression()

    def loop(self) -> tuple:
        word = self.tokens[self.at][1]
        self.at += 1
        if word in ("break", "continue"):
            return (word,)
        self.need("(")
        first = ("block", [])
        if word == "for":
            first = self.statement() if not self.peek(";") else first
            self.need(";")
        test = self.expression() if not self.peek(";", ")") else ("lit", True)
        step = ("block", [])
        if word == "for":
            self.need(";")
            step = self.statement() if not self.peek(")") else step
        self.need(")")
        return ("loop", first, test, step, self.body())

    def branch(self) -> tuple:
        self.need("(")
        test = self.expression()
        self.need(")")
        yes = self.body()
        no = ("block", [])
        if self.take("else"):
            no = ("block", [self.branch()]) if self.take("if") else self.body()
        return ("if", test, yes, no)

    def body(self) -> tuple:
        if self.take("{"):
            out = self.statements("}")
            self.need("}")
            return out
        out = self.statement()
        self.take(";")
        return ("block", [out])

    def expression(self) -> tuple:
        test = self.binary(1)
        if self.take("?"):
            yes = self.expression()
            self.need(":")
            return ("cond", test, yes, self.expression())
        return test

    def binary(self, level: int) -> tuple:
        left = self.unary()
        while True:
            op = self.tokens[self.at][1] if self.tokens[self.at][0] in ("op", "name") else ""
            if LEVELS.get(op, 0) < level:
                return left
            self.at += 1
            right = self.binary(LEVELS[op] + 1)
            if op in ("==", "!="):
                options = [right]
                while self.take("|"):
                    options.append(self.binary(LEVELS[op] + 1))
                left = ("equal", op, left, options)
            else:
                left = ("op", op, left, right)

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("op", "-", ("lit", 0), self.unary())
        if self.take("+"):
            return ("op", "+", ("lit", 0), self.unary())
        if self.peek("(") and self.tokens[self.at + 1][0] == "name" and self.tokens[self.at + 1][1] in CASTS and self.tokens[self.at + 2] == ("op", ")"):
            self.at += 3
            return ("cast", self.tokens[self.at - 2][1], self.unary())
        return self.postfix(self.primary())

    def arguments(self, stop: str) -> list[tuple]:
        out = []
        while not self.take(stop):
            out.append(self.expression())
            if not self.peek(stop):
                self.need(",")
        return out

    def postfix(self, node: tuple) -> tuple:
        while True:
            if self.take("("):
                node = ("call", node, self.arguments(")"))
            elif self.take("["):
                low = None if self.peek(":") else self.expression()
                if self.take(":"):
                    high = None if self.peek("]") else self.expression()
                    self.need("]")
                    node = ("slice", node, low, high)
                else:
                    self.need("]")
                    node = ("at", node, low)
            elif self.take("."):
                node = ("dot", node, self.tokens[self.at][1])
                self.at += 1
            elif self.take("as"):
                name = self.tokens[self.at][1]
                self.at += 1
                if self.take("("):
                    node = ("call", ("dot", node, name), self.arguments(")"))
                else:
                    node = ("cast", name, node)
            else:
                return node

    def primary(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("lit", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "regex":
            return ("regex", *value)
        if kind == "col":
            return ("col", int(value[1:]) if value[1:].isdigit() else value[1:])
        if kind == "name":
            if value in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[value])
            if value == "function":
                self.need("(")
                names = [n[1] for n in self.arguments(")")]
                return ("lambda", names, self.body())
            return ("name", value)
        if value == "(":
            node = self.expression()
            self.need(")")
            return node
        if value == "[":
            return ("list", self.arguments("]"))
        if value == "{":
            pairs = []
            while not self.take("}"):
                k = self.tokens[self.at]
                self.at += 1
                self.need(":")
                pairs.append((k[1][1:-1] if k[0] == "str" else k[1], self.expression()))
                if not self.peek("}"):
                    self.need(",")
            return ("dict", pairs)
        if value == "$" and self.take("("):
            node = self.expression()
            self.need(")")
            return ("dyncol", node)
        raise PlanError(f"can't read {value!r} in {self.source!r}")


def parse(source: str) -> tuple:
    return Parser(source).program()


def has_loops(source: str) -> bool:
    """Whether a formula holds a for or while, which only a script can run."""
    if not re.search(r"\b(for|while)\b", source):
        return False
    inside = lambda node: isinstance(node, (tuple, list)) and ((len(node) > 0 and node[0] == "loop") or any(map(inside, node)))
    return inside(Parser(source, loops=True).program())


def columns_read(source: str) -> list[int | str]:
    """The columns a formula names, each once."""

    def inside(node: object) -> list[int | str]:
        if not isinstance(node, (tuple, list)):
            return []
        return [node[1]] if len(node) == 2 and node[0] == "col" and isinstance(node[1], (int, str)) else [c for n in node for c in inside(n)]

    return list(dict.fromkeys(inside(parse(source))))


@dataclass(frozen=True)
class Typed:
    col: Column
    dtype: str
    const: object = None


@dataclass(frozen=True)
class Lambda:
    names: list[str]
    body: tuple
    env: dict


def element_of(dtype: str) -> str:
    return dtype[6:-1] if dtype.startswith("array<") else "string"


def value_of(dtype: str) -> str:
    depth = 0
    for i, ch in enumerate(dtype):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 1:
            return dtype[i + 1 : -1]
    return "string"


def wider(kinds: list[str]) -> str:
    """The common type of list elements: numbers widen, anything mixed is text."""
    kinds = [k for k in kinds if k != "void"] or ["string"]
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(map(V.is_int, kinds)):
        return "bigint"
    return "double" if all(map(V.is_number, kinds)) else "string"


def literal(v: object) -> Typed:
    if v is None:
        return Typed(F.lit(None), "void", v)
    kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    return Typed(F.lit(v).cast(kind), kind, v)


def to_text(x: Typed) -> Column:
    return V.text(x.col, x.dtype)


def recast(x: Typed, dtype: str) -> Column:
    if x.dtype == dtype:
        return x.col
    if dtype == "string":
        return to_text(x)
    if dtype == "double":
        return V.maybe_num(x.col, x.dtype)
    return x.col.cast(dtype)


class Compiler:
    """Compiles trees over one table.  ``constants``: names with fixed values (predefined ones)."""

    def __init__(self, table: Table | None, constants: dict[str, object] | None = None):
        self.table, self.constants = table, {k: literal(v) for k, v in (constants or {}).items()}

    def formula(self, source: str) -> Typed:
        return self.run(parse(source), dict(self.constants))

    def condition(self, source: str) -> Column:
        x = self.formula(source)
        return V.truthy(x.col, x.dtype)

    def run(self, node: tuple, env: dict) -> Typed:
        return getattr(self, "_" + node[0])(env, *node[1:])

    def _block(self, env: dict, body: list[tuple]) -> Typed:
        env, last = dict(env), literal(None)
        for i, node in enumerate(body):
            if node[0] == "let":
                env[node[1]] = self.run(node[2], env)
            elif node[0] == "return":
                return self.run(node[1], env)
            elif node[0] == "if" and i + 1 < len(body):
                rest = body[i + 1 :]  # what follows goes on from either branch, with the names it sets
                return self._if(env, node[1], *[("block", [*b[1], *rest]) for b in node[2:]])
            else:
                last = self.run(node, env)
        return last

    def _return(self, env: dict, node: tuple) -> Typed:
        return self.run(node, env)

    def _if(self, env: dict, test: tuple, yes: tuple, no: tuple) -> Typed:
        return self._cond(env, test, yes, no)

    def _lit(self, env: dict, v: object) -> Typed:
        return literal(v)

    def _regex(self, env: dict, pattern: str, flag: str) -> Typed:
        return Typed(F.lit(("(?i)" if flag else "") + pattern), "string", ("(?i)" if flag else "") + pattern)

    def _col(self, env: dict, spec: object) -> Typed:
        if self.table is None:
            raise PlanError("no row here")
        i = self.table.index(spec)
        return Typed(self.table.col(i), self.table.types[i])

    def _dyncol(self, env: dict, node: tuple) -> Typed:
        x = self.run(node, env)
        if x.const is None:
            raise PlanError("$(...) needs a constant")
        return self._col(env, x.const)

    def _name(self, env: dict, name: str) -> Typed | Lambda:
        if name in env:
            return env[name]
        if name == "cur_row":
            return Typed(F.col(ROW), "bigint")
        raise PlanError(f"no name {name!r}")

    def _lambda(self, env: dict, names: list[str], body: tuple) -> Lambda:
        return Lambda(names, body, env)

    def _list(self, env: dict, items: list[tuple]) -> Typed:
        xs = [self.run(n, env) for n in items]
        kind = wider([x.dtype for x in xs])
        return Typed(F.array(*[recast(x, kind) for x in xs]).cast(f"array<{kind}>"), f"array<{kind}>", [x.const for x in xs] if all(x.const is not None for x in xs) else None)

    def _dict(self, env: dict, pairs: list) -> Typed:
        xs = [self.run(n, env) for _, n in pairs]
        kind = wider([x.dtype for x in xs])
        kv = [c for (k, _), x in zip(pairs, xs) for c in (F.lit(k), recast(x, kind))]
        return Typed(F.create_map(*kv).cast(f"map<string,{kind}>"), f"map<string,{kind}>", {k: x.const for (k, _), x in zip(pairs, xs)})

    def _cond(self, env: dict, test: tuple, yes: tuple, no: tuple) -> Typed:
        t, a, b = self.run(test, env), self.run(yes, env), self.run(no, env)
        kind = wider([a.dtype, b.dtype])
        return Typed(F.when(V.truthy(t.col, t.dtype), recast(a, kind)).otherwise(recast(b, kind)), kind)

    def _not(self, env: dict, node: tuple) -> Typed:
        x = self.run(node, env)
        return Typed(~V.truthy(x.col, x.dtype), "boolean")

    def _equal(self, env: dict, op: str, left: tuple, options: list[tuple]) -> Typed:
        a, any_of = self.run(left, env), None
        for o in options:
            b = self.run(o, env)
            same = V.equal(a.col, a.dtype, b.col, b.dtype)
            any_of = same if any_of is None else any_of | same
        return Typed(any_of if op == "==" else ~any_of, "boolean")

    def _op(self, env: dict, op: str, left: tuple, right: tuple) -> Typed:
        a, b = self.run(left, env), self.run(right, env)
        if op in ("&&", "||"):
            x, y = V.truthy(a.col, a.dtype), V.truthy(b.col, b.dtype)
            return Typed(x & y if op == "&&" else x | y, "boolean")
        if op in ("<", ">", "<=", ">="):
            return Typed(V.compare(a.col, a.dtype, b.col, b.dtype, op), "boolean")
        if op == "<=>":
            less, more = (V.compare(a.col, a.dtype, b.col, b.dtype, o) for o in ("<", ">"))
            return Typed(F.when(less, -1).when(more, 1).otherwise(0).cast("bigint"), "bigint")
        if op in ("=~", "!~"):
            return self.match(op, a, b)
        if op == "has":
            return self.has(a, b)
        both_int = V.is_int(a.dtype) and V.is_int(b.dtype)
        x, y = V.num(a.col, a.dtype), V.num(b.col, b.dtype)
        if op == "/":
            return Typed(*V.divide(a.col, a.dtype, b.col, b.dtype))
        if op == "%":
            return Typed(F.when(y == 0, F.lit(None)).otherwise(F.call_function("try_mod", x, y)), "bigint" if both_int else "double")
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return Typed(made, "bigint" if both_int else "double")

    def match(self, op: str, a: Typed, b: Typed) -> Typed:
        subject = F.coalesce(to_text(a), F.lit(""))
        if b.const is None:
            raise PlanError("a regex must be constant")
        found = F.rlike(subject, F.lit(str(b.const)))
        if op == "!~":
            return Typed(~found, "boolean")
        groups = re.compile(str(b.const)).groups
        parts = F.array(*[F.regexp_extract(subject, str(b.const), g) for g in range(groups + 1)])
        return Typed(F.when(found, parts).otherwise(F.array().cast("array<string>")), "array<string>")

    def has(self, a: Typed, b: Typed) -> Typed:
        if a.dtype.startswith("map"):
            return Typed(F.coalesce(F.map_contains_key(a.col, to_text(b)), F.lit(False)), "boolean")
        if a.dtype.startswith("array"):
            return Typed(F.exists(a.col, lambda x: V.equal(x, element_of(a.dtype), b.col, b.dtype)), "boolean")
        raise PlanError("has needs a list or a dictionary")

    def _cast(self, env: dict, kind: str, node: tuple) -> Typed:
        x = self.run(node, env)
        if kind == "bool":
            return Typed(V.truthy(x.col, x.dtype), "boolean")
        if kind == "int":
            return Typed(V.num(x.col, x.dtype).cast("bigint"), "bigint")
        if kind == "uint":
            return Typed(F.greatest(V.num(x.col, x.dtype).cast("bigint"), F.lit(0).cast("bigint")), "bigint")
        if kind == "real":
            return Typed(V.num(x.col, x.dtype).cast("double"), "double")
        if kind == "string":
            return Typed(F.coalesce(to_text(x), F.lit("")), "string")
        if kind == "intlist":
            parts = F.filter(F.split(to_text(x), "[,; ]+"), lambda p: F.rlike(p, F.lit(r"^\d+(-\d+)?$")))
            runs = F.transform(parts, lambda p: F.sequence(F.substring_index(p, "-", 1).cast("bigint"), F.substring_index(p, "-", -1).cast("bigint")))
            return Typed(F.flatten(runs), "array<bigint>")
        if kind == "date":
            return Typed(x.col.try_cast("date"), "date")
        if kind == "datetime":
            return Typed(x.col.try_cast("timestamp"), "timestamp")
        if kind == "time":
            p = F.split(to_text(x), ":")
            part = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
            return Typed(part(0) * 3600 + part(1) * 60 + part(2), "bigint")
        raise PlanError(f"no cast to {kind!r}")

    def _at(self, env: dict, node: tuple, index: tuple) -> Typed:
        x, i = self.run(node, env), self.run(index, env)
        if x.dtype.startswith("map"):
            return Typed(F.try_element_at(x.col, to_text(i)), value_of(x.dtype))
        k = V.num(i.col, i.dtype).cast("int")
        place = F.when(k < 0, k).otherwise(k + 1)
        if x.dtype.startswith("array"):
            return Typed(F.try_element_at(x.col, place), element_of(x.dtype))
        s = F.coalesce(to_text(x), F.lit(""))
        inside = (k < F.length(s)) & (k >= -F.length(s))
        return Typed(F.when(inside, F.substr(s, place, F.lit(1))), "string")

    def _slice(self, env: dict, node: tuple, low: tuple | None, high: tuple | None) -> Typed:
        """Inclusive; negative places count from the end; turned round where the first is after the second."""
        x = self.run(node, env)
        listed = x.dtype.startswith("array")
        whole = x.col if listed else F.coalesce(to_text(x), F.lit(""))
        n = F.size(whole) if listed else F.length(whole)

        def place(end: tuple | None, default: Column) -> Column:
            if end is None:
                return default
            k = self.run(end, env)
            k = V.num(k.col, k.dtype).cast("int")
            return F.least(F.greatest(F.when(k < 0, k + n).otherwise(k), F.lit(0)), n - 1)

        a, b = place(low, F.lit(0)), place(high, n - 1)
        lo, hi = F.least(a, b), F.greatest(a, b)
        part = F.slice(whole, lo + 1, hi - lo + 1) if listed else F.substr(whole, lo + 1, hi - lo + 1)
        empty = F.array().cast(x.dtype) if listed else F.lit("")
        return Typed(F.when(n == 0, empty).when(a > b, F.reverse(part)).otherwise(part), x.dtype if listed else "string")

    def _dot(self, env: dict, node: tuple, name: str) -> Typed:
        x = self.run(node, env)
        if x.dtype.startswith("map"):
            return Typed(F.try_element_at(x.col, F.lit(name)), value_of(x.dtype))
        if x.dtype.startswith("struct"):
            return Typed(x.col[name], "string")
        raise PlanError(f"no property {name!r} of {x.dtype}")

    def _call(self, env: dict, target: tuple, args: list[tuple]) -> Typed:
        from .library import FUNCTIONS

        if target[0] == "dot":
            name, args = target[2], [target[1], *args]
        elif target[0] == "name":
            name = target[1]
            if isinstance(env.get(name), Lambda):
                return self.apply(env[name], [self.run(a, env) for a in args])
        elif target[0] == "lambda":
            return self.apply(self._lambda(env, *target[1:]), [self.run(a, env) for a in args])
        else:
            raise PlanError("only names can be called")
        if name not in FUNCTIONS:
            raise PlanError(f"no function {name!r}")
        return FUNCTIONS[name](self, [self.run(a, env) for a in args])

    def apply(self, f: Lambda, xs: list[Typed]) -> Typed:
        return self.run(f.body, {**f.env, **dict(zip(f.names, xs)), **({"topic": xs[0]} if xs else {})})


def compile_formula(source: str, table: Table | None = None, constants: dict[str, object] | None = None) -> Typed:
    return Compiler(table, constants).formula(source)


Function = Callable[[Compiler, list], Typed]
