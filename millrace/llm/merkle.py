"""Merkle manifest of a dataset: mountain ranges over indexed partitions, merged where partitions meet.

Rows become leaves, in order within their group; runs of FANOUT nodes become their parent, up to one node a group, and
the groups' tops are the leaves of one more tree.  Leaves are indexed over range partitions.  Each partition keeps a
stack of mountains, one list a level: a pushed node that fills an aligned run emits the run's record and carries its
hash one level up; runs that begin or end in another partition leave as single peaks.  Peaks, at most 2 * (FANOUT - 1)
a level, group and partition, are merged level by level, by parent, where the last run may be short and isn't padded.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prefix
from . import base

FANOUT = 16
#: Levels at most: FANOUT ** LEVELS leaves a group.
LEVELS = 15
#: Leaves of a partition, about.
ROWS = 100_000
_MADE = "g string, level int, at long, children array<string>, peak boolean"
_SCHEMA = pa.schema([("g", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("children", pa.list_(pa.string())), ("peak", pa.bool_())])
_PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value; numbers in decimal."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Range:
    """The mountains over consecutive leaves of one group: a list a level of nodes whose run isn't full yet."""

    def __init__(self, group: str, out: list, fanout: int):
        self.group, self.out, self.fanout, self.held = group, out, fanout, []

    def push(self, index: int, node: str) -> None:
        level = 0
        while True:
            if level == len(self.held):
                self.held.append([])
            run = self.held[level]
            run.append(node)
            if (index + 1) % self.fanout:
                return
            if len(run) < self.fanout:  # the run began before this partition
                self._leave(level, index)
                return
            self.out.append((self.group, level, index // self.fanout, run, False))
            self.held[level] = []
            index, node, level = index // self.fanout, digest(run), level + 1

    def _leave(self, level: int, last: int) -> None:
        run, self.held[level] = self.held[level], []
        self.out.extend((self.group, level, last - len(run) + 1 + k, [h], True) for k, h in enumerate(run))

    def end(self, n: int) -> None:
        """After the leaf before index ``n``: what is held leaves as peaks."""
        for level in range(len(self.held)):
            self._leave(level, n // self.fanout**level - 1)


def mountains(fanout: int):
    """The stack over one partition's leaves (g, i, h): records of full runs, and peaks."""

    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("g", "ascending"), ("i", "ascending")])
        out: list = []
        current, n = None, 0
        for g, i, h in zip(t["g"].to_pylist(), t["i"].to_pylist(), t["h"].to_pylist()):
            if current is None or current.group != g:
                if current is not None:
                    current.end(n)
                current = Range(g, out, fanout)
            current.push(i, h)
            n = i + 1
        if current is not None:
            current.end(n)
        return pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out) if out else [[]] * 5, _SCHEMA)], schema=_SCHEMA)

    return run


def depth_of(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves."""
    out = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        out = F.when(n <= F.lit(fanout**k), F.lit(k)).otherwise(out)
    return out


def forest(leaves: DataFrame, order: list[Column], fanout: int = FANOUT, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """A tree for each ``g`` over ``leaves`` (g string, h hex string, further columns), in ``order``.

    Returns the leaves with their index ``i``, the records (g, level, at, children: the run of nodes of that level whose
    parent is number ``at``), the tops (g, depth, h) and the largest depth.
    """
    placed = base.save(prefix.running(leaves, ["g"], order, {"i": F.lit(1)}, rows))
    made = base.save(placed.select("g", "i", "h", prefix.PART).groupBy(prefix.PART).applyInArrow(mountains(fanout), _MADE))
    sizes = placed.groupBy("g").agg(F.count("*").alias("n")).select("g", depth_of(F.col("n"), fanout).alias("depth"))
    peaks = base.save(made.where("peak").select("g", "level", "at", F.col("children")[0].alias("h")).join(sizes, "g"))
    top = peaks.agg(F.max("depth")).first()[0] or 0
    records = made.where("not peak").select("g", "level", "at", "children")
    tops, up = peaks.where("level = depth").select("g", "depth", "h"), None
    for level in range(top):  # a step a level: the logarithm of the largest group
        here = peaks.where((F.col("level") == level) & (F.col("depth") > level)).select("g", "depth", "at", "h")
        here = here if up is None else here.unionByName(up.where(F.col("depth") > level).select("g", "depth", "at", "h"))
        runs = here.groupBy("g", "depth", F.floor(F.col("at") / fanout).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("run"))
        run = F.transform("run", lambda x: x["h"])
        up = base.save(runs.select("g", "depth", F.col("parent").alias("at"), run.alias("children"), F.sha2(F.array_join(run, ""), 256).alias("h")))
        records = records.unionByName(up.select("g", F.lit(level).alias("level"), "at", "children"))
        tops = tops.unionByName(up.where(F.col("depth") == level + 1).select("g", "depth", "h"))
    return placed, records, tops, top


def _sides(k: Column, fanout: int) -> Column:
    """The siblings of child ``k`` of a run."""
    return F.struct(F.array_join(F.slice("children", 1, k), "").alias("before"), F.array_join(F.slice("children", k + 2, fanout), "").alias("after"))


def runs_with_paths(records: DataFrame, tops: DataFrame, top: int, fanout: int = FANOUT) -> DataFrame:
    """For each run of leaves: g, at, children, lone (a leaf that is its group's top), top (the group's), path (the siblings before and
    after, level by level, from the run's parent up; ``above`` of ``tops`` goes on top)."""
    cur = None
    for level in range(top - 1, -1, -1):
        ctx = tops.where(F.col("depth") == level + 1).select("g", F.lit(0).cast("long").alias("at"), F.col("h").alias("top"), F.col("above").alias("path"))
        if cur is not None:
            split = cur.select("g", "at", "children", "top", "path", F.posexplode("children").alias("k", "node"))
            sides = _sides(F.col("k"), fanout)
            ctx = ctx.unionByName(split.select("g", (F.col("at") * fanout + F.col("k")).alias("at"), "top", F.concat(F.array(sides), "path").alias("path")))
        cur = records.where(F.col("level") == level).drop("level").join(ctx, ["g", "at"])
    lone = tops.where("depth = 0").select("g", F.lit(0).cast("long").alias("at"), F.array("h").alias("children"), F.col("h").alias("top"), F.col("above").alias("path"), F.lit(True).alias("lone"))
    return lone if cur is None else lone.unionByName(cur.withColumn("lone", F.lit(False)))


def with_paths(leaves: DataFrame, runs: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` with their own path and ``top``; at most ``fanout`` leaves meet a run, whatever the size of their group."""
    met = leaves.withColumn("at", F.floor(F.col("i") / fanout)).join(runs, ["g", "at"])
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(_sides((F.col("i") % fanout).cast("int"), fanout)), F.col("path")))
    return met.select(*leaves.columns, "top", path.alias("path"))


def fold(path: Column, leaf: Column) -> Column:
    """The hash at the end of a path of siblings from a leaf's hash."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(df: DataFrame, fields: list[str], group: str, order: str, carry: dict[str, Column] | None = None, fanout: int = FANOUT, rows: int = ROWS) -> DataFrame:
    """A row for each row of ``df``: ``order``, the columns of ``carry``, leaf, subroot, root and path.

    Leaves are the hashes of ``fields``; a tree for each value of ``group``, ascending by ``order`` (nulls first, ties by
    leaf: repeated rows are leaves of their own, and equal rows have equal hashes, so ties don't matter to any hash of
    nodes), and one over the groups' tops (null first, else by UTF-8 bytes).  ``path`` has the siblings before and after,
    level by level, from the leaf to the root: ``fold(path, leaf)`` is root.  Nulls in any column, empty and very long
    texts are values like others; an empty table has no rows.  Other columns are ignored.
    """
    own = {"k": F.col(order), "h": leaf_hash(*[F.col(c) for c in fields]), "g": F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")), **{f"_{n}": c for n, c in (carry or {}).items()}}
    leaves = base.save(df.select(*[c.alias(n) for n, c in own.items()]))
    placed, records, tops, top = forest(leaves, [F.col("k").asc_nulls_first(), F.col("h")], fanout, rows)
    tops = base.save(tops)
    groups, upper, roots, high = forest(tops.select(F.lit("").alias("g"), F.col("g").alias("k"), "h"), [F.col("k")], fanout, rows)
    root = roots.select("h").first()  # one row
    upper = runs_with_paths(upper, roots.select("g", "depth", "h", F.array().cast(_PATH).alias("above")), high, fanout)
    above = base.save(with_paths(groups, upper, fanout).select(F.col("k").alias("g"), F.col("path").alias("above")))
    runs = base.save(runs_with_paths(records, tops.join(above, "g"), top, fanout))
    named = [F.col("k").alias(order), *[F.col(f"_{n}").alias(n) for n in carry or {}], F.col("h").alias("leaf"), F.col("top").alias("subroot")]
    return with_paths(placed, runs, fanout).select(*named, F.lit(root[0] if root else None).cast("string").alias("root"), "path")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 5 divides are tampered with: A-Z of their text lower-cased; a null id is none of them."""
    docs = base.table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = leaf_hash(*[F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS])
    rows = manifest(docs, FIELDS, "source", "doc_id", {"tampered": F.when(picked, changed)})
    folded = rows.withColumn("folded_root", fold(F.col("path"), F.coalesce("tampered", "leaf")))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_levels(name: str, group: str, levels: int = 5) -> str:
    """Levels of trees over ``<name>0`` (group, i, h): nodes of each level with their index, their run's digest and siblings."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k}n AS (
    SELECT *, count(*) OVER (PARTITION BY {group}) AS n, i // 16 AS p FROM {name}{k}
), {name}{k}p AS (
    SELECT {group}, p, string_agg(h, '' ORDER BY i) AS run, any_value(n) AS n FROM {name}{k}n GROUP BY {group}, p
), {name}{k + 1} AS (
    SELECT {group}, p AS i, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS h FROM {name}{k}p
)""")
    return ", ".join(out)


def _sql_path(name: str, group: str, levels: int = 5) -> str:
    """The siblings before and after leaf ``i`` of every level, as lists; a level of one node gives null."""
    sides = ", ".join(f"CASE WHEN s{k}.n > 1 THEN substr(s{k}.run, 1, 64 * ((l.i // {16**k}) % 16)) END AS b{k}, CASE WHEN s{k}.n > 1 THEN substr(s{k}.run, 64 * ((l.i // {16**k}) % 16) + 65) END AS a{k}" for k in range(levels))
    joins = " ".join(f"JOIN {name}{k}p s{k} ON s{k}.{group} = l.{group} AND s{k}.p = l.i // {16 ** (k + 1)}" for k in range(levels))
    return f"SELECT l.{group}, l.i, {sides} FROM {name}0 l {joins}"


def _sql_leaf(text: str) -> str:
    parts = [text if c == "text" else f"{c}::VARCHAR" for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c})::VARCHAR || ':' || {c} END" for c in parts) + ")"


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # the checksum bit by bit: a byte is xored in, then eight steps by the polynomial
    crc = "xor(list_reduce(list_concat([4294967295], flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(doc_id::VARCHAR, '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    # levels are folded one after the other, each in a step of its own, so that the expression stays small
    steps, last = [], "f0"
    for p in ("d", "r"):
        for k in range(5):
            step = f"f{len(steps) + 1}"
            steps.append(f"{step} AS (SELECT * REPLACE (CASE WHEN {p}b{k} IS NULL THEN f ELSE sha256({p}b{k} || f || {p}a{k}) END AS f) FROM {last})")
            last = step
    named = ", ".join(f"{p}.{s}{k} AS {p}{s}{k}" for p in "dr" for k in range(5) for s in "ba")
    sibs = " || ".join(f"coalesce({p}{s}{k}, '')" for p in "dr" for k in range(5) for s in "ba")
    return f"""
WITH docs AS (
    SELECT doc_id, coalesce('=' || source, '') AS g, {_sql_leaf("text")} AS h,
        CASE WHEN {crc} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{upper}', '{upper.lower()}')")} END AS bad
    FROM documents
), t0 AS (
    SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, doc_id, bad FROM docs
), {_sql_levels("t", "g")}, s0 AS (
    SELECT 0 AS z, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g FROM t5
), {_sql_levels("s", "z")}, dp AS ({_sql_path("t", "g")}), rp AS ({_sql_path("s", "z")}), f0 AS (
    SELECT l.doc_id, l.h AS leaf, s0.h AS subroot, (SELECT h FROM s5) AS root, coalesce(l.bad, l.h) AS f, {named}
    FROM t0 l JOIN dp d ON d.g = l.g AND d.i = l.i JOIN s0 ON s0.g = l.g JOIN rp r ON r.i = s0.i
), {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({sibs}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}
"""


ORACLE_SQL = _sql()
