"""Typed objects in an entity-attribute-value store: selection by type and fields, reference closure, wide tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import reach
from ..table import PlanError

#: Objects of a page that are broadcast at most.
PAGE = 10_000


class Catalog:
    """``objects``: obj_id, type; ``fields``: obj_id, name, grp, value; ``types``: name, parent (comma list), optional."""

    def __init__(self, objects: DataFrame, fields: DataFrame, types: DataFrame | None = None):
        self.objects, self.fields, self.types = objects, fields, types

    def descendants(self, pattern: str) -> DataFrame:
        """Types whose name matches the glob (* and ?), and all that inherit from them."""
        like = "^(" + "|".join(re.escape(p.strip()).replace(r"\*", ".*").replace(r"\?", ".") for p in pattern.split(",")) + ")$"
        if self.types is None:
            return self.objects.select("type").distinct().where(F.rlike("type", F.lit(like)))
        edges = self.types.select(F.explode(F.split(F.coalesce("parent", F.lit("")), " *, *")).alias("src"), F.col("name").alias("dst")).where("src <> ''")
        seeds = self.types.where(F.rlike("name", F.lit(like))).select(F.col("name").alias("seed"))
        return reach(seeds, edges).select(F.col("node").alias("type")).distinct()

    def matcher(self, spec: object) -> Column:
        """A field's test: a value, a list (any of), {method: equals|substring|regex, value}, or text ``^exact$`` / ``begins+``."""
        v = F.col("value")
        if isinstance(spec, list):
            out = F.lit(False)
            for s in spec:
                out = out | self.matcher(s)
            return out
        if isinstance(spec, dict):
            value, method = str(spec["value"]), spec.get("method", "equals")
            if method not in ("equals", "substring", "regex"):
                raise PlanError(f"no method {method!r}")
            return v == value if method == "equals" else F.contains(F.lower(v), F.lit(value.lower())) if method == "substring" else F.rlike(v, F.lit(value))
        s = str(spec)
        if s.startswith("^") and s.endswith("$"):
            return v == s[1:-1]
        return F.startswith(v, F.lit(s[:-1])) if s.endswith("+") else v == s

    def alloftype(self, types: str, where: dict[str, object] | None = None) -> DataFrame:
        """obj_id of the objects of these types whose fields all match; a semi-join for each field."""
        out = self.objects.join(self.descendants(types), "type", "left_semi").select("obj_id")
        for name, spec in (where or {}).items():
            hit = self.fields.where((F.col("name") == name) & self.matcher(spec)).select("obj_id")
            out = out.join(hit, "obj_id", "left_semi")
        return out

    def objoftype(self, ids: DataFrame, types: str) -> DataFrame:
        """Those of the objects that are of the types or inherit from them."""
        return ids.join(self.alloftype(types), "obj_id", "left_semi")

    def objs2(self, types: str, prop: str | None = None, value: object = None, props: list[str] | None = None, start: int = 0, cnt: int = 0) -> DataFrame:
        """A page of the objects of these types whose field ``prop`` matches ``value``, by descending id, with the fields ``props``."""
        return self.csv(self.alloftype(types, {prop: value} if prop else None), props or [], start, cnt)

    def objtype(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.objects, "obj_id").select("obj_id", "type")

    def validobj(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.objects, "obj_id", "left_semi")

    def edges(self, names: list[str]) -> DataFrame:
        """src, dst from the fields that hold object ids."""
        return self.fields.where(F.col("name").isin(names)).select(F.col("obj_id").alias("src"), F.col("value").alias("dst")).where("dst is not null")

    def allusedby(self, ids: DataFrame, names: list[str], depth: int | None = None, with_topic: bool = False) -> DataFrame:
        """obj_id, depth: what the objects reach over the reference fields, at least depth."""
        found = reach(ids.select(F.col("obj_id").alias("seed")), self.edges(names), depth).groupBy(F.col("node").alias("obj_id")).agg(F.min("depth").alias("depth"))
        return found if with_topic else found.where("depth > 0")

    def allthatuse(self, ids: DataFrame, names: list[str], depth: int | None = 1) -> DataFrame:
        back = self.edges(names).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return reach(ids.select(F.col("obj_id").alias("seed")), back, depth).where("depth > 0").groupBy(F.col("node").alias("obj_id")).agg(F.min("depth").alias("depth"))

    def props(self, ids: DataFrame) -> DataFrame:
        """obj_id, props: a map of each object's fields (several values of one field by comma, in order)."""
        one = self.fields.join(ids, "obj_id", "left_semi").groupBy("obj_id", "name").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("value"))
        return one.groupBy("obj_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("props"))

    def csv(self, ids: DataFrame, columns: list[str], start: int = 0, cnt: int = 0) -> DataFrame:
        """A wide table: obj_id and a column for each field, by descending id; ``a.b`` follows the reference in a to field b."""
        out, fields = ids, self.fields
        if cnt:  # the page first: only its objects' fields are read together
            out = ids.orderBy(F.desc("obj_id")).offset(start).limit(cnt)
            few = F.broadcast(out.select("obj_id")) if cnt <= PAGE else out.select("obj_id")
            fields = fields.join(few, "obj_id", "left_semi")
        direct = [c for c in columns if "." not in c]
        wide = fields.where(F.col("name").isin(direct)).groupBy("obj_id").pivot("name", direct).agg(F.min("value"))
        out = out.join(wide, "obj_id", "left")
        for c in (c for c in columns if "." in c):
            first, second = c.split(".", 1)
            link = fields.where(F.col("name") == first).select("obj_id", F.col("value").alias("_to"))
            there = self.fields.where(F.col("name") == second).select(F.col("obj_id").alias("_to"), F.col("value").alias(c))
            out = out.join(link.join(there, "_to").groupBy("obj_id").agg(F.min(f"`{c}`").alias(c)), "obj_id", "left")
        out = out.select("obj_id", *[F.col(f"`{c}`") for c in columns]).orderBy(F.desc("obj_id"))
        return out.offset(start) if start and not cnt else out


def object_search(
    objects: DataFrame, permissions: DataFrame, groups: DataFrame, object_filter: str | None = None, fields: DataFrame | None = None, field_filter: str | None = None,
    expired: int = 0, start: int = 0, cnt: int = 0, total: bool = False, now: Column | None = None,
) -> DataFrame:
    """obj_id, by descending id, of the objects that one of ``groups`` (group_id) has a row of ``permissions`` (group_id, obj_id) for.

    ``object_filter`` and ``field_filter`` are SQL conditions over objects and fields.  ``expired``: 0 those that aren't,
    1 those past ``soft_expiration`` only, 2 those past ``hard_expiration``, -1 all.  With ``total`` a column tells how
    many rows there were before paging; it costs a count of its own.
    """
    at = now if now is not None else F.current_timestamp()
    past = lambda c: F.coalesce(F.col(c) <= at, F.lit(False))
    out = objects.where(object_filter) if object_filter else objects
    if expired not in (-1, 0, 1, 2):
        raise PlanError(f"no expiry mode {expired}")
    if expired != -1:
        soft, hard = past("soft_expiration"), past("hard_expiration")
        out = out.where({0: ~soft & ~hard, 1: soft & ~hard, 2: hard}[expired])
    seen = permissions.join(groups, "group_id", "left_semi").select("obj_id")
    out = out.select("obj_id").join(seen, "obj_id", "left_semi")
    if field_filter:
        out = out.join(fields.where(field_filter).select("obj_id"), "obj_id", "left_semi")
    out = out.distinct()
    if total:
        out = out.withColumn("total", F.lit(out.count()))
    out = out.orderBy(F.desc("obj_id"))
    out = out.offset(start) if start else out
    return out.limit(cnt) if cnt else out


def permission_sum(permissions: DataFrame, groups: DataFrame, mask: int) -> DataFrame:
    """obj_id, perm: the sum over the groups' rows of ``permissions`` (group_id, obj_id, bits) of the bits under ``mask``."""
    seen = permissions.join(groups, "group_id", "left_semi")
    return seen.groupBy("obj_id").agg(F.sum(F.col("bits").bitwiseAND(mask)).cast("bigint").alias("perm"))


def search_string(text: str, columns: list[str]) -> Column:
    """``any has x and col isnt y or z is 3`` as a predicate: has, hasnt, is, isnt, begins, ends, above, below; ``any`` is any column."""
    words, out, join, k = re.findall(r'"[^"]*"|\S+', text), None, None, 0
    while k < len(words):
        if words[k].lower() in ("and", "or") and out is not None:
            join, k = words[k].lower(), k + 1
            continue
        if k + 2 >= len(words):
            raise PlanError(f"can't read {' '.join(words[k:])!r}")
        name, op, value = words[k], words[k + 1].lower(), words[k + 2].strip('"')
        if name != "any" and name not in columns:
            raise PlanError(f"no column {name!r}")
        test = None
        for c in columns if name == "any" else [name]:
            s = F.coalesce(F.col(c).cast("string"), F.lit(""))
            n = s.try_cast("double")
            made = {
                "has": lambda: F.contains(F.lower(s), F.lit(value.lower())), "hasnt": lambda: ~F.contains(F.lower(s), F.lit(value.lower())),
                "is": lambda: s == value, "isnt": lambda: s != value, "begins": lambda: F.startswith(s, F.lit(value)), "ends": lambda: F.endswith(s, F.lit(value)),
                "above": lambda: F.coalesce(n > float(value), F.lit(False)), "below": lambda: F.coalesce(n < float(value), F.lit(False)),
            }.get(op)
            if made is None:
                raise PlanError(f"no word {op!r}")
            test = made() if test is None else test | made()
        out = test if out is None else out & test if join != "or" else out | test
        k += 3
    return out if out is not None else F.lit(True)
