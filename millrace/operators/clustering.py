"""Single-link clustering by a minimum spanning forest over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import prefix
from ..storage import drop, materialize


def _roots(choice: DataFrame) -> DataFrame:
    """label, root (written; the caller drops it) for each label of ``choice`` (label, other: the label across its lightest edge).

    Each label points across its edge; of two that point at each other the smaller stays.  Pointers then double until
    none moves, so the number of steps grows with the logarithm of the longest chain.
    """
    back = choice.select(F.col("label").alias("other"), F.col("other").alias("returns"))
    mutual = (F.col("returns") == F.col("label")) & (F.col("label") < F.col("other"))
    at = materialize(choice.join(back, "other", "left").select("label", F.when(mutual, F.col("label")).otherwise(F.col("other")).alias("root")))
    while True:
        beyond = at.select(F.col("label").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(beyond, "root").select("label", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        done = step.where("moved").isEmpty()
        drop(at)
        at = step
        if done:
            return at


def spanning_forest(edges: DataFrame, height: float | None = None) -> DataFrame:
    """u, v, weight of the minimum spanning forest of the undirected graph ``edges`` (u, v long, weight double).

    ``height``: only its edges up to this weight.  They are the forest of the graph's edges up to it, so heavier ones take
    part in no round.

    Boruvka's rounds: each component takes its lightest edge, components joined so become one, edges inside one go, and of
    parallel edges between two components the lightest stays, so the table shrinks and the rounds are a logarithm of the
    nodes.  Every round is written.  A hub is pre-aggregated, never a group of rows.  Ties go by weight, u, v, which makes
    the forest unique.  Loops and rows with a null or NaN don't count; parallel edges count once; no edges give no rows.
    """
    usable = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double")) & (F.col("u") != F.col("v"))
    a, b = F.least("u", "v"), F.greatest("u", "v")
    lightest = edges.where(usable).groupBy(a.alias("a"), b.alias("b")).agg(F.min(F.col("weight").cast("double")).alias("w"))
    lightest = lightest if height is None else lightest.where(F.col("w") <= height)
    # an edge's place in order of weight, u, v: one long, so that aggregates hash and don't sort
    lightest = materialize(lightest)
    ranked = prefix.ranged(lightest, [F.col("w"), F.col("a"), F.col("b")])
    drop(lightest)
    ranked = ranked.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("w").alias("weight"), (F.shiftleft(F.col(prefix.PART).cast("long"), 33) + F.col(prefix.AT)).alias("e"))
    left = materialize(ranked.select(F.col("u").alias("a"), F.col("v").alias("b"), "e"))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other"), "e"), F.struct(F.col("b").alias("label"), F.col("a").alias("other"), "e"))))
        choice = materialize(ends.groupBy("label").agg(F.min_by("other", "e").alias("other"), F.min("e").alias("e")))
        taken.append(materialize(choice.select("e").distinct()))
        roots = _roots(choice.select("label", "other"))
        ra, rb = (roots.select(F.col("label").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
        moved = left.join(ra, "a").join(rb, "b").where("ra <> rb")
        merged = moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e"))
        after = materialize(merged)
        drop(left, choice, roots)
        left = after
    drop(left)
    if not taken:
        return edges.where(F.lit(False)).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("weight").cast("double").alias("weight"))
    chosen = taken[0]
    for t in taken[1:]:
        chosen = chosen.unionAll(t)
    return ranked.join(chosen, "e", "left_semi").select("u", "v", "weight")


def cut(nodes: DataFrame, forest: DataFrame, height: float) -> DataFrame:
    """id, cluster (its least id) for each of ``nodes`` (id): single-link clusters at ``height``, weights up to it joining.

    ``forest`` is the result of ``spanning_forest``, whose cut at any height has the graph's own components.  Nodes without
    an edge are clusters of their own; a null id has a null cluster; repeated ids give one row.
    """
    near = forest.where(F.col("weight") <= height)
    label = materialize(near.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id")))
    left = materialize(near.select(F.col("u").alias("a"), F.col("v").alias("b")))
    while not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other")), F.struct(F.col("b").alias("label"), F.col("a").alias("other")))))
        roots = _roots(ends.groupBy("label").agg(F.min("other").alias("other")))
        ra, rb = (roots.select(F.col("label").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
        after = materialize(left.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        moved = materialize(label.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
        drop(left, label, roots)
        left, label = after, moved
    least = label.groupBy("label").agg(F.min("id").alias("cluster"))
    found = label.join(least, "label").select("id", "cluster")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
