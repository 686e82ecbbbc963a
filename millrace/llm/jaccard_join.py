"""N-gram Jaccard join in the metric space of shingle sets.

1. Sets.  Equal sets become one class.  Of each set only a prefix by hash order takes part in an exchange that tells
   which of its shingles occur elsewhere; a set with too few of them can link with nothing (the prefixes of two linked
   sets share at least ``overlap`` shingles) and is done.
2. Top regions.  Among the rest, sets that share one of their rarest prefix shingles are drawn to the least of them;
   the connected pieces are regions that no link leaves.
3. Pivots.  A region picks pivots and measures all members against them exactly.  A member that links with pivots
   belongs to the nearest one's Voronoi cell.  Jaccard distance is a metric: who links with a member of a cell is at most
   the cell's radius and a link's length from its pivot, so this window of unconnected members is replicated into the
   cell.  Cells with their windows, and what is in no cell, are joined recursively.  Members that links already connect
   aren't compared again.  A region too large for one task is cut the same way, distributed, until its parts aren't.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from . import base, exchange
from .components import components

WORDS, SHARE, EXTRA, WHOLE = 5, 75, 15, 96
#: Members and shingles of a region that one task joins; pivots of a local step and of a distributed round, at most.
MEMBERS, SHINGLES, PIVOTS, BLOCK = 6_000, 3 << 20, 16, 64
#: Share of a region that its cells have at most; slack for distances as floats.
SHRINK, TINY = 0.8, 1e-9
_SETS = "doc_id long, n long, f1 long, f2 long, shingles binary, common array<long>"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("shingles", pa.binary()), ("common", pa.list_(pa.int64()))])


def least_overlap(n, share: int):
    """Shingles that a set of ``n`` has in common with any set it links with, at least."""
    return (n * share + 99) // 100


def extra(n):
    """How many shingles beyond the shortest possible the prefix of a set of ``n`` holds; small sets are taken whole."""
    return np.minimum(np.maximum(1, least_overlap(n, 75)), np.maximum(WHOLE, n * EXTRA // 100))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of each text's set, one after the other, and where each begins."""
    w, offsets = base.split_words(pc.ascii_lower(texts))
    h = base.hash_words(w)
    text, _, after = base.places(offsets)
    n = np.diff(offsets)
    at = np.flatnonzero(after >= words - 1)
    grams, of = base.gram_hashes(h, words)[at] if len(at) else np.empty(0, np.uint64), text[at]
    short = np.flatnonzero((n > 0) & (n < words))
    lone = [int((h[offsets[i] : offsets[i + 1]] * np.array(base.COEFS[words : words + n[i]], np.uint64)).sum()) ^ int(n[i]) for i in short]
    grams, of = np.concatenate([grams, base.mix(np.array(lone, np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(texts) + 1))


def _prefix(offsets: np.ndarray, share: int) -> np.ndarray:
    """Which shingles are in their set's prefix."""
    n = np.diff(offsets)
    _, place, _ = base.places(offsets)
    return place < np.repeat(n - least_overlap(n, share) + extra(n), n)


def sets_of(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set) of each row; shingles and common (prefix shingles that occur elsewhere) where a link is possible."""
    total = base.text_bytes(docs)
    chunks = exchange.chunked(docs, total)
    n_buckets = exchange.buckets(total // 14)

    @base.tidy
    def send(key: tuple, t: pa.Table) -> pa.Table:
        grams, offsets = shingle_sets(exchange.column(t, "text"), words)
        return exchange.send(key[0].as_py(), grams[_prefix(offsets, share)], n_buckets)

    @base.tidy
    def survivors(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        known, _ = exchange.told(replies)
        grams, offsets = shingle_sets(exchange.column(t, "text"), words)
        n = np.diff(offsets)
        hit = _prefix(offsets, share) & exchange.found(grams, known)
        hits = np.concatenate([[0], np.cumsum(hit)])[offsets]
        alive = (n > 0) & (np.diff(hits) >= extra(least_overlap(n, share)))
        prints = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(base.mix(grams ^ np.uint64(salt)))])
            prints.append((sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64))
        common, blobs, lists = grams[hit].astype(np.int64), [], []
        for i, ok in enumerate(alive.tolist()):
            blobs.append(grams[offsets[i] : offsets[i + 1]].tobytes() if ok else None)
            lists.append(common[hits[i] : hits[i + 1]] if ok else None)
        return pa.Table.from_arrays([exchange.column(t, "doc_id"), pa.array(n), *map(pa.array, prints), pa.array(blobs, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], schema=_FIELDS)

    replies = exchange.tell(chunks.groupBy("chunk").applyInArrow(send, exchange.SENT))
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(survivors, _SETS)


def regions_of(reps: DataFrame, share: int = SHARE) -> DataFrame:
    """id, label: regions of ``reps`` (id, n, common) that no link leaves; ids that link with nothing are left out."""
    rows = reps.select("id", "n", F.explode("common").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    lists = rows.join(counts, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("l"))
    need = F.expr(f"(n * {share} + 99) div 100")
    spare = F.least(F.greatest(F.lit(1), F.floor((need * 75 + 99) / 100)), F.greatest(F.lit(WHOLE), F.floor(need * EXTRA / 100)))
    rarest = F.size("l") - spare.cast("int") + 1
    few = lists.where(rarest > 0).select("id", F.explode(F.transform(F.slice("l", 1, rarest), lambda x: x["shingle"])).alias("shingle"))
    few = base.save(few)
    heads = few.groupBy("shingle").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1")
    return components(few.join(heads, "shingle").where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct())


class Region:
    """Members of one region as sets over a local vocabulary, with what is connected so far."""

    def __init__(self, sets: list[np.ndarray], share: int):
        self.share, self.eps, self.cells = share, 1 - share / 100, 0
        self.size = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        vocabulary, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(vocabulary), np.int32)
        self.parent = np.arange(len(sets))

    def roots(self, m: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent[m]
            self.parent = up

    def measure(self, p: int, m: np.ndarray, index: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Distances of ``m`` from member ``p``; links found on the way are kept."""
        own = self.flat[self.starts[p] : self.starts[p + 1]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[index], cuts)
        self.mark[own] = 0
        union = self.size[m] + self.size[p] - both
        linked = np.unique(self.roots(np.append(m[100 * both >= self.share * union], p)))
        self.parent[linked] = linked[0]
        return 1 - both / union

    def join(self, m: np.ndarray) -> None:
        """Connects all links within ``m``."""
        while len(m) > 1:
            root = self.roots(m)
            names, counts = np.unique(root, return_counts=True)
            if len(names) == 1:
                return
            outside = m[root != names[np.argmax(counts)]]
            pivots = outside[:: -(-len(outside) // min(PIVOTS, max(1, math.isqrt(len(outside)))))]
            sizes = self.size[m]
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index = self.flat[np.repeat(self.starts[m] - cuts, sizes) + np.arange(sizes.sum())]
            d = np.stack([self.measure(int(p), m, index, cuts) for p in pivots])
            nearest, inside = d.argmin(axis=0), d.min(axis=0) <= self.eps + TINY
            root, cells = self.roots(m), []
            for j, p in enumerate(pivots):
                home = inside & (nearest == j)
                window = (d[j] <= d[j, home].max(initial=0) + self.eps + TINY) & ~home & (root != self.parent[p])
                if window.any():
                    cells.append(m[(home | window) & (m != p)])
            if sum(map(len, cells)) <= 2 * len(m) and max(map(len, cells), default=0) <= SHRINK * len(m):
                self.cells += len(pivots)
                for cell in cells:
                    self.join(cell)
                m = m[~inside]
            else:
                m = m[~np.isin(m, pivots)]


def _read(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def _local(share: int):
    """Joins whole regions: id, component for the members of a bucket of regions."""

    @base.tidy
    def run(key: tuple, t: pa.Table) -> pa.Table:
        label, ids = t["label"].to_numpy(), t["id"].to_numpy()
        order = np.lexsort((ids, label))
        cuts = np.flatnonzero(np.diff(label[order], prepend=label[order][:1] - 1)) if len(order) else []
        out = np.empty(len(ids), np.int64)
        for i, j in zip(cuts, [*cuts[1:], len(order)]):
            rows = order[i:j]
            region = Region(_read(t["shingles"].take(pa.array(rows)).to_pylist()), share)
            region.join(np.arange(len(rows)))
            out[rows] = ids[rows][region.roots(np.arange(len(rows)))]
        return pa.table({"id": ids, "component": out})

    return run


def _measured(share: int):
    """label, id, pivot, d of a slice of a region and a block of pivots, up to twice the distance of a link."""
    most = 2 * (1 - share / 100) + TINY

    @base.tidy
    def run(key: tuple, slice_: pa.Table, block: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if slice_.num_rows and block.num_rows:
            ids, sets = slice_["id"].to_numpy(), _read(slice_["shingles"].to_pylist())
            sizes = np.array([len(s) for s in sets])
            flat, cuts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for p, s in zip(block["id"].to_pylist(), _read(block["shingles"].to_pylist())):
                both = np.add.reduceat(exchange.found(flat, s).astype(np.int64), cuts)
                d = 1 - both / (sizes + len(s) - both)
                hit = d <= most
                out.append((ids[hit], np.full(int(hit.sum()), p), d[hit]))
        ids, pivots, d = (np.concatenate(x) for x in zip(*out))
        return pa.table({"label": pa.array([key[0].as_py()] * len(ids), pa.int64()), "id": ids, "pivot": pivots.astype(np.int64), "d": d})

    return run


def _linked(share: int):
    """u, v: a spanning forest of the links between a slice of a region and a block of its members, by an inverted index."""

    @base.tidy
    def run(key: tuple, slice_: pa.Table, block: pa.Table) -> pa.Table:
        ids, theirs = slice_["id"].to_numpy(), block["id"].to_numpy()
        if not len(ids) or not len(theirs):
            return pa.table({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        sets = _read(slice_["shingles"].to_pylist())
        sizes = np.array([len(s) for s in sets])
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        members = np.repeat(np.arange(len(sets)), sizes)[np.argsort(flat, kind="stable")]
        counts = np.bincount(flat, minlength=len(vocabulary))
        starts = np.cumsum(counts) - counts
        names = np.unique(np.concatenate([ids, theirs]))
        at, parent = np.searchsorted(names, ids), np.arange(len(names))

        def roots(m: np.ndarray) -> np.ndarray:
            up = parent[m]
            while (parent[up] != up).any():
                up = parent[up]
            parent[m] = up
            return up

        for p, s in zip(np.searchsorted(names, theirs), _read(block["shingles"].to_pylist())):
            own = np.searchsorted(vocabulary, s)
            own = own[vocabulary[np.minimum(own, len(vocabulary) - 1)] == s]
            n = counts[own]
            places = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(members[places], minlength=len(sets))
            hit = np.append(at[100 * both >= share * (sizes + len(s) - both)], p)
            hit = roots(hit)
            parent[hit] = hit.min()
        top = roots(np.arange(len(names)))
        own = top != np.arange(len(names))
        return pa.table({"u": names[own], "v": names[top[own]]})

    return run


def _all_links(regions: DataFrame, parts: DataFrame, met: DataFrame, share: int, shingles: int) -> DataFrame:
    """Links u, v between the members of regions (label, id, n, shingles, slices) that ``parts`` doesn't connect yet.

    Who is outside the largest part of a region meets all its members (but for ``met``: label, id, who have): a grid of
    slices and blocks of like size, so a task's memory is bounded and the whole is one round.  A task gives a row a member.
    """
    named = regions.select("label", "id").join(parts, "id")
    main = named.groupBy("label", "component").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    outside = base.save(named.join(main, "label").where("component <> main").select("label", "id").join(met, ["label", "id"], "left_anti"))
    rest = base.save(regions.join(outside, ["label", "id"]))  # written: both sides of the cogroup come from regions
    grid = base.save(rest.groupBy("label").agg(F.ceil(F.sum("n") * 4 / shingles).cast("int").alias("blocks"), F.first("slices").alias("n_slices")))
    tasks = min(int(grid.agg(F.coalesce(F.sum(F.col("blocks") * F.col("n_slices")), F.lit(0))).first()[0]), 10_000)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    cut = regions.join(grid.select("label", "blocks"), "label").select("label", "id", "shingles", part("slices", 0).alias("slice"), each("blocks").alias("block"))
    other = rest.join(grid.select("label", "blocks"), "label").select("label", "id", "shingles", each("slices").alias("slice"), part("blocks", 1).alias("block"))
    by = ["label", "slice", "block"]
    dealt = [x.repartition(max(1, tasks), *by).groupBy(*by) for x in (cut, other)]
    return base.save(dealt[0].cogroup(dealt[1]).applyInArrow(_linked(share), "u long, v long"))


def _large(regions: DataFrame, share: int, members: int, shingles: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Cuts regions (label, id, n, shingles) too large for one task into ones that aren't; also the links u, v met on the way.

    A round takes a block of pivots of each region from outside its largest connected part, and measures them against all
    members, slice by slice.  Members that link with a pivot belong to the nearest one's cell; a member is replicated into
    another cell as far as the cell's radius and the triangle inequality demand and nothing connects it yet.  Cells and
    what is in none go on as regions of their own, without the pivots, which have met all.  Where these wouldn't be smaller
    by a share (near copies that hardly link, or few that link at all), whoever is left is measured in one round.
    """
    eps, small, links = 1 - share / 100, [], []
    active = base.save(regions)
    parts = base.save(active.select("id", F.col("id").alias("component")).distinct())
    while True:
        tagged = active.select("label", "id", "n").join(parts, "id")
        sizes = tagged.groupBy("label", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        stats = sizes.groupBy("label").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("k"), F.sum("s").alias("s"))
        stats = base.save(stats.where("parts > 1").withColumn("slices", F.ceil(F.col("s") * 4 / shingles).cast("int")))
        big = (F.col("k") > members) | (F.col("s") > shingles)
        small.append(base.save(active.join(stats.where(~big).select("label"), "label", "left_semi")))
        stats = stats.where(big)
        if stats.isEmpty():
            return small, links
        rest = tagged.join(stats.select("label", "main"), "label").where("component <> main").select("label", "id")
        rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
        pivots = rest.withColumn("r", rank).where(F.col("r") <= BLOCK).select("label", "id")
        pivots = base.save(pivots.join(active, ["label", "id"]).join(stats.select("label", "slices"), "label"))
        cut = active.join(stats.select("label", "slices"), "label").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))
        block = pivots.select("label", "id", "shingles", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        near = cut.groupBy("label", "slice").cogroup(block.groupBy("label", "slice")).applyInArrow(_measured(share), "label long, id long, pivot long, d double")
        near = base.save(near)
        linked = F.col("d") <= eps + TINY
        met = base.save(near.where(linked & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct())
        links.append(met)
        name = lambda c, to: parts.select(F.col("id").alias(c), F.col("component").alias(to))  # noqa: E731, B023
        merged = components(met.join(name("u", "a"), "u").join(name("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
        parts = base.save(parts.join(merged.withColumnsRenamed({"id": "component", "label": "to"}), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        homes = base.save(near.where(linked).groupBy("label", "id").agg(F.min_by(F.struct(F.col("pivot").alias("home"), F.col("d").alias("r")), F.struct("d", "pivot")).alias("x")).select("label", "id", "x.*"))
        radius = homes.groupBy("label", F.col("home").alias("pivot")).agg(F.max("r").alias("r"))
        reach = near.join(radius, ["label", "pivot"]).where(F.col("d") <= F.col("r") + eps + TINY)
        reach = reach.join(homes.select("label", "id", F.col("home").alias("pivot")), ["label", "id", "pivot"], "left_anti")
        window = base.save(reach.join(name("id", "a"), "id").join(name("pivot", "b"), "pivot").where("a <> b").select("label", "id", "pivot"))
        met_windows = window.select("label", "pivot").distinct()
        inner = homes.select("label", "id", F.col("home").alias("pivot")).where("id <> pivot").join(met_windows, ["label", "pivot"], "left_semi")
        cells = base.save(inner.unionAll(window))
        by = cells.groupBy("label", "pivot").agg(F.count("*").alias("c")).groupBy("label").agg(F.sum("c").alias("all"), F.max("c").alias("most"))
        stats = stats.join(homes.groupBy("label").agg(F.count("*").alias("inside")), "label").join(by, "label", "left")
        smaller = (F.coalesce("most", F.lit(0)) <= SHRINK * F.col("k")) & (F.col("k") - F.col("inside") <= SHRINK * F.col("k"))
        stats = base.save(stats.select("label", "slices", ((F.coalesce("all", F.lit(0)) <= 2 * F.col("k")) & smaller).alias("split")))
        split, stuck = stats.where("split").select("label"), stats.where("not split").select("label", "slices")
        if not stuck.isEmpty():
            links.append(_all_links(active.join(stuck, "label"), parts, pivots.select("label", "id"), share, shingles))
        mine = active.join(split, "label", "left_semi")
        parts_of = cells.join(split, "label", "left_semi").select("label", "id", F.xxhash64("label", "pivot").alias("to"))
        in_cells = active.join(parts_of, ["label", "id"]).select(F.col("to").alias("label"), "id", "n", "shingles")
        out = homes.select("label", "id").join(split, "label", "left_semi").unionAll(pivots.select("label", "id"))
        last, active = active, base.save(in_cells.unionAll(mine.join(out.distinct(), ["label", "id"], "left_anti").select("label", "id", "n", "shingles")))
        storage.drop(last, near, pivots, window, cells)


def jaccard_components(docs: DataFrame, words: int = WORDS, share: int = SHARE, members: int = MEMBERS, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; others are ignored).

    Rows link when 100 * intersection >= ``share`` * union of their sets of ``words``-word shingles (A-Z lower-cased; fewer
    words: the whole sequence as one; no words or null text: empty, linked with nothing).  component_id is the smallest
    doc_id reachable by links.  Rows with a null doc_id link like others; where no row they reach has an id, theirs is
    null.  Rows that repeat a doc_id are one document: what one of them reaches, all do.  An empty table gives no rows.
    ``members`` and ``shingles`` say from where on a region is cut before one task joins it; they don't change results.
    Shingles are compared by 64-bit hashes: two sets of a thousand shingles have a false one in common once in 10**13 pairs.
    """
    sets = base.save(sets_of(docs.select("doc_id", "text"), words, share).withColumn("row", F.monotonically_increasing_id()))
    alive = sets.where(F.col("shingles").isNotNull())
    # a class of equal sets goes by its least row, whatever ids it has
    classes = base.save(alive.groupBy("n", "f1", "f2").agg(F.min("row").alias("id")))
    reps = base.save(alive.join(classes.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "shingles", "common"))
    regions = base.save(regions_of(reps, share))
    rows = base.save(reps.join(regions, "id").select("label", "id", "n", "shingles"))
    stats = base.save(rows.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("s")))
    big = (F.col("k") > members) | (F.col("s") > shingles)
    total, n_big = stats.agg(F.coalesce(F.sum("s"), F.lit(0)), F.count_if(big)).first()
    buckets = max(12, int(total) // (1 << 18) + 1)

    def joined(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets))).groupBy("bucket").applyInArrow(_local(share), "id long, component long")

    found = joined(rows.join(stats.where(~big).select("label"), "label", "left_semi"))
    if n_big:
        cells, links = _large(rows.join(stats.where(big).select("label"), "label", "left_semi"), share, members, shingles)
        edges = joined(reduce(DataFrame.unionAll, cells)).select(F.col("id").alias("u"), F.col("component").alias("v"))
        found = found.unionAll(components(reduce(DataFrame.unionAll, links, edges)))
    named = base.save(classes.join(found, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("part")))
    storage.drop(classes, reps, regions, rows, stats)
    # equal sets are one class; a hot one is split by AQE
    placed = alive.select("doc_id", "row", "n", "f1", "f2").join(named, ["n", "f1", "f2"]).select("doc_id", "row", "n", "part")
    placed = base.save(placed.unionAll(sets.where(F.col("shingles").isNull()).select("doc_id", "row", "n", F.col("row").alias("part"))))
    again = base.save(placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("part").alias("u"), F.max("part").alias("v"), F.count("*").alias("c")).where("u <> v").select("doc_id"))
    if not again.isEmpty():
        several = placed.join(again, "doc_id", "left_semi")
        edges = several.join(several.groupBy("doc_id").agg(F.min("part").alias("v")), "doc_id").select(F.col("part").alias("u"), "v")
        merged = components(edges).withColumnsRenamed({"id": "part", "label": "to"})
        placed = base.save(placed.join(merged, "part", "left").select("doc_id", "row", "n", F.coalesce("to", "part").alias("part")))
    least = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    out = placed.join(least, "part", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(base.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.d
)
SELECT r.d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
"""
