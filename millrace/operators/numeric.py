"""Numeric commands and list statistics: distances, entropies, transforms, trees, maps, mixtures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values as V
from ..plans.pipeline import command
from ..table import ROW, PlanError, Table
from .commands import _number, _rows, _table

#: Rows that one task takes for the algorithms that need all of them at once (trees, self-organising maps).
SMALL = 5_000

# distances of two lists


def distance(a: Column, b: Column, kind: str, p: float = 3.0) -> Column:
    """euclidean, manhattan, maximum, pnorm, canberra, cosine or pearson distance of two arrays of doubles."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    if kind == "euclidean":
        return F.sqrt(total(F.transform(gap, lambda d: d * d)))
    if kind == "manhattan":
        return total(gap)
    if kind == "maximum":
        return F.array_max(gap)
    if kind == "pnorm":
        return F.pow(total(F.transform(gap, lambda d: F.pow(d, F.lit(p)))), F.lit(1 / p))
    if kind == "canberra":
        return total(F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))
    if kind == "cosine":
        return 1 - F.call_function("try_divide", dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    if kind == "pearson":
        n = F.size(a)
        top = n * dot(a, b) - total(a) * total(b)
        return 1 - F.call_function("try_divide", top, F.sqrt((n * dot(a, a) - total(a) * total(a)) * (n * dot(b, b) - total(b) * total(b))))
    raise PlanError(f"no distance {kind!r}")


# shares


def diversity(df: DataFrame, keys: list[str], category: str, weight: Column | None = None) -> DataFrame:
    """Per key: n, richness, simpson, gini_simpson, shannon, shannon_norm and collision entropy of a category's shares."""
    w = weight if weight is not None else F.lit(1.0)
    counts = df.groupBy(*keys, category).agg(F.sum(w).cast("double").alias("w"))
    shares = counts.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("q"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w"))).alias("l"), F.count("*").alias("richness"))
    simpson, shannon = F.col("q") / (F.col("n") * F.col("n")), F.ln("n") - F.col("l") / F.col("n")
    return shares.select(
        *keys, "n", "richness", simpson.alias("simpson"), (1 - simpson).alias("gini_simpson"), shannon.alias("shannon"),
        F.when(F.col("richness") > 1, shannon / F.ln("richness")).otherwise(0.0).alias("shannon_norm"), (-F.ln(simpson)).alias("collision"),
    )


def describe(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per key: n, min, max, mean, median, mode, range, variance and deviation (population)."""
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).alias("median"),
        F.mode(c, True).alias("mode"), (F.max(c) - F.min(c)).alias("range"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("sd"),
    )


def peaks(df: DataFrame, keys: list[str], order: str, column: str, window: int = 5, threshold: float = 3.0) -> DataFrame:
    """Adds ``peak``: 1 above, -1 below ``threshold`` deviations of the ``window`` rows before, else 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    mean, sd, n = F.avg(column).over(w), F.stddev_pop(column).over(w), F.count(column).over(w)
    far = (n == window) & (F.abs(F.col(column) - mean) > threshold * sd)
    return df.withColumn("peak", F.when(far & (F.col(column) > mean), 1).when(far, -1).otherwise(0))


# commands


def _matrix(t: Table, cols: list[int], limit: int = SMALL) -> tuple[np.ndarray, list[int]]:
    """The cells of a bounded table as numbers (others 0), in row order."""
    t = t.numbered()
    rows = t.df.select(ROW, *[F.coalesce(_number(t, i), F.lit(0.0)).alias(f"x{k}") for k, i in enumerate(cols)]).orderBy(ROW).limit(limit + 1).collect()
    if len(rows) > limit:
        raise PlanError(f"more than {limit} rows")
    return np.array([[r[f"x{k}"] for k in range(len(cols))] for r in rows], float).reshape(len(rows), len(cols)), [r[ROW] for r in rows]


def _numbers_of(t: Table, arg: dict) -> list[int]:
    return [i for i in t.indexes(arg.get("colSet")) if V.is_number(t.types[i])]


@command("pca")
def pca(t: Table, arg: dict) -> Table:
    """Appends the scores pc1.. of the rows on the ``components`` (all) principal components of the covariance of colSet.

    The covariance is summed in Spark; only its square matrix reaches the driver.  Each vector's largest entry is positive.
    """
    cols = _numbers_of(t, arg)
    k = len(cols)
    x = [F.coalesce(_number(t, i), F.lit(0.0)) for i in cols]
    used = _rows(t, arg.get("rowSet"))
    y = [F.coalesce(_number(used, i), F.lit(0.0)) for i in cols]
    m = used.df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(y)], *[F.covar_pop(y[i], y[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cov = np.array([[m[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    vectors = np.linalg.eigh(cov)[1][:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    out = t.columns()
    for p in range(int(arg.get("components", k))):
        out.append((f"pc{p + 1}", sum(((x[i] - F.lit(m[f"m{i}"] or 0.0)) * float(vectors[i, p]) for i in range(k)), F.lit(0.0))))
    return t.with_columns(out)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A natural cubic spline through (x, y)."""
    n = len(x)
    h = np.diff(x)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        b[i] = (y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1]
    s = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, v = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return u * y[k] + v * y[k + 1] + ((u**3 - u) * s[k] + (v**3 - v) * s[k + 1]) * h[k] ** 2 / 6


@command("fourier")
def fourier(t: Table, arg: dict) -> Table:
    """harmonic, even, odd of each number column: natural-spline resampling over ``abscissa`` (or the rows) to a power of 2, unscaled."""
    cols = _numbers_of(t, arg)
    xcol = t.index(arg["abscissa"]) if "abscissa" in arg else None
    m, _ = _matrix(t, ([xcol] if xcol is not None else []) + [i for i in cols if i != xcol])
    x = m[:, 0] if xcol is not None else np.arange(len(m), dtype=float)
    rows = []
    for k, i in enumerate([i for i in cols if i != xcol]):
        y = m[:, k + (xcol is not None)]
        n = 1 << max(1, int(np.ceil(np.log2(max(2, len(y))))))
        z = spline(x, y, np.linspace(x[0], x[-1], n)) if len(y) > 2 else np.resize(y, n)
        f = np.fft.rfft(z)
        rows += [(t.names[i], h, float(f[h].real), float(-f[h].imag)) for h in range(len(f))]
    return _table(t.df.sparkSession.createDataFrame(rows, "column string, harmonic long, even double, odd double"), ["column", "harmonic"])


def distances(m: np.ndarray, kind: str) -> np.ndarray:
    a, b = m[:, None, :], m[None, :, :]
    kind = kind.lower()
    if kind == "manhattan":
        return abs(a - b).sum(-1)
    if kind == "maximum":
        return abs(a - b).max(-1, initial=0)
    if kind == "canberra":
        s = abs(a) + abs(b)
        return np.divide(abs(a - b), s, out=np.zeros_like(s), where=s > 0).sum(-1)
    if kind == "cosine":
        norm = np.sqrt((m * m).sum(-1))
        return 1 - np.divide(m @ m.T, norm[:, None] * norm, out=np.zeros((len(m), len(m))), where=(norm[:, None] * norm) > 0)
    if kind == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(-1))
    raise PlanError(f"no distance {kind!r}")


def linkage(d: np.ndarray, names: list[str], kind: str = "single") -> tuple[str, list[int]]:
    """A tree in Newick form and its leaf order: single or complete linkage, or neighbour joining (nj)."""
    d = d.astype(float).copy()
    nodes, order, height = list(names), [[i] for i in range(len(names))], [0.0] * len(names)
    while len(nodes) > 1:
        n = len(nodes)
        if kind == "nj" and n > 2:
            r = d.sum(axis=1)
            q = (n - 2) * d - r[:, None] - r
        else:
            q = d.copy()
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        if kind == "nj":
            li = d[i, j] / 2 + ((r[i] - r[j]) / (2 * (n - 2)) if n > 2 else 0)
            lj, merged = d[i, j] - li, (d[i] + d[j] - d[i, j]) / 2
            top = 0.0
        else:
            top = d[i, j] / 2
            li, lj = top - height[i], top - height[j]
            merged = np.minimum(d[i], d[j]) if kind == "single" else np.maximum(d[i], d[j])
        keep = [k for k in range(n) if k not in (i, j)]
        new = np.zeros((n - 1, n - 1))
        new[:-1, :-1] = d[np.ix_(keep, keep)]
        new[-1, :-1] = new[:-1, -1] = merged[keep]
        joined = f"({nodes[i]}:{li:.6g},{nodes[j]}:{lj:.6g})"
        nodes, order, height = [nodes[k] for k in keep] + [joined], [order[k] for k in keep] + [order[i] + order[j]], [height[k] for k in keep] + [top]
        d = new
    return (nodes[0] + ";" if nodes else ";"), (order[0] if order else [])


def _labels(t: Table, arg: dict, n: int) -> list[str]:
    if "labelCol" not in arg:
        return [f"row{i}" for i in range(n)]
    i = t.index(arg["labelCol"])
    return [str(r[0]) for r in t.df.orderBy(ROW).select(V.text(t.col(i), t.types[i])).limit(n).collect()]


@command("tree")
def tree(t: Table, arg: dict) -> Table:
    """One row: the rows' tree in Newick form.  distance: EUCLIDEAN, MANHATTAN, MAXIMUM, COSINE, CANBERRA; method: single, complete, nj."""
    used = _rows(t, arg.get("rowSet"))
    m, _ = _matrix(used, _numbers_of(t, arg))
    newick, _ = linkage(distances(m, arg.get("distance", "EUCLIDEAN")), _labels(used, arg, len(m)), arg.get("method", "nj"))
    return _table(t.df.sparkSession.createDataFrame([(newick,)], "newick string"), ["newick"])


@command("heatmap")
def heatmap(t: Table, arg: dict) -> Table:
    """The number columns scaled to 0..1, rows and columns in the leaf order of their trees."""
    cols = _numbers_of(t, arg)
    m, _ = _matrix(t, cols)
    kind, how = arg.get("distance", "EUCLIDEAN"), arg.get("method", "nj")
    rows = linkage(distances(m, kind), [str(i) for i in range(len(m))], how)[1]
    across = linkage(distances(m.T, kind), [str(i) for i in range(len(cols))], how)[1]
    low, high = (m.min(), m.max()) if m.size else (0.0, 1.0)
    scaled = (m - low) / (high - low if high > low else 1)
    labels = _labels(t, arg, len(m))
    data = [(k, labels[i], *map(float, scaled[i, across])) for k, i in enumerate(rows)]
    schema = "pos long, label string, " + ", ".join(f"v{i} double" for i in range(len(cols)))
    out = _table(t.df.sparkSession.createDataFrame(data, schema), ["pos"])
    names = ("pos", "label", *[t.names[cols[i]] for i in across])
    return Table(out.df, names)


@command("som")
def som(t: Table, arg: dict) -> Table:
    """Appends ``map_x``, ``map_y``: the cell of a self-organising map of mapSize x mapSize (seeded), trained on a bounded table."""
    cols = _numbers_of(t, arg)
    side, rounds, seed = int(arg.get("mapSize", 50)), int(arg.get("rounds", 10)), int(arg.get("seed", 1))
    m, _ = _matrix(t, cols)
    rng = np.random.default_rng(seed)
    lo, hi = (m.min(0), m.max(0)) if len(m) else (np.zeros(len(cols)), np.ones(len(cols)))
    span = np.where(hi > lo, hi - lo, 1)
    data, grid = (m - lo) / span, np.stack(np.meshgrid(np.arange(side), np.arange(side), indexing="ij"), -1).reshape(-1, 2)
    net = rng.random((side * side, len(cols)))
    for r in range(rounds):
        radius, rate = max(1.0, side / 2 * (1 - r / rounds)), 0.5 * (1 - r / rounds)
        for x in data[rng.permutation(len(data))]:
            best = ((net - x) ** 2).sum(1).argmin()
            near = np.exp(-((grid - grid[best]) ** 2).sum(1) / (2 * radius * radius))
            net += rate * near[:, None] * (x - net)
    names, flat = [f"c{i}" for i in cols], net

    def place(batches):
        for b in batches:
            x = (b[names].fillna(0).to_numpy(float) - lo) / span
            at = np.array([((flat - v) ** 2).sum(1).argmin() for v in x], int)
            yield b.assign(**{f"c{k}": at // side, f"c{k + 1}": at % side})

    k = len(t.names)
    schema = T.StructType([*t.df.schema.fields, T.StructField(f"c{k}", T.LongType()), T.StructField(f"c{k + 1}", T.LongType())])
    return Table(t.df.mapInPandas(place, schema), (*t.names, "map_x", "map_y"))


@command("simulation")
def simulation(t: Table, arg: dict) -> Table:
    """Fits a mixture of two discrete distributions to a category column by EM (10 rounds, 1e-3) and draws ``cnt`` samples (seeded).

    The table is pairs (row group, value): ``groupCol`` holds each unit, ``col`` its values.
    """
    g, v = t.index(arg.get("groupCol", 0)), t.index(arg.get("col", 1))
    counts = t.df.groupBy(V.text(t.col(g), t.types[g]).alias("g"), V.text(t.col(v), t.types[v]).alias("v")).count().orderBy("g", "v").limit(1_000_001).collect()
    if len(counts) > 1_000_000:
        raise PlanError("more than 1000000 units and values")
    units, values = sorted({r["g"] or "" for r in counts}), sorted({r["v"] or "" for r in counts})
    m = np.zeros((len(units), len(values)))
    for r in counts:
        m[units.index(r["g"] or ""), values.index(r["v"] or "")] = r["count"]
    rng = np.random.default_rng(int(arg.get("seed", 1)))
    share, p, before = np.array([0.5, 0.5]), rng.dirichlet(np.ones(len(values)), 2), -np.inf
    for _ in range(10):
        log = m @ np.log(p.T + 1e-12) + np.log(share)
        top = log.max(1, keepdims=True)
        r = np.exp(log - top)
        fit = float((top[:, 0] + np.log(r.sum(1))).sum())
        r /= r.sum(1, keepdims=True)
        share, p = r.mean(0), (r.T @ m + 1e-9) / (r.T @ m + 1e-9).sum(1, keepdims=True)
        if abs(fit - before) < 1e-3:
            break
        before = fit
    n = int(arg.get("cnt", 100))
    part = rng.choice(2, n, p=share / share.sum())
    rows = [(i, int(c), values[int(rng.choice(len(values), p=p[c] / p[c].sum()))]) for i, c in enumerate(part)]
    return _table(t.df.sparkSession.createDataFrame(rows, "sample long, component long, value string"), ["sample"])


def clusters(df: DataFrame, id_col: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """Adds ``cluster`` by k-means over an array column (distributed; Spark ML)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready).drop("_v")
