import random

import pytest

from millrace.operators import clustering


def kruskal(edges):
    """Forest and a function for the clusters at a height, one edge after the other."""
    best = {}
    for u, v, w in edges:
        if None not in (u, v, w) and u != v and w == w:
            k = min(u, v), max(u, v)
            best[k] = min(w, best.get(k, w))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    forest = []
    for w, (u, v) in sorted((w, k) for k, w in best.items()):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((u, v, w))
    return sorted(forest)


def clusters(nodes, forest, height):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v, w in forest:
        if w <= height:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return sorted((n, find(n)) for n in nodes)


def random_graph(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(8))) for _ in range(90)]  # many ties and parallels
    return edges + [(5, 5, 0.0), (None, 3, 1.0), (4, None, 1.0), (4, 9, None), (1, 2, float("nan"))]


CHAIN = [(k, k + 1, float(k)) for k in range(200)]
HUB = [(0, k, float(k % 5)) for k in range(1, 300)] + [(k, k + 1, 2.5) for k in range(1, 299)]


@pytest.mark.parametrize("edges", [random_graph(1), random_graph(2), CHAIN, [(v, u, -w) for u, v, w in CHAIN], HUB], ids=["ties", "more", "rising", "falling", "hub"])
def test_forest_and_cut_equal_one_edge_after_the_other(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long, weight double")
    forest = clustering.spanning_forest(df)
    want = kruskal(edges)
    assert sorted(map(tuple, forest.collect())) == want
    nodes = sorted({n for e in edges for n in e[:2] if n is not None} | {1000})
    height = sorted(w for _, _, w in want)[len(want) // 2]
    got = clustering.cut(spark.createDataFrame([(n,) for n in nodes], "id long"), forest, height)
    assert sorted(map(tuple, got.collect())) == clusters(nodes, want, height)


def test_no_edges_and_repeated_nodes(spark):
    none = spark.createDataFrame([(7, 7, 1.0)], "u long, v long, weight double")
    forest = clustering.spanning_forest(none)
    assert forest.count() == 0
    nodes = spark.createDataFrame([(3,), (3,), (None,)], "id long")
    assert {tuple(r) for r in clustering.cut(nodes, forest, 5.0).collect()} == {(3, 3), (None, None)}


def test_a_forest_up_to_a_height(spark):
    edges = random_graph(3)
    df = spark.createDataFrame(edges, "u long, v long, weight double")
    height = sorted(w for _, _, w in kruskal(edges))[5]
    assert sorted(map(tuple, clustering.spanning_forest(df, height).collect())) == [e for e in kruskal(edges) if e[2] <= height]


def test_rounds_of_a_forest_aggregate_without_sorting(spark, monkeypatch):
    plans, real = [], clustering.materialize
    monkeypatch.setattr(clustering, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    clustering.spanning_forest(spark.createDataFrame([e for e in HUB if e[0] < 40], "u long, v long, weight double")).count()
    assert plans and not any("SortAggregate" in p for p in plans)
