"""The Pitman-Yor model against a plain sequential version, and what can be counted exactly."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id, pitman_yor

END = object()


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(d, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in rows]


class Restaurants:
    """Customer by customer, one Gibbs step each, in plain dictionaries; the same discounts and strengths."""

    def __init__(self, rows, seed):
        self.rnd = random.Random(seed)
        pairs = [(u, w) for d, t in rows if not held(d) for u, w in zip([END, *tokens(t)], tokens(t))]
        words = Counter(w for _, w in pairs)
        once = lambda c: (sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
        self.d, self.d0 = pitman_yor.discount(*once(Counter(pairs))), pitman_yor.discount(*once(words))
        self.v = len(words)
        self.tables, self.parent = defaultdict(list), defaultdict(list)
        self.cu, self.tu, self.c0, self.t0 = Counter(), Counter(), 0, 0
        for p in pairs:
            self.enter(*p)
        for _ in range(3):
            for p in pairs:
                self.leave(*p)
                self.enter(*p)

    def base(self, w):
        return (sum(self.parent[w]) - self.d0 * len(self.parent[w]) + (1 + self.d0 * self.t0) / (self.v + 1)) / (1 + self.c0)

    def prob(self, u, w):
        own = self.tables[u, w]
        return (sum(own) - self.d * len(own) + (1 + self.d * self.tu[u]) * self.base(w)) / (1 + self.cu[u])

    def seat(self, tables, d, new):
        weights = [n - d for n in tables] + [new]
        k = self.rnd.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def unseat(self, tables):
        k = self.rnd.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def enter(self, u, w):
        self.cu[u] += 1
        if self.seat(self.tables[u, w], self.d, (1 + self.d * self.tu[u]) * self.base(w)):
            self.tu[u] += 1
            self.c0 += 1
            self.t0 += self.seat(self.parent[w], self.d0, (1 + self.d0 * self.t0) / (self.v + 1))

    def leave(self, u, w):
        self.cu[u] -= 1
        if self.unseat(self.tables[u, w]):
            self.tu[u] -= 1
            self.c0 -= 1
            self.t0 -= self.unseat(self.parent[w])


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    words = [f"W{int(rnd.paretovariate(0.7)) % 60}" for _ in range(400)]
    rows = []
    for i in range(160):
        w, text = rnd.choice(words), []
        for _ in range(rnd.randrange(1, 40)):
            text.append(w)
            w = words[(zlib.crc32(w.encode()) + rnd.randrange(6)) % len(words)] if rnd.random() < 0.7 else rnd.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(200, None), (201, ""), (None, "W1 W2 w1"), (202, "never seen\nbefore É"), (203, rows[3][1]), (203, rows[3][1]), (204, " \t"), (205, "W3 " * 20_000)]


@pytest.mark.parametrize("size", [{}, {"chunk_bytes": 300, "word_bytes": 20_000, "pair_bytes": 9_000}])
def test_counts_and_base_scores(spark, corpus, size):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("to", F.lit(1)).withColumn("train", F.lit("x")).repartition(3)
    got = pitman_yor.score(df, language_id.held_out(folds=10), **size).collect()
    n, want = plain_base(corpus)
    assert {r.train_tokens for r in got} == {n}
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((str(d), a, b, round(s, 6)) for d, a, b, s in want)
    assert all(r.held_out == held(r.doc_id) and r.score < 0 and abs(math.log10(r.perplexity) + r.score / r.n_tokens) < 1e-9 for r in got)


def test_scores_do_not_depend_on_chunks(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in pitman_yor.score(df.repartition(k), language_id.held_out(folds=10), chunk_bytes=c).collect()} for k, c in ((1, 1 << 20), (3, 500)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * -a[k] for k in a)


def test_against_the_sequential_sampler(spark, corpus):
    rows = corpus[:160]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), language_id.held_out(folds=10), sweeps=6, burn=2).collect()}
    models = [Restaurants(rows, seed) for seed in range(3)]
    for part in (False, True):
        own, other, n = 0, 0, 0
        for d, t in rows:
            if held(d) == part:
                own += got[d].score
                other += sum(math.log10(sum(m.prob(u, w) for m in models) / len(models)) for u, w in zip([END, *tokens(t)], tokens(t)))
                n += got[d].n_tokens
        assert n > 150 and abs(own - other) / n < 0.02
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_texts_of_one_word_have_at_most_all_of_the_probability(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "a a c", "b", "c a b a", "a"] * 4) if not held(i)]
    single = [(10_000 + i, w) for i, w in enumerate(["a", "b", "c", "new", ""])]
    docs = spark.createDataFrame(rows + single, "doc_id long, text string")
    got = {r.doc_id: r for r in pitman_yor.score(docs, F.col("doc_id") >= 10_000, sweeps=4, burn=3).collect()}
    first = sum(10 ** got[10_000 + i].score for i in range(5))
    assert 0.2 < first <= 1 + 1e-6


def test_seating_follows_the_restaurant():
    rng, n = np.random.default_rng(1), 4000
    for c, mass, d in ((5, 0.5, 0.4), (300, 0.2, 0.6)):
        growth, rnd, mean = 0.1, random.Random(4), 0
        got = pitman_yor.seat(np.full(n, c), np.full(n, mass), np.full(n, growth), d, rng).mean()
        for _ in range(800):
            t = 1
            for k in range(1, c):
                new = mass + growth * t
                t += rnd.random() < new / (k - d * t + new)
            mean += t / 800
        assert abs(got - mean) < 0.06 * mean


def test_nothing_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert pitman_yor.score(df.limit(0), F.lit(False)).collect() == []
    row = pitman_yor.score(df, F.lit(True)).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == 0.0
