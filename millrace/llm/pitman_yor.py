"""A hierarchical Pitman-Yor bigram model, sampled by Gibbs over the whole corpus, and the texts' probabilities under it.

Every word that comes before another is a restaurant whose customers are the words after it; the tables of all these
restaurants are the customers of the one parent they share, and its base is uniform over the words and one place for
unknown ones.  A sweep seats all customers of a (context, word) anew, given the tables of the sweep before: the k-th
customer opens a table with the probability of the Chinese restaurant process.  All contexts are sampled side by side,
so a sweep uses the parent of the sweep before.  The predictive probabilities of the sweeps after the first ones are
averaged, and a text's score is the sum of their logarithms.  Discounts come from the corpus' counts of counts.

No text is shuffled.  Chunks of documents send each distinct word, and each distinct pair, once with its count; the tasks
of a hash range of words number them and count them, those of pairs seat them.  A word or context of a third of all
tokens is an entry a chunk, or one a range, nowhere a group.  All exchanges are rows of packed arrays: ``kind``, ``to``
(who gets it), ``by`` (who sent it), two sums and five arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import base, language_id

#: Bytes of text in a chunk, about, and bytes of the corpus' text for each range of words and of pairs.
CHUNK_BYTES, WORD_BYTES, PAIR_BYTES = 6 << 20, 48 << 20, 9 << 20
#: Sweeps, and how many of the first ones aren't averaged.
SWEEPS, BURN = 3, 1
#: Strengths of the contexts' restaurants and of their parent.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Customers are seated one by one up to this many times BLOCK, then a share of 1 / BLOCK of those seated at once.
BLOCK = 64
END = np.uint64(0x5851F42D4C957F2D)
_SPAN = np.uint64(32)

ROW = "kind string, to long, by long, x long, y long, a binary, b binary, c binary, d binary, e binary"
_ROW = pa.schema([("kind", pa.string()), *[(n, pa.int64()) for n in ("to", "by", "x", "y")], *[(n, pa.binary()) for n in "abcde"]])
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, compressed: small ones and sorted differences take little."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def unpack(blob: bytes | None, kind: type) -> np.ndarray:
    if not blob:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(a: np.ndarray) -> bytes:
    """``pack`` for ascending numbers."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unsteps(blob: bytes | None, kind: type) -> np.ndarray:
    return np.cumsum(unpack(blob, kind), dtype=kind)


def row(kind: str, to: int, by: int = 0, x: int = 0, y: int = 0, **arrays: bytes) -> dict:
    return {"kind": kind, "to": int(to), "by": int(by), "x": int(x), "y": int(y), **{c: arrays.get(c) for c in "abcde"}}


def rows(out: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(out, schema=_ROW)


def of_kind(t: pa.Table, kind: str) -> list[dict]:
    """The rows of one kind, in order of their senders."""
    return sorted(t.filter(pc.equal(t["kind"], kind)).to_pylist(), key=lambda r: r["by"])


def ranges(h: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` equal ranges of hashes, the one of each."""
    return (((h >> _SPAN) * np.uint64(n)) >> _SPAN).astype(np.int64)


def cuts(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers of a sorted array."""
    at = np.flatnonzero(np.diff(group, prepend=-1))
    for i, j in zip(at, [*at[1:], len(group)]):
        yield int(group[i]), slice(int(i), int(j))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return base.mix(u * np.uint64(base.COEFS[0]) + w * np.uint64(base.COEFS[1]))


def tokenised(n_words: int, chunk_bytes: int):
    """Documents (doc_id, text, train) to chunks: their tokens as places in the chunk's sorted words, and questions about these."""

    def chunk(number: int, ids: pa.Array, texts: pa.Array, train: np.ndarray) -> list[dict]:
        words, offsets = base.split_words(pc.ascii_lower(texts.fill_null("")))
        coded = words.dictionary_encode()
        known, place = np.unique(np.append(base.hash_words(coded.dictionary), END), return_inverse=True)
        n = np.diff(offsets)
        codes = np.full(len(words) + len(n), place[-1], np.int32)
        codes[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = place[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(codes, weights=np.repeat(train, n + 1), minlength=len(known)).astype(np.int64)
        there = np.asarray(ids.is_valid())
        out = [row("tokens", number, a=pack(codes), b=pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), c=pack(there.astype(np.uint8)), d=pack((n + 1).astype(np.int64)), e=pack(train.astype(np.uint8)))]
        return out + [row("ask", k, number, a=known[s].tobytes(), b=pack(counts[s])) for k, s in cuts(ranges(known, n_words))]

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            begin = 0
            for end in range(1, whole.num_rows + 1):
                size += int(lengths[end - 1]) + 8
                if size >= chunk_bytes:
                    held.append(whole.slice(begin, end - begin))
                    yield from made(number, held)
                    number, held, size, begin = number + 1, [], 0, end
            if begin < whole.num_rows:
                held.append(whole.slice(begin))
        if held:
            yield from made(number, held)

    def made(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        one = [c.chunk(0) for c in t.columns]
        yield from rows(chunk(number, one[0], one[1], one[2].to_numpy(zero_copy_only=False))).to_batches(max_chunksize=16)

    return run


@base.tidy
def number_words(t: pa.Table) -> pa.Table:
    """One range of words: a number for each, its count in training, and sums over the range."""
    asked = of_kind(t, "ask")
    mine = asked[0]["to"]
    parts = [np.frombuffer(r["a"], np.uint64) for r in asked]
    known, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unpack(r["b"], np.int64) for r in asked]), minlength=len(known)).astype(np.int64)
    # frequent words get small numbers, which take fewer bytes where they stand
    rank = np.empty(len(known), np.uint64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(known), dtype=np.uint64)
    ids = (np.uint64(mine) << _SPAN) + rank[place]
    out, at = [row("total", -1, mine, counts.sum(), (counts > 0).sum()), row("rare", -1, mine, (counts == 1).sum(), (counts == 2).sum())], 0
    for r, p in zip(asked, parts):
        out.append(row("ids", r["by"], mine, a=pack(ids[at : at + len(p)]), b=pack(counts[place[at : at + len(p)]])))
        at += len(p)
    return rows(out)


class Chunk:
    """A chunk's tokens with the numbers and counts of its words; its distinct pairs by range, context and word."""

    def __init__(self, t: pa.Table, n_pairs: int):
        own, told = of_kind(t, "tokens")[0], of_kind(t, "ids")
        self.codes = unpack(own["a"], np.int32).astype(np.int64)
        self.ids, self.there = unpack(own["b"], np.int64), unpack(own["c"], np.uint8) > 0
        self.n, self.train = unpack(own["d"], np.int64), unpack(own["e"], np.uint8) > 0
        self.starts = np.cumsum(self.n) - self.n
        words = np.concatenate([unpack(r["a"], np.uint64) for r in told])
        self.counts = np.concatenate([unpack(r["b"], np.int64) for r in told])
        # the end of a document is also what comes before the next one's first word
        before = np.append(self.codes[-1:], self.codes[:-1])
        coded = pa.array(before * len(words) + self.codes).dictionary_encode()
        u, w = np.divmod(coded.dictionary.to_numpy(), len(words))
        u, w = words[u], words[w]
        group = ranges(pair_hash(u, w), n_pairs)
        order = np.lexsort((w, u, group))
        self.u, self.w, self.group = u[order], w[order], group[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.pairs = back[coded.indices.to_numpy()]


def send_pairs(n_pairs: int):
    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        number = t["to"][0].as_py()
        c = Chunk(t, n_pairs)
        counts = np.bincount(c.pairs, weights=np.repeat(c.train, c.n), minlength=len(c.u)).astype(np.int64)
        return rows([row("pairs", k, number, a=steps(c.u[s]), b=pack(c.w[s]), c=pack(counts[s])) for k, s in cuts(c.group)])

    return run


def seat(c: np.ndarray, mass: np.ndarray, growth: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after ``c`` >= 1 customers of one dish: a new table's weight is ``mass`` + ``growth`` * (its tables so far)."""
    order = np.argsort(-c, kind="stable")
    c, mass, growth = c[order], mass[order], growth[order]
    t, k = np.ones(len(c)), 1
    while True:
        m = int(np.searchsorted(-c, -k, "left"))  # those with more than k customers
        if not m:
            break
        block = max(1, k // BLOCK)
        new = mass[:m] + growth[:m] * t[:m]
        p = new / (k - discount * t[:m] + new)
        t[:m] += rng.random(m) < p if block == 1 else rng.binomial(np.minimum(block, c[:m] - k), p)
        k += block
    out = np.empty(len(c))
    out[order] = t
    return out


class Pairs:
    """One range of pairs: contexts u, words w and counts c by (u, w), tables t, and what the words' ranges told."""

    def __init__(self, t: pa.Table):
        types = of_kind(t, "types")[0]
        self.number = types["to"]
        self.u, self.w, self.c = unsteps(types["a"], np.uint64), unpack(types["b"], np.uint64), unpack(types["c"], np.int64)
        state = of_kind(t, "state")[0]
        self.t = np.minimum(self.c, 1)
        self.t[self.c > 1] = unpack(state["a"], np.int64)
        self.sum = unpack(state["b"], np.float32) if state["b"] else np.zeros(len(self.c), np.float32)
        told = of_kind(t, "told")
        self.x = np.unique(np.concatenate([self.u, self.w]))
        self.tu, self.cu, self.cw, self.tw = (np.concatenate([unpack(r[k], np.int64) for r in told]) for k in "abcd")
        self.iu, self.iw = np.searchsorted(self.x, self.u), np.searchsorted(self.x, self.w)

    def parent(self, d0: float, customers: int, tables: int, v: int) -> np.ndarray:
        """The parent's probability of each pair's word."""
        p = (self.cw - d0 * self.tw + (PARENT_STRENGTH + d0 * tables) / (v + 1)) / (PARENT_STRENGTH + customers)
        return p[self.iw]

    def predict(self, parent: np.ndarray, d: float) -> np.ndarray:
        """The probability of each pair's word after its context."""
        return (self.c - d * self.t + (STRENGTH + d * self.tu[self.iu]) * parent) / (STRENGTH + self.cu[self.iu])


def messages(number: int, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray) -> list[dict]:
    """What a range of pairs tells the ranges of its words: tables and customers as context, tables as word."""
    x, place = np.unique(np.concatenate([u, w]), return_inverse=True)
    iu, iw = place[: len(u)], place[len(u) :]
    total = lambda i, v: np.bincount(i, weights=v, minlength=len(x)).astype(np.int64)
    tu, cu, tw = total(iu, t), total(iu, c), total(iw, t)
    return [row("more", k, number, a=steps(x[s]), b=pack(tu[s]), c=pack(cu[s]), d=pack(tw[s])) for k, s in cuts((x >> _SPAN).astype(np.int64))]


@base.tidy
def merge_pairs(t: pa.Table) -> pa.Table:
    """The chunks' pairs of one range put together; one table each.  ``who`` keeps which pairs a chunk asked for."""
    asked = of_kind(t, "pairs")
    number = asked[0]["to"]
    u, w = np.concatenate([unsteps(r["a"], np.uint64) for r in asked]), np.concatenate([unpack(r["b"], np.uint64) for r in asked])
    _, first, place = np.unique(pair_hash(u, w), return_index=True, return_inverse=True)
    c = np.bincount(place, weights=np.concatenate([unpack(r["c"], np.int64) for r in asked]), minlength=len(first)).astype(np.int64)
    order = np.lexsort((w[first], u[first]))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    mine, uu, ww, c = back[place], u[first][order], w[first][order], c[order]
    out, at = [row("types", number, a=steps(uu), b=pack(ww), c=pack(c)), row("state", number, a=pack(np.ones((c > 1).sum(), np.int64)))], 0
    for r in asked:
        n = len(unpack(r["c"], np.int64))
        out.append(row("who", number, r["by"], a=steps(mine[at : at + n])))
        at += n
    out.append(row("rare", -1, number, (c == 1).sum(), (c == 2).sum()))
    return rows(out + messages(number, uu, ww, c, np.minimum(c, 1)))


def seat_words(sweep: int, seed: int, d0: float, tables: int, v: int):
    """One range of words: customers and tables of all its contexts, and the parent's tables of its words sampled anew."""

    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        told = of_kind(t, "more")
        mine = told[0]["to"]
        parts = [unsteps(r["a"], np.uint64) for r in told]
        x, place = np.unique(np.concatenate(parts), return_inverse=True)
        tu, cu, cw = (np.bincount(place, weights=np.concatenate([unpack(r[k], np.int64) for r in told]), minlength=len(x)).astype(np.int64) for k in "bcd")
        tw, some = np.zeros(len(x), np.int64), cw > 0
        even = np.full(int(some.sum()), 1 / (v + 1))
        tw[some] = seat(cw[some], (PARENT_STRENGTH + d0 * tables) * even, d0 * even, d0, np.random.default_rng((seed, sweep, 1, mine)))
        out, at = [row("total", -1, mine, cw.sum(), tw.sum())], 0
        for r, p in zip(told, parts):
            i = place[at : at + len(p)]
            out.append(row("told", r["by"], mine, a=pack(tu[i]), b=pack(cu[i]), c=pack(cw[i]), d=pack(tw[i])))
            at += len(p)
        return rows(out)

    return run


def seat_pairs(sweep: int, seed: int, d: float, d0: float, customers: int, tables: int, v: int, keep: bool):
    """A sweep over one range of pairs; ``keep``: the sample that is there already is added to the average first."""

    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        p = Pairs(t)
        parent = p.parent(d0, customers, tables, v)
        total = p.sum + p.predict(parent, d).astype(np.float32) if keep else None
        many = p.c > 1
        mass = (STRENGTH + d * (p.tu[p.iu] - p.t))[many] * parent[many]
        p.t[many] = seat(p.c[many], mass, d * parent[many], d, np.random.default_rng((seed, sweep, 2, p.number)))
        state = row("state", p.number, a=pack(p.t[many]), **({"b": pack(total)} if keep else {}))
        return rows([state, *messages(p.number, p.u, p.w, p.c, p.t)])

    return run


def answer(samples: int, d: float, d0: float, customers: int, tables: int, v: int):
    """The averaged probabilities of the pairs that each chunk asked for, in its order."""

    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        p = Pairs(t)
        mean = ((p.sum + p.predict(p.parent(d0, customers, tables, v), d)) / samples).astype(np.float32)
        return rows([row("probs", r["by"], p.number, a=pack(mean[unsteps(r["a"], np.int64)])) for r in of_kind(t, "who")])

    return run


def sum_up(n_pairs: int, total: int, v: int):
    """The documents of a chunk: tokens, known ones, and both sums of logarithms."""

    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        c = Chunk(t, n_pairs)
        probs = np.concatenate([unpack(r["a"], np.float32) for r in of_kind(t, "probs")]).astype(np.float64)
        plain = np.log10((c.counts + 0.1) / (total + 0.1 * (v + 1)))
        each = lambda x: np.add.reduceat(x, c.starts)
        known = each((c.counts > 0)[c.codes].astype(np.int64))
        out = [pa.array(c.ids, mask=~c.there), pa.array(~c.train), pa.array(c.n), pa.array(known), pa.array(each(plain[c.codes])), pa.array(each(np.log10(probs)[c.pairs]))]
        return pa.Table.from_arrays(out, names=[x.split(" ")[0] for x in OUT.split(", ")])

    return run


def discount(once: int, twice: int) -> float:
    """From how many kinds occur once and twice; between 0.1 and 0.9."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


def score(docs: DataFrame, held_out: Column, sweeps: int = SWEEPS, burn: int = BURN, seed: int = 7, chunk_bytes: int = CHUNK_BYTES, word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of ``docs``.

    ``docs`` has doc_id and text (others are ignored); the model learns from the rows that aren't ``held_out``.  Tokens are
    the words (runs of bytes other than ASCII white space, A-Z lower-cased) of the whole text and one end.  A null or empty
    text has the end alone.  A row counts for itself: copies and repeated rows count as often as they stand there, null ids
    stay null.  Without rows to learn from every word is unknown; an empty table has no rows.  A very long text is a
    chunk of its own.  Scores are log10 of probabilities; perplexity is 10 ** (-score / n_tokens).  Results depend on ``seed``
    and on how rows are dealt to chunks only through the order of sums.
    """
    if not 0 <= burn < sweeps:
        raise ValueError("at least one sweep must be averaged")
    size = base.text_bytes(docs)
    n_words, n_pairs = max(1, -(-size // word_bytes)), max(1, -(-size // pair_bytes))
    base.small_batches(docs.sparkSession)
    step = lambda df, f: df.groupBy("to").applyInArrow(f, ROW)
    sums = lambda df, kind: [int(x or 0) for x in df.where(F.col("kind") == kind).agg(F.sum("x"), F.sum("y")).first()]
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    asked = base.save(docs.select("doc_id", "text", (~held_out).alias("train")).mapInArrow(tokenised(n_words, chunk_bytes), ROW), "kind")
    words = base.save(step(of(asked, "ask"), number_words), "kind")
    storage.drop_part(asked, "kind", "ask")
    total, v = sums(words, "total")
    d0 = discount(*sums(words, "rare"))
    chunks = of(asked, "tokens").unionByName(of(words, "ids"))
    pairs = base.save(step(step(chunks, send_pairs(n_pairs)), merge_pairs), "kind")
    d = discount(*sums(pairs, "rare"))
    state, tables = pairs, v
    for sweep in range(sweeps + 1):  # the first time the tables are one a pair
        told = base.save(step(of(state, "more"), seat_words(sweep, seed, d0, tables, v)), "kind")
        customers, tables = sums(told, "total")
        known = of(pairs, "types").unionByName(of(state, "state")).unionByName(of(told, "told"))
        if sweep == sweeps:
            break
        after = base.save(step(known, seat_pairs(sweep, seed, d, d0, customers, tables, v, sweep > burn)), "kind")
        storage.drop(told, *([state] if state is not pairs else []))
        state = after
    probs = base.save(step(known.unionByName(of(pairs, "who")), answer(sweeps - burn, d, d0, customers, tables, v)))
    storage.drop(told, state, pairs)
    done = chunks.unionByName(probs).groupBy("to").applyInArrow(sum_up(n_pairs, total, v), OUT)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return score(docs, language_id.held_out(folds=10))
