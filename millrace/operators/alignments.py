"""Alignments side by side and seeds for them: stacks with shared gaps, consensus columns, Bloom-filtered seeds, batches of
local alignments and approximate adapters in numpy.

``hits`` are rows read, sub, sub_start, seq: ``-`` is a deletion, lower case an insertion after the last position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import prefix
from ..storage import drop, materialize
from .ranges import range_join
from .sequences import kmers

#: Rows of one seed in one task, about; bits of the Bloom filter at most (16 MB), and bits a seed.
HOT, BITS, BITS_EACH = 20_000, 1 << 27, 12
#: Pairs aligned at once.
BATCH = 256


def placed(hits: DataFrame) -> DataFrame:
    """The columns of ``hits`` but seq, and a row for each letter: pos, k (0: aligned, 1, 2, ..: inserted after pos), base."""
    rest = [c for c in hits.columns if c != "seq"]
    inserted = lambda x: F.rlike(x, F.lit("[a-z]"))
    runs = hits.select(*rest, F.regexp_extract_all("seq", F.lit("([^a-z]+|[a-z]+)")).alias("_r"))
    before = lambda k: F.aggregate(F.slice("_r", F.lit(1), k), F.lit(0), lambda n, x: n + F.when(inserted(x), 0).otherwise(F.length(x)))
    each = runs.select(*rest, F.inline(F.transform("_r", lambda x, k: F.struct((F.col("sub_start") + before(k)).alias("_at"), x.alias("_s")))))
    letters = each.select(*rest, "_at", inserted(F.col("_s")).alias("_i"), F.posexplode(F.filter(F.split("_s", ""), lambda x: x != "")).alias("_n", "base"))
    pos, k = F.when(F.col("_i"), F.col("_at") - 1).otherwise(F.col("_at") + F.col("_n")), F.when(F.col("_i"), F.col("_n") + 1).otherwise(0)
    return letters.select(*rest, pos.cast("long").alias("pos"), k.cast("int").alias("k"), F.upper("base").alias("base"))


def insertions(hits: DataFrame) -> DataFrame:
    """sub, pos, extra: the longest insertion of any read after each position that has one."""
    runs = F.regexp_extract_all("seq", F.lit("([^a-z]+|[a-z]+)"))
    before = lambda k: F.aggregate(F.slice("_r", F.lit(1), k), F.lit(0), lambda n, x: n + F.when(F.rlike(x, F.lit("[a-z]")), 0).otherwise(F.length(x)))
    each = hits.where(F.rlike("seq", F.lit("[a-z]")) & F.col("sub_start").isNotNull()).select("sub", "sub_start", runs.alias("_r"))
    each = each.select("sub", F.inline(F.transform("_r", lambda x, k: F.struct((F.col("sub_start") + before(k) - 1).cast("long").alias("pos"), x.alias("s")))))
    return each.where(F.rlike("s", F.lit("[a-z]"))).groupBy("sub", "pos").agg(F.max(F.length("s")).alias("extra"))


def gapped(seq: str, start: int, pads: dict[int, int]) -> str:
    """An aligned read with every position followed by as many letters or gaps as the stack has there."""
    out, pos, own = [], start - 1, 0
    last = start - 1
    for ch in seq:
        if ch.islower():
            own += 1
            out.append(ch.upper())
            continue
        if pos >= start:
            out.append("-" * (pads.get(pos, 0) - own))
        pos, own = pos + 1, 0
        out.append(ch)
        last = pos
    if own:  # the read ends in an insertion: it is filled up too
        out.append("-" * (pads.get(last, 0) - own))
    return "".join(out)


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def stack(hits: DataFrame, width: int = 1000) -> DataFrame:
    """The columns of ``hits`` with ``column`` and ``row``: alignments under each other, all insertions in columns of their own.

    A position's column is its number plus the longest insertions of all positions before it on the subject: sums over
    range partitions, so no task holds a subject.  A read has gaps where others insert between its letters.  An
    insertion before the first aligned letter belongs to the position before.

    Reads meet the insertions by bins at least as wide as they are long, and as ``width``: a row for each bin where reads
    start tells what is inserted before them and among them.  So a read is joined once and not regrouped, and where the
    bins are few they are broadcast.  Reads without a start stay, without a column; a null subject is one of its own.
    """
    seq, over = F.coalesce("seq", F.lit("")), F.expr(f"(greatest(_span, 1) - 1) div {int(width)}")
    reads = hits.withColumns({"_sub": F.struct("sub"), "_from": F.col("sub_start").cast("long"), "_span": F.length(F.translate(seq, _LOWER, ""))})
    reads = reads.withColumn("_class", F.when(over == 0, 0).otherwise(F.length(F.bin(over))))
    reads = reads.withColumn("_place", F.floor(F.col("_from") / (F.lit(int(width)) * F.pow(F.lit(2), F.col("_class")))))
    keys = ["_sub", "_class", "_place"]
    bins = materialize(reads.where("_from IS NOT NULL").groupBy(*keys).agg(F.min("_from").alias("_low"), F.max(F.col("_from") + F.greatest("_span", F.lit(1)) - 1).alias("_high")))
    wide = materialize(insertions(hits).select(F.struct("sub").alias("_sub"), F.col("pos").alias("_low"), F.col("extra").cast("long").alias("extra")))
    both = bins.withColumn("extra", F.lit(0).cast("long")).unionByName(wide, allowMissingColumns=True)
    summed = materialize(prefix.running(both, ["_sub"], [F.col("_low"), F.col("_class").asc_nulls_last(), F.col("_place")], {"_before": F.col("extra")}))
    places = summed.where("_class IS NULL").select("_sub", F.col("_low").alias("pos"), F.col("_low").alias("_pos"), F.col("extra").cast("int").alias("extra"), (F.col("_before") + F.col("extra")).alias("upto"))
    starts = summed.where("_class IS NOT NULL").select(*keys, "_low", "_high", "_before")
    met = range_join(starts.drop("_before"), places, ["_sub"], ("_low", "_high"), ("pos", "_pos"), width)
    lists = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "extra", "upto"))).alias("_all"))  # at most the positions of two bins
    table = materialize(starts.join(lists, keys, "left").select(*keys, "_before", *[F.coalesce(f"_all.{c}", F.array().cast(f"array<{k}>")).alias(f"_{c}") for c, k in (("pos", "bigint"), ("extra", "int"), ("upto", "bigint"))]))
    drop(bins, wide, summed)

    def upto(p: Column) -> Column:
        """How many of the list's positions are ``p`` at most; mostly ``p`` itself is one where the list is long."""
        at = F.array_position("_pos", p)
        return F.when(at > 0, at).otherwise(F.size(F.filter("_pos", lambda x: x <= p))).cast("int")

    # a read's last letter has gaps after it only if the read inserts there itself
    end = F.col("_from") + F.col("_span") - F.when(F.rlike(seq, F.lit("[a-z]$")), 1).otherwise(2)
    own = reads.join(table, keys, "left").withColumns({"_first": upto(F.col("_from") - 1), "_end": upto(end)})
    cells = F.regexp_extract_all(seq, F.lit("([^a-z][a-z]*)"))  # letters, each with what is inserted after it
    before = lambda k: F.when(k == 0, F.col("_from")).otherwise(F.get("_pos", F.col("_first") + k - 1) + 1)
    skipped = lambda k: F.array_repeat(F.lit(0), (F.get("_pos", F.col("_first") + k) - before(k)).cast("int"))
    own = own.withColumn("_gaps", F.slice("_extra", F.col("_first") + 1, F.greatest(F.col("_end") - F.col("_first"), F.lit(0))))
    dense = F.get("_pos", F.col("_end") - 1) - F.col("_from") + 1 == F.size("_gaps")
    each = F.when(dense, F.col("_gaps")).otherwise(F.flatten(F.transform("_gaps", lambda n, k: F.concat(skipped(k), F.array(n)))))
    filled = F.zip_with(cells, each, lambda x, n: F.rpad(x, F.coalesce(n, F.lit(0)) + 1, F.lit("-")))
    row = F.when(F.col("_end") > F.col("_first"), F.concat(F.regexp_extract(seq, "^[a-z]*", 0), F.array_join(filled, ""))).otherwise(seq)
    return own.select(*hits.columns, (F.col("_from") + F.coalesce(F.get("_upto", F.col("_first") - 1), F.col("_before"))).alias("column"), F.upper(row).alias("row"))


def stack_subjects(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """sub, row: each subject (sub, seq; from position 1) with gaps where reads insert."""
    pads = insertions(hits).groupBy("sub").agg(F.collect_list(F.struct("pos", "extra")).alias("_p"))  # at most the subject's own positions

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            known = [{x["pos"]: x["extra"] for x in p} if p is not None else {} for p in b["_p"]]
            yield b[["sub"]].assign(row=[gapped((s or "").upper(), 1, p) + "-" * p.get(len(s or ""), 0) for s, p in zip(b["seq"], known)])

    kind = dict(subjects.dtypes)["sub"]
    return subjects.select("sub", "seq").join(pads, "sub", "left").mapInPandas(run, f"sub {kind}, row string")


def consensus_columns(hits: DataFrame) -> DataFrame:
    """sub, pos, k, base, n, cover: for each column of the stack the letter most reads have (``-``: none; ties: the first of -ACGT..).

    ``cover`` is how many reads stand on the position; a read that has no letter in an inserted column has a gap there.
    """
    letters = placed(hits).groupBy("sub", "pos", "k", "base").agg(F.count("*").alias("n"))
    cover = letters.where("k = 0").groupBy("sub", "pos").agg(F.sum("n").alias("cover"))
    own = letters.groupBy("sub", "pos", "k").agg(F.sum("n").alias("_all"), F.max(F.struct("n", F.translate("base", "-ACGT", "54321").alias("_o"), "base")).alias("_best"))
    at = own.join(cover, ["sub", "pos"], "left").withColumn("cover", F.coalesce("cover", "_all"))
    gaps = F.greatest(F.col("cover") - F.col("_all"), F.lit(0))
    gap = (F.col("k") > 0) & (gaps >= F.col("_best.n"))
    return at.select("sub", "pos", "k", F.when(gap, "-").otherwise(F.col("_best.base")).alias("base"), F.when(gap, gaps).otherwise(F.col("_best.n")).alias("n"), "cover")


def match_counts(hits: DataFrame, reference: DataFrame) -> DataFrame:
    """read, sub, matches, mismatches, inserted, deleted, identity of each alignment against ``reference`` (sub, pos, ref)."""
    cells = placed(hits.select("read", "sub", "sub_start", "seq")).join(reference, ["sub", "pos"], "left")
    aligned, gone = F.col("k") == 0, F.col("base") == "-"
    same = aligned & ~gone & (F.col("base") == F.upper("ref"))
    by = cells.groupBy("read", "sub", "sub_start").agg(F.count_if(same).alias("matches"), F.count_if(aligned & ~gone & ~F.coalesce(same, F.lit(False))).alias("mismatches"), F.count_if(~aligned).alias("inserted"), F.count_if(aligned & gone).alias("deleted"))
    total = F.col("matches") + F.col("mismatches") + F.col("inserted") + F.col("deleted")
    return by.withColumn("identity", F.col("matches") / total)


# seeds


def bloom(hashes: DataFrame, column: str, count: int) -> bytes:
    """A Bloom filter of a column of longs: two bits each among BITS_EACH a value, BITS at most."""
    bits = min(BITS, 1 << max(10, int(count * BITS_EACH - 1).bit_length()))
    at = F.array(*[F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(2)])
    words = hashes.select(F.explode(at).alias("b")).groupBy(F.floor(F.col("b") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("v"))
    out = np.zeros(bits // 32, np.uint32)
    for r in words.toLocalIterator():  # bits / 32 rows at most
        out[r["w"]] = r["v"]
    return out.tobytes()


def may_hold(filter_: bytes, column: str) -> Column:
    """Whether a long may be one of the filter's; no false no."""
    bits = len(filter_) * 8

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        known = np.frombuffer(filter_, np.uint32)
        hit = lambda x: (known[x.to_numpy() // 32] >> (x.to_numpy() % 32).astype(np.uint32)) & 1
        return pd.Series((hit(a) & hit(b)).astype(bool))

    return test(*[F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(2)])


def seed_hits(reads: DataFrame, subjects: DataFrame, k: int = 11, hot: int = HOT) -> DataFrame:
    """id, sub, diagonal, hits: seeds that reads (id, seq) and subjects (id, seq) share, by diagonal.

    Seeds of reads that no subject has are left out by a Bloom filter before anything is shuffled.  A seed with more than
    ``hot`` rows on the reads' side is dealt to as many tasks as it takes, the subjects' rows going to each; nothing is
    dropped.  Reads (and subjects) of one sequence are looked up once; their hits are theirs each.
    """

    def texts(df: DataFrame) -> DataFrame:
        return materialize(df.where(F.col("seq").isNotNull()).select("seq").distinct().withColumn("id", F.monotonically_increasing_id()))

    theirs, own = texts(reads), texts(subjects)
    found = _seed_hits(theirs, own, k, hot).withColumnsRenamed({"id": "_read", "sub": "_sub"})
    of_read = reads.join(theirs.withColumnRenamed("id", "_read"), "seq").select("id", "_read")
    of_sub = subjects.withColumnRenamed("id", "sub").join(own.withColumnRenamed("id", "_sub"), "seq").select("sub", "_sub")
    out = found.join(of_sub, "_sub").join(of_read, "_read").select("id", "sub", "diagonal", "hits")
    if all(df.groupBy("id").count().where("count > 1").isEmpty() for df in (reads, subjects)):
        return out
    return out.groupBy("id", "sub", "diagonal").agg(F.sum("hits").alias("hits"))  # rows that repeat an id are one


def _seed_hits(reads: DataFrame, subjects: DataFrame, k: int, hot: int) -> DataFrame:
    """``seed_hits`` of rows that are looked up each."""
    own = kmers(subjects.select(F.col("id").alias("sub"), "seq"), k, ("sub",)).select("sub", F.col("pos").alias("spos"), "kmer", F.xxhash64("kmer").alias("h"))
    count = own.select(F.approx_count_distinct("h")).first()[0]
    theirs = kmers(reads, k).select("id", "pos", "kmer", F.xxhash64("kmer").alias("h"))
    theirs = theirs.where(may_hold(bloom(own.select("h"), "h", max(count, 1)), "h"))
    many = theirs.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("kmer", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("id", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    left = theirs.join(many, "kmer", "left").select("id", "pos", "kmer", salt.alias("salt"))
    right = own.join(many, "kmer", "left").select("sub", "spos", "kmer", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    return left.join(right, ["kmer", "salt"]).groupBy("id", "sub", (F.col("spos") - F.col("pos")).alias("diagonal")).agg(F.count("*").alias("hits"))


# local alignment


def _letters(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        b = t.encode("ascii", "replace")
        out[i, : len(b)] = np.frombuffer(b, np.uint8)
    return out


def align_batch(queries: list[str], subjects: list[str], diagonals: np.ndarray, match: int, mismatch: int, gap_open: int, gap_next: int, band: int) -> np.ndarray:
    """score, s_start, s_end, q_start, q_end, matches (pair, 6) of the best local alignments, a row of all bands at once.

    Cells of a row are the subject's places about the diagonal.  A gap along the row is a running maximum: one that opens
    from a cell that itself ends such a gap never beats going on.  Ties: an older gap, then the diagonal, then the gap down the
    query; the first best cell by row.
    """
    if gap_open > gap_next:
        raise ValueError("opening a gap costs at least as much as going on")
    n, width = len(queries), 2 * band + 1
    lengths = np.array([len(q) for q in queries])
    ends = np.array([len(s) for s in subjects])
    q, s = _letters(queries, max(1, lengths.max(initial=0))), _letters(subjects, max(1, ends.max(initial=0)))
    small = np.int32
    far = small(-(1 << 28))
    cells = np.arange(width, dtype=small)
    diagonals = diagonals.astype(small)
    h, e = np.zeros((n, width + 1), small), np.full((n, width + 1), far)
    # where a path began (subject, query) and its matches, for each cell and for gaps down the query
    begun, begun_e = np.zeros((3, n, width + 1), small), np.zeros((3, n, width + 1), small)
    begun[0] = np.maximum(diagonals[:, None] - band + np.arange(width + 1, dtype=small), 0)
    best, rows = np.zeros((n, 6), np.int64), np.arange(n)
    for i in range(1, int(lengths.max(initial=0)) + 1):
        j = i + diagonals[:, None] - band + cells
        there = (j >= 1) & (j <= ends[:, None]) & (i <= lengths)[:, None]
        same = np.take_along_axis(s, np.clip(j - 1, 0, s.shape[1] - 1), 1) == q[:, i - 1 : i]
        # the row before, one cell to the right, is the same place of the subject
        open_e, next_e = h[:, 1:] + gap_open, e[:, 1:] + gap_next
        opened = open_e > next_e
        ne = np.where(there, np.maximum(open_e, next_e), far)
        ne_from = np.where(opened, begun[:, :, 1:], begun_e[:, :, 1:])
        diag = h[:, :-1] + np.where(same, small(match), small(mismatch))
        diag_from = begun[:, :, :-1].copy()
        outside = (j - 1 < 1) | (i == 1)
        diag = np.where(outside, np.where(same, small(match), small(mismatch)), diag)
        diag_from[0], diag_from[1] = np.where(outside, j - 1, diag_from[0]), np.where(outside, i - 1, diag_from[1])
        diag_from[2] = np.where(outside, 0, diag_from[2]) + same
        plain = np.where(there, np.maximum(np.maximum(diag, ne), 0), 0)
        fresh = np.stack([j, np.full_like(j, i), np.zeros_like(j)])
        value_from = np.where(plain == 0, fresh, np.where(plain == diag, diag_from, ne_from))
        rise = np.where(there, plain - cells * gap_next, far)
        top = np.maximum.accumulate(rise, axis=1)
        new = np.concatenate([np.ones((n, 1), bool), rise[:, 1:] > top[:, :-1]], axis=1)
        source = np.maximum.accumulate(np.where(new, cells, 0), axis=1)
        f = np.concatenate([np.full((n, 1), far), top[:, :-1] + gap_open + cells[:-1] * gap_next], axis=1)
        source = np.concatenate([np.zeros((n, 1), small), source[:, :-1]], axis=1)
        better = there & (f > plain)
        value = np.where(better, f, plain)
        value_from = np.where(better, np.take_along_axis(value_from, np.broadcast_to(source, value_from.shape), 2), value_from)
        k = value.argmax(axis=1)
        win = value[rows, k] > best[:, 0]
        if win.any():
            at = (rows[win], k[win])
            best[win] = np.stack([value[at], value_from[0][at], j[at], value_from[1][at], np.full(win.sum(), i), value_from[2][at]], axis=1)
        h[:, :-1], e[:, :-1], begun[:, :, :-1], begun_e[:, :, :-1] = value, ne, value_from, ne_from
        h[:, -1], e[:, -1] = 0, far
        begun[0, :, -1], begun[1, :, -1], begun[2, :, -1] = i + diagonals + band + 1, i, 0
    return best


def local_alignments(pairs: DataFrame, match: int = 5, mismatch: int = -4, gap_open: int = -12, gap_next: int = -6, band: int = 32, min_length: int = 0, max_mismatch_pct: float = 100.0) -> DataFrame:
    """Adds score, s_start, s_end, q_start, q_end, matches of the best local alignment of ``query`` and ``subject`` in a band about ``diagonal``.

    Affine gaps; whole batches in numpy.  ``min_length`` letters of the query must be aligned, and at most ``max_mismatch_pct``
    of the longer aligned side may not match.  Null texts are empty and score 0.
    """
    names = ("score", "s_start", "s_end", "q_start", "q_end", "matches")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            q, s = b["query"].fillna("").tolist(), b["subject"].fillna("").tolist()
            d = b["diagonal"].fillna(0).to_numpy().astype(np.int64) if "diagonal" in b else np.zeros(len(b), np.int64)
            order = np.argsort([len(x) for x in q], kind="stable")
            out = np.zeros((len(b), len(names)), np.int64)
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                out[part] = align_batch([q[x] for x in part], [s[x] for x in part], d[part], match, mismatch, gap_open, gap_next, band)
            yield b.assign(**{c: out[:, k] for k, c in enumerate(names)})

    made = pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, *[T.StructField(c, T.LongType()) for c in names]]))
    span = F.greatest(F.col("q_end") - F.col("q_start"), F.col("s_end") - F.col("s_start"))
    ok = F.col("q_end") - F.col("q_start") >= min_length
    return made.where(ok & ((span - F.col("matches")) * 100.0 <= span * max_mismatch_pct)) if min_length or max_mismatch_pct < 100 else made


# adapters


def adapter_starts(texts: list[str], adapter: str, errors: int) -> np.ndarray:
    """For each text the place from which it is cut: of the first places where a piece within ``errors`` edits of the adapter begins,
    the one of least distance before it grows again; the text's length where there is none.

    Myers' bit vectors over all texts at once, from the right: a step a letter.
    """
    m = len(adapter)
    if not 0 < m <= 63:
        raise ValueError("adapters have 1 to 63 letters")
    lengths = np.array([len(t) for t in texts], np.int64)
    width = int(lengths.max(initial=0))
    letters = _letters([t[::-1] for t in texts], max(1, width))
    peq = np.zeros(256, np.uint64)
    for i, ch in enumerate(adapter[::-1].encode("ascii", "replace")):
        peq[ch] |= np.uint64(1) << np.uint64(i)
    one, full, high = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(1 << (m - 1))
    pv, mv = np.full(len(texts), full), np.zeros(len(texts), np.uint64)
    distance = np.full(len(texts), m, np.int64)
    costs = np.full((width + 1, len(texts)), m + 1, np.int64)
    for t in range(width):
        eq = peq[letters[:, t]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        distance += ((ph & high) > 0).astype(np.int64) - ((mh & high) > 0).astype(np.int64)
        ph, mh = (ph << one), (mh << one)  # a match may begin anywhere
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        costs[t] = np.where(t < lengths, distance, m + 1)
    out = lengths.copy()
    place = lengths - 1 - np.arange(width + 1)[:, None]  # of the letter read at each step
    found = (costs <= errors) & (place >= 0)
    some = found.any(axis=0)
    step = width - np.argmax(found[::-1], axis=0)  # the last step is the first place
    for r in np.flatnonzero(some):
        t = step[r]
        while t > 0 and costs[t - 1, r] < costs[t, r]:
            t -= 1
        out[r] = place[t, r]
    return out


def trim_adapters(reads: DataFrame, adapters: list[str], errors: int = 1) -> DataFrame:
    """Reads (seq and, where there, qual) cut where an adapter begins, up to ``errors`` letters of it changed, missing or added."""
    @F.pandas_udf("long")
    def at(texts: pd.Series) -> pd.Series:
        known = texts.fillna("").tolist()
        cuts = np.array([len(t) for t in known], np.int64)
        for a in adapters:
            cuts = np.minimum(cuts, adapter_starts(known, a.upper(), errors))
        return pd.Series(cuts)

    cut = reads.withColumn("_at", at(F.upper("seq")).cast("int"))
    cut = cut.withColumn("seq", F.when(F.col("seq").isNotNull(), F.substr("seq", F.lit(1), F.col("_at"))))
    if "qual" in reads.columns:
        cut = cut.withColumn("qual", F.slice("qual", F.lit(1), F.col("_at")))
    return cut.drop("_at")


def mask(reads: DataFrame, min_quality: int = 0, positions: list[tuple[int, int]] | None = None) -> DataFrame:
    """Letters below a quality, or at closed ranges of places from 1, become N."""
    cells = F.filter(F.split("seq", ""), lambda x: x != "")
    out = reads
    if positions:
        hit = lambda i: _any([(i + 1 >= a) & (i + 1 <= b) for a, b in positions])
        out = out.withColumn("seq", F.array_join(F.transform(cells, lambda x, i: F.when(hit(i), "N").otherwise(x)), ""))
    if min_quality and "qual" in reads.columns:
        out = out.withColumn("seq", F.array_join(F.zip_with(cells, "qual", lambda x, q: F.when(q < min_quality, "N").otherwise(x)), ""))
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
