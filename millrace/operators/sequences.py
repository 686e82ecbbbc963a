"""Reads, alignments, profiles and annotations as tables: counts, pileups, calls, coverage, codons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import islands, range_join

BASES = ("A", "C", "G", "T")
#: The standard genetic code in TCAG order.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codons() -> dict[str, str]:
    order = "TCAG"
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}


def amino(codon: Column) -> Column:
    """The amino acid of a codon; X where it is none."""
    table = F.create_map(*[F.lit(x) for kv in codons().items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(codon)), F.lit("X"))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def letters(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """A row for each letter: all other columns, pos from 0, base."""
    rest = [c for c in reads.columns if c != seq]
    return reads.select(*rest, F.posexplode(F.filter(F.split(F.upper(seq), ""), lambda x: x != "")).alias("pos", "base"))


# reads: columns id, seq and, where asked for, qual (array of int) and rpt (repeats)


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("length")).agg(F.sum(_weight(reads)).alias("reads"))


def _weight(df: DataFrame) -> Column:
    return F.col("rpt") if "rpt" in df.columns else F.lit(1)


def base_counts(reads: DataFrame) -> DataFrame:
    """base, n over all reads, by repeats; map-side: letters are counted by removing them, not by one row each."""
    w = _weight(reads)
    count = lambda b: F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit(b), F.lit("")))
    sums = reads.agg(*[F.sum(count(b) * w).alias(b) for b in (*BASES, "N")])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(b).alias("base"), F.coalesce(F.col(b), F.lit(0)).cast("bigint").alias("n")) for b in (*BASES, "N")])))


def position_stats(reads: DataFrame) -> DataFrame:
    """pos, base, n and, with qualities, mean and half the deviation of the quality."""
    if "qual" not in reads.columns:
        return letters(reads).groupBy("pos", "base").agg(F.count("*").alias("n"))
    both = F.arrays_zip(F.filter(F.split(F.upper("seq"), ""), lambda x: x != "").alias("base"), F.col("qual").alias("q"))
    rows = reads.select(F.posexplode(both).alias("pos", "x"))
    return rows.groupBy("pos", F.col("x")["0"].alias("base")).agg(F.count("*").alias("n"), F.avg(F.col("x")["q"]).alias("quality"), (F.stddev_pop(F.col("x")["q"]) / 2).alias("half_sd"))


def codon_usage(reads: DataFrame, frame: int = 0) -> DataFrame:
    """codon, amino, n of the whole codons from ``frame`` on."""
    s = F.substring(F.upper("seq"), frame + 1, 1 << 30)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 3).cast("int") - 1), lambda i: F.substr(s, i * 3 + 1, F.lit(3)))
    rows = reads.where(F.length("seq") >= frame + 3).select(F.explode(cut).alias("codon"))
    return rows.groupBy("codon").agg(F.count("*").alias("n")).withColumn("amino", amino(F.col("codon")))


def kmers(reads: DataFrame, k: int = 11, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep, pos, kmer for every run of k letters."""
    s = F.upper("seq")
    rows = reads.where(F.length("seq") >= k)
    return rows.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.substr(s, i + 1, F.lit(k)))).alias("pos", "kmer"))


def kmer_hits(reads: DataFrame, subjects: DataFrame, k: int = 11) -> DataFrame:
    """id, sub, diagonal, hits: seeds shared by reads and subjects, by diagonal (an equi-join on the k-mer)."""
    a, b = kmers(reads, k), kmers(subjects.withColumnRenamed("id", "sub"), k, ("sub",)).withColumnRenamed("pos", "spos")
    return a.join(b, "kmer").groupBy("id", "sub", (F.col("spos") - F.col("pos")).alias("diagonal")).agg(F.count("*").alias("hits"))


def complexity(seq: Column, word: int = 1) -> Column:
    """Entropy of the words of a sequence, times 1000, rounded."""
    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.length(seq) - word, F.lit(0))), lambda i: F.substr(seq, i + 1, F.lit(word)))
    shares = F.transform(F.array_distinct(cells), lambda v: F.size(F.filter(cells, lambda x: x == v)) / F.size(cells))
    return F.round(-F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p)) * 1000).cast("int")


def filter_reads(reads: DataFrame, min_length: int = 0, max_n_pct: float = 100, min_quality: float = 0, min_complexity: int = 0, trim_quality: int = 0, adapters: tuple[str, ...] = (), dedup: bool = False) -> DataFrame:
    """Trims low-quality tails and adapters (exact, from their first place), then filters by length, N share, quality, complexity; dedup keeps the least id of each sequence with its count in ``rpt``."""
    df = reads
    if trim_quality and "qual" in df.columns:
        good = F.transform("qual", lambda q, i: F.when(q >= trim_quality, i + 1).otherwise(0))
        df = df.withColumn("_n", F.coalesce(F.array_max(good), F.lit(0))).withColumn("seq", F.substr("seq", F.lit(1), F.col("_n"))).withColumn("qual", F.slice("qual", F.lit(1), F.col("_n"))).drop("_n")
    for a in adapters:
        at = F.instr("seq", a)
        df = df.withColumn("_at", F.when(at > 0, at - 1).otherwise(F.length("seq"))).withColumn("seq", F.substr("seq", F.lit(1), F.col("_at")))
        if "qual" in df.columns:
            df = df.withColumn("qual", F.slice("qual", F.lit(1), F.col("_at")))
        df = df.drop("_at")
    n = F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit("N"), F.lit("")))
    df = df.where((F.length("seq") >= min_length) & (n * 100.0 <= F.length("seq") * max_n_pct))
    if min_quality and "qual" in df.columns:
        df = df.where(F.call_function("try_divide", F.aggregate("qual", F.lit(0.0), lambda s, q: s + q), F.size("qual")) >= min_quality)
    if min_complexity:
        df = df.where(complexity(F.upper("seq")) >= min_complexity)
    if dedup:
        df = df.groupBy("seq").agg(F.min("id").alias("id"), F.sum(_weight(df)).alias("rpt"))
    return df


# alignments: read, sub, sub_start, score [, strand, pairs array<struct<s, q>>, seq]


def best_hits(hits: DataFrame, keep: str = "first") -> DataFrame:
    """Per read the first, all best, or only unique best alignments by score."""
    w = Window.partitionBy("read")
    top = hits.withColumn("_best", F.max("score").over(w)).where("score = _best").drop("_best")
    if keep == "all":
        return top
    n = top.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("sub", "sub_start")))
    return (n.where("_n = 1") if keep == "unique" else n.where("_r = 1")).drop("_n", "_r")


def paired(hits: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs of ends (pair, end 1 and 2) on one subject whose starts are low..high apart."""
    one, two = (hits.where(F.col("end") == e).select("pair", "sub", F.col("sub_start").alias(f"start{e}")) for e in (1, 2))
    return one.join(two, ["pair", "sub"]).where(F.abs(F.col("start2") - F.col("start1")).between(low, high))


def hit_counts(hits: DataFrame, subjects: DataFrame, total_reads: int | None = None) -> DataFrame:
    """sub, hits, hits_unique, length, rpkm, cpm, pct, density, with rows ``+`` (all) and, given total_reads, ``-`` (unaligned)."""
    per_read = hits.groupBy("read").agg(F.count_distinct("sub").alias("_subs"))
    counted = hits.select("read", "sub").distinct().join(per_read, "read").groupBy("sub").agg(F.count("*").alias("hits"), F.count_if(F.col("_subs") == 1).alias("hits_unique"))
    total = hits.agg(F.count_distinct("read").alias("n"))
    rows = subjects.join(counted, "sub").crossJoin(F.broadcast(total))
    rows = rows.select(
        F.col("sub").cast("string").alias("sub"), "hits", "hits_unique", F.col("length").cast("bigint").alias("length"),
        F.call_function("try_divide", F.col("hits") * 1e9, F.col("length") * F.col("n")).alias("rpkm"), F.call_function("try_divide", F.col("hits") * 1e6, F.col("n")).alias("cpm"),
        F.call_function("try_divide", F.col("hits") * 100.0, F.col("n")).alias("pct"), F.call_function("try_divide", F.col("hits").cast("double"), F.col("length")).alias("density"),
    )
    null = F.lit(None).cast("double")
    out = rows.unionAll(total.select(F.lit("+"), "n", null.cast("bigint"), null.cast("bigint"), null, null, null, null))
    if total_reads is not None:
        out = out.unionAll(total.select(F.lit("-"), F.lit(total_reads) - F.col("n"), null.cast("bigint"), null.cast("bigint"), null, null, null, null))
    return out


def expression_matrix(hits: DataFrame, lengths: DataFrame, subject: str, experiment: str, measure: str = "rpkm", min_hits: int = 0) -> DataFrame:
    """Subjects by experiments: hits or RPKM = 1e9 * hits / (length * all hits of the experiment)."""
    counts = hits.groupBy(subject, experiment).agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
    if measure == "rpkm":
        total = hits.groupBy(experiment).agg(F.count("*").alias("total"))
        counts = counts.join(total, experiment).join(lengths, subject).withColumn("v", F.col("hits") * 1e9 / (F.col("length") * F.col("total")))
    else:
        counts = counts.withColumn("v", F.col("hits"))
    names = [r[0] for r in hits.select(experiment).distinct().orderBy(experiment).limit(10_001).collect()]  # each becomes a column: their number is a plan's size
    if len(names) > 10_000:
        raise ValueError("more than 10000 experiments can't become columns")
    return counts.groupBy(subject).pivot(experiment, names).agg(F.max("v")).fillna(0)


def remap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Alignments A -> B and B -> C as A -> C: read, a_pos, b, b_pos joined with b, b_pos, c, c_pos."""
    return first.join(second, ["b", "b_pos"]).select("read", "a_pos", "c", "c_pos")


def pileup(hits: DataFrame) -> DataFrame:
    """sub, pos, count_a..count_t, count_ins, count_del, count_total, forward, reverse from rows sub, sub_start, seq, strand.

    ``seq`` is aligned: ``-`` is a deletion, lower case an insertion after the last position.
    """
    inserted = lambda x: F.rlike(x, F.lit("[a-z]"))
    runs = F.regexp_extract_all("seq", F.lit("([^a-z]+|[a-z]+)"))  # aligned and inserted letters by turns
    before = lambda k: F.aggregate(F.slice("_r", F.lit(1), k), F.lit(0), lambda n, x: n + F.when(inserted(x), 0).otherwise(F.length(x)))
    placed = F.transform("_r", lambda x, k: F.struct((F.col("sub_start") + before(k)).alias("_at"), x.alias("_s")))
    # equal reads at one place are counted before they are taken apart
    same = hits.groupBy("sub", "sub_start", "strand", "seq").agg(F.count("*").alias("_n"))
    rows = same.select("sub", "sub_start", "strand", "_n", runs.alias("_r")).select("sub", "strand", "_n", F.inline(placed))
    each = rows.select("sub", "strand", "_n", "_at", inserted(F.col("_s")).alias("_ins"), F.posexplode(F.filter(F.split("_s", ""), lambda x: x != "")).alias("_i", "b"))
    at = each.select("sub", "strand", "_n", "_ins", F.when(F.col("_ins"), F.col("_at") - 1).otherwise(F.col("_at") + F.col("_i")).alias("pos"), "b")
    ins = F.col("_ins")
    count = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)).cast("bigint")
    return at.groupBy("sub", "pos").agg(
        *[count(F.col("b") == b).alias(f"count_{b.lower()}") for b in BASES], count(ins).alias("count_ins"), count(F.col("b") == "-").alias("count_del"),
        count(~ins & (F.col("b") != "-")).alias("count_total"), count((F.col("strand") == "+") & ~ins).alias("forward"), count((F.col("strand") == "-") & ~ins).alias("reverse"),
    )


def entropy10(counts: list[Column]) -> Column:
    """-sum p log10 p / log10 n of a position's counts."""
    total = sum(counts[1:], counts[0]).cast("double")
    out = F.lit(0.0)
    for c in counts:
        out = out - F.when(c > 0, (c / total) * F.log10(c / total)).otherwise(0.0)
    return F.when(total > 1, out / F.log10(total)).otherwise(0.0)


def profile_filter(profile: DataFrame, min_cover: int = 0, min_freq_pct: float = 0, noise: dict[str, float] | None = None, disbalance: float = 0, max_entropy: float | None = None) -> DataFrame:
    """Sets the counts of a failing position to 0: cover, strand balance (once the total is over twice the bound), entropy; a base below its noise share is 0 alone."""
    cols, total = [f"count_{b.lower()}" for b in BASES], F.col("count_total")
    ok = total >= min_cover
    if disbalance:
        low = F.least("forward", "reverse")
        ok = ok & ((total <= 2 * disbalance) | (F.call_function("try_divide", F.greatest("forward", "reverse").cast("double"), low.cast("double")) <= disbalance))
    if max_entropy is not None:
        ok = ok & (entropy10([F.col(c) for c in cols]) <= max_entropy)
    out = profile
    for b, c in zip(BASES, cols):
        share = F.coalesce(F.call_function("try_divide", F.col(c) * 1.0, total), F.lit(0.0))
        out = out.withColumn(f"_{c}", F.when(ok & (share * 100 >= min_freq_pct) & (share > (noise or {}).get(b, -1.0)), F.col(c)).otherwise(0))
    return out.select(*[F.col(f"_{c}").alias(c) if c in cols else F.col(c) for c in profile.columns])


def snp_calls(profile: DataFrame, reference: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """sub, pos, ref, snp, frequency, coverage for every base off the reference (sub, pos, ref) at ``cutoff`` or more."""
    rows = profile.join(reference, ["sub", "pos"])
    each = rows.select("sub", "pos", "ref", F.col("count_total").alias("coverage"), F.explode(F.array(*[F.struct(F.lit(b).alias("snp"), F.col(f"count_{b.lower()}").alias("n")) for b in BASES])).alias("x"))
    freq = F.call_function("try_divide", F.col("x.n").cast("double"), F.col("coverage"))
    return each.where((F.col("x.snp") != F.col("ref")) & (freq >= min(max(cutoff, 0.0), 1.0))).select("sub", "pos", "ref", F.col("x.snp").alias("snp"), freq.alias("frequency"), "coverage")


def consensus(profile: DataFrame) -> DataFrame:
    """sub, consensus: the most frequent base of each position in order (N without cover; ties in order A, C, G, T)."""
    best = F.lit("N")
    top = F.greatest(*[F.col(f"count_{b.lower()}") for b in BASES])
    for b in reversed(BASES):
        best = F.when((F.col(f"count_{b.lower()}") == top) & (top > 0), F.lit(b)).otherwise(best)
    return profile.groupBy("sub").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", best.alias("b")))), lambda x: x["b"]), "").alias("consensus"))


def contigs(profile: DataFrame, min_cover: int = 1, max_gap: int = 10) -> DataFrame:
    """Runs of covered positions: run_start, run_end, n, mean_value (cover), gap_before."""
    return islands(profile.where(F.col("count_total") >= min_cover), ["sub"], "pos", max_gap, F.col("count_total"))


def with_zeros(profile: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every position 1..length of each subject (sub, length); absent counts are 0."""
    every = lengths.where("length > 0").select("sub", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("length").cast("bigint"))).alias("pos"))
    return every.join(profile, ["sub", "pos"], "left").fillna(0)


def gap_windows(profile: DataFrame, lengths: DataFrame, window: int = 30, threshold: int = 1, min_length: int = 10, width: int = 1 << 16) -> DataFrame:
    """Stretches with and without cover over every position of the subjects (sub, length) of a profile (sub, pos, count_total).

    A stretch begins at the first position and, from position ``window`` + 1 on, wherever the sum of the last ``window``
    covers comes to lie over or under ``window * threshold``.  Rows: sub, run_start, run_end, length, covered (its own sum
    is above ``threshold`` a position), mean_cover (whole, at least 1 if covered), counted (``min_length`` or longer).
    Positions are dealt to bins of ``width`` with the ``window`` positions before them; a subject's stretches join over bins.
    """
    if width <= window:
        raise ValueError("bins are wider than the window")
    i, home = F.col("pos") - 1, F.floor((F.col("pos") - 1) / F.lit(width))
    cells = with_zeros(profile.select("sub", "pos", "count_total"), lengths)
    dealt = cells.withColumn("_bin", F.explode(F.when(i % width >= width - window, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy("sub", "_bin").orderBy("pos")
    state = dealt.withColumn("_on", F.sum("count_total").over(w.rowsBetween(1 - window, 0)) > window * threshold)
    begins = (F.col("_bin") == home) & ((i == 0) | ((i >= window) & (F.col("_on") != F.lag("_on").over(w))))
    parts = state.withColumn("_k", F.when(begins, 1).otherwise(0)).withColumn("_k", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_bin") == home)
    parts = parts.groupBy("sub", "_bin", "_k").agg(F.min("pos").alias("run_start"), F.max("pos").alias("run_end"), F.sum("count_total").alias("_sum"))
    opened = F.sum(F.when(F.col("_k") > 0, 1).otherwise(0)).over(Window.partitionBy("sub").orderBy("run_start").rowsBetween(Window.unboundedPreceding, 0))
    runs = parts.withColumn("_run", opened).groupBy("sub", "_run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("_sum").alias("cover"))
    length = F.col("run_end") - F.col("run_start") + 1
    covered = F.col("cover") > F.greatest(length, F.lit(window)) * threshold
    mean = F.floor(F.col("cover") / length)
    return runs.select("sub", "run_start", "run_end", length.alias("length"), "cover", covered.alias("covered"), F.when(covered, F.greatest(mean, F.lit(1).cast("bigint"))).otherwise(mean).alias("mean_cover"), (length >= min_length).alias("counted"))


def gap_summary(stretches: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per subject contigs, gaps, their lengths and mean covers over the counted stretches, and the share of the subject in contigs."""
    on = F.col("counted") & F.col("covered")
    off = F.col("counted") & ~F.col("covered")
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("bigint")
    mean = lambda c, n: F.coalesce(F.call_function("try_divide", F.col(c).cast("double"), F.col(n)), F.lit(0.0))
    sums = stretches.groupBy("sub").agg(F.count_if(on).alias("contigs"), F.count_if(off).alias("gaps"), total(on, "length").alias("contig_length"), total(off, "length").alias("gap_length"), total(on, "cover").alias("_c"), total(off, "cover").alias("_g"))
    out = sums.join(lengths.select("sub", F.col("length").alias("_l")), "sub")
    return out.select("sub", "contigs", "gaps", "contig_length", "gap_length", mean("_c", "contig_length").alias("contig_cover"), mean("_g", "gap_length").alias("gap_cover"), (F.col("contig_length") * 100.0 / F.col("_l")).alias("contig_pct"))


def annotate(positions: DataFrame, annotations: DataFrame, width: int = 1000) -> DataFrame:
    """Positions (sub, pos, ...) with the annotations (sub, start, end, id, type) that hold them."""
    p = positions.withColumn("_e", F.col("pos"))
    return range_join(p, annotations, ["sub"], ("pos", "_e"), ("start", "end"), width).drop("_e")


def spliced(exons: DataFrame) -> DataFrame:
    """Exons (sub, id, strand, start, end) with ``cds_start``: how many coding letters of the same id lie before, in its own direction."""
    w = Window.partitionBy("sub", "id").orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("cds_start", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0)).cast("bigint"))


def codon_effect(calls: DataFrame, frames: DataFrame) -> DataFrame:
    """Calls in coding ranges (sub, start, end, id, cds): aa_pos, aa_ref, aa_sub by the standard code.

    ``cds`` is the whole coding sequence in its own direction.  With a column ``strand``, ranges on ``-`` are read from
    their end and the called letter is complemented; with ``cds_start`` (see ``spliced``) a codon may span two exons.
    """
    hit = annotate(calls, frames)
    back = F.col("strand") == "-" if "strand" in frames.columns else F.lit(False)
    off = F.when(back, F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    off = off + F.col("cds_start") if "cds_start" in frames.columns else off
    codon = F.substr("cds", F.floor(off / 3).cast("int") * 3 + 1, F.lit(3))
    k = (off % 3).cast("int")
    letter = F.when(back, revcomp(F.col("snp"))).otherwise(F.col("snp"))
    changed = F.concat(F.substr(codon, F.lit(1), k), letter, F.substr(codon, k + 2, F.lit(3)))
    return hit.select("sub", "pos", "snp", "id", (F.floor(off / 3) + 1).alias("aa_pos"), amino(codon).alias("aa_ref"), amino(changed).alias("aa_sub"))


def insertion_sites(sites: DataFrame, annotations: DataFrame, width: int = 1000) -> DataFrame:
    """Per annotation: sites, reads, entropy (natural) of the reads over the sites, centre of balance (0..1)."""
    hit = annotate(sites, annotations, width)
    by = hit.groupBy("sub", "id", "start", "end").agg(
        F.count_distinct("pos").alias("sites"), F.sum("n").alias("reads"), F.sum(F.col("n") * F.ln("n")).alias("_l"), F.sum(F.col("n") * (F.col("pos") - F.col("start"))).alias("_m"),
    )
    return by.select("sub", "id", "sites", "reads", (F.ln("reads") - F.col("_l") / F.col("reads")).alias("entropy"), (F.col("_m") / F.col("reads") / F.greatest(F.col("end") - F.col("start"), F.lit(1))).alias("centre"))


def differential(profiles: dict[str, DataFrame], value: str = "count_total", top: float = 2.0) -> DataFrame:
    """Positions over several profiles: a column for each, and the ratio of the largest to the smallest (at least ``top``)."""
    out = None
    for name, p in profiles.items():
        one = p.select("sub", "pos", F.col(value).alias(name))
        out = one if out is None else out.join(one, ["sub", "pos"], "full_outer")
    cells = [F.coalesce(F.col(n), F.lit(0)).cast("double") for n in profiles]
    ratio = F.call_function("try_divide", F.greatest(*cells), F.greatest(F.least(*cells), F.lit(1.0)))
    return out.select("sub", "pos", *[c.alias(n) for c, n in zip(cells, profiles)], ratio.alias("ratio")).where(F.col("ratio") >= top)


def recombination(hits: DataFrame, parents: tuple[str, str]) -> DataFrame:
    """pos, count and share of each of two parents' reads."""
    a, b = (F.count_if(F.col("sub") == p) for p in parents)
    by = hits.where(F.col("sub").isin(*parents)).groupBy("pos").agg(a.alias("first"), b.alias("second"))
    return by.withColumn("first_share", F.call_function("try_divide", F.col("first").cast("double"), F.col("first") + F.col("second")))


def screen(hits: DataFrame, closure: DataFrame, depth: int, cutoff: float = 0.05) -> DataFrame:
    """Taxa at ``depth`` below the root that hold at least ``cutoff`` of the reads (read, taxid)."""
    level = closure.groupBy("node").agg(F.max("depth").alias("level"))
    at = closure.join(level.where(F.col("level") == depth).select(F.col("node").alias("ancestor")), "ancestor").select(F.col("node").alias("taxid"), "ancestor")
    total = hits.agg(F.count("*").alias("all"))
    by = hits.join(at, "taxid").groupBy("ancestor").agg(F.count("*").alias("reads")).crossJoin(F.broadcast(total))
    return by.select("ancestor", "reads", (F.col("reads") / F.col("all")).alias("share")).where(F.col("share") >= cutoff)


def smith_waterman(pairs: DataFrame, match: int = 5, mismatch: int = -4, gap_open: int = -12, gap_next: int = -6, band: int = 32) -> DataFrame:
    """Adds score, s_start, s_end, q_start, q_end of the best local alignment of ``query`` and ``subject`` in a band about ``diagonal`` (see ``alignments``)."""
    from .alignments import local_alignments

    return local_alignments(pairs, match, mismatch, gap_open, gap_next, band).drop("matches")


def simulate_reads(subjects: DataFrame, per_subject: int, length: int, error: float = 0.01, seed: int = 1) -> DataFrame:
    """id, sub, start, seq: reads from random places with random substitutions (seeded, distributed)."""
    each = subjects.where(F.length("seq") >= length).select("id", "seq", F.explode(F.sequence(F.lit(1), F.lit(per_subject))).alias("k"))
    at = each.withColumn("start", F.floor(F.rand(seed) * (F.length("seq") - length + 1)).cast("int"))
    cut = at.withColumn("cut", F.substr("seq", F.col("start") + 1, F.lit(length)))
    roll = cut.withColumn("_r", F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.pmod(F.xxhash64(F.col("id"), F.col("k"), i, F.lit(seed)), F.lit(1_000_000))))
    cells = F.zip_with(F.filter(F.split("cut", ""), lambda x: x != ""), F.col("_r"), lambda b, r: F.when(r < int(error * 1_000_000), F.element_at(F.array(*[F.lit(x) for x in BASES]), (r % 4 + 1).cast("int"))).otherwise(b))
    return roll.select(F.concat_ws("_", F.col("id").cast("string"), F.col("k").cast("string")).alias("id"), F.col("id").alias("sub"), "start", F.array_join(cells, "").alias("seq"))


def population(clones: DataFrame) -> DataFrame:
    """Per position: clones, cover, shannon and simpson of the clones' shares (clone, start, end, weight)."""
    each = clones.select("clone", "weight", F.explode(F.sequence("start", "end")).alias("pos"))
    by = each.groupBy("pos").agg(F.count_distinct("clone").alias("clones"), F.sum("weight").alias("cover"), F.sum(F.col("weight") * F.ln("weight")).alias("_l"), F.sum(F.col("weight") * F.col("weight")).alias("_q"))
    return by.select("pos", "clones", "cover", (F.ln("cover") - F.col("_l") / F.col("cover")).alias("shannon"), (F.col("_q") / (F.col("cover") * F.col("cover"))).alias("simpson"))


