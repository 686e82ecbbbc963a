"""Annotation, taxonomy and codon tables: searches, views, counts and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach
from .ranges import range_join

# annotations: sub, start, end, id, type


def search(annotations: DataFrame, pattern: str, columns: tuple[str, ...] = ("id", "type")) -> DataFrame:
    """Annotations with a column that matches the regex, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.rlike(c, F.lit(f"(?i){pattern}")), F.lit(False))
    return annotations.where(hit)


def view(annotations: DataFrame, sub: str, start: int, end: int) -> DataFrame:
    """Annotations that overlap a viewport."""
    return annotations.where((F.col("sub") == sub) & (F.col("start") <= end) & (F.col("end") >= start))


def id_types(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def seq_ids(annotations: DataFrame) -> DataFrame:
    return annotations.select("sub").distinct()


def of_genes(annotations: DataFrame, genes: DataFrame) -> DataFrame:
    """Annotations whose id is in a gene list (id)."""
    return annotations.join(genes.select("id").distinct(), "id", "left_semi")


def mapped(positions: DataFrame, files: dict[str, DataFrame], mode: str = "any", width: int = 1000) -> DataFrame:
    """Positions (sub, pos, ...) with the annotations of several files; mode ``all`` keeps positions found in every file."""
    out = None
    for name, a in files.items():
        p = positions.withColumn("_e", F.col("pos"))
        one = range_join(p, a, ["sub"], ("pos", "_e"), ("start", "end"), width).drop("_e").withColumn("file", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if mode == "any":
        return out
    full = out.groupBy("sub", "pos").agg(F.count_distinct("file").alias("_n")).where(F.col("_n") == len(files))
    return out.join(full.select("sub", "pos"), ["sub", "pos"], "left_semi")


# taxonomy: taxid_parent (taxid, parent, rank), taxid_name (taxid, name, tag)


def tax_info(parents: DataFrame, names: DataFrame, taxid: int) -> DataFrame:
    """taxid, rank, name, depth of a taxon and all above it."""
    edges = parents.where("taxid <> parent").select(F.col("taxid").alias("src"), F.col("parent").alias("dst"))
    seed = parents.sparkSession.range(1).select(F.lit(taxid).cast("bigint").alias("seed"))
    up = reach(seed, edges).select(F.col("node").alias("taxid"), "depth")
    main = names.where(F.col("tag") == "scientific name").select("taxid", "name")
    return up.join(parents.select("taxid", "rank"), "taxid").join(main, "taxid", "left")


def tax_children(parents: DataFrame, taxid: int, depth: int | None = 1) -> DataFrame:
    edges = parents.where("taxid <> parent").select(F.col("parent").alias("src"), F.col("taxid").alias("dst"))
    seed = parents.sparkSession.range(1).select(F.lit(taxid).cast("bigint").alias("seed"))
    return reach(seed, edges, depth).where("depth > 0").select(F.col("node").alias("taxid"), "depth")


def tax_by_name(names: DataFrame, text: str) -> DataFrame:
    return names.where(F.contains(F.lower("name"), F.lit(text.lower())))


def codon_table(usage: DataFrame, taxa: DataFrame | None, include: Column | None = None) -> DataFrame:
    """codon, n summed over the rows of a wide codon table (taxid, AAA, AAC, ...) for taxa (taxid; null: all)."""
    rows = usage if taxa is None else usage.join(taxa.select("taxid").distinct(), "taxid", "left_semi")
    rows = rows if include is None else rows.where(include)
    codons = [c for c in usage.columns if len(c) == 3 and set(c) <= set("ACGTU")]
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in codons])
    return sums.unpivot([], codons, "codon", "n")


# alignments and profiles


def mutation_bias(cells: DataFrame) -> DataFrame:
    """read_pos, n, mismatches, rate from aligned letters (read_pos, base, ref)."""
    by = cells.groupBy("read_pos").agg(F.count("*").alias("n"), F.count_if(F.col("base") != F.col("ref")).alias("mismatches"))
    return by.withColumn("rate", F.col("mismatches") / F.col("n"))


def saturation(hits: DataFrame, steps: int = 100) -> DataFrame:
    """step, positions: how many positions (pos) are covered first by reads of each of ``steps`` equal shares of read order, running."""
    first = hits.groupBy("pos").agg(F.min("read").alias("read"))
    ends = hits.agg(F.min("read").alias("a"), (F.max("read") + 1).alias("b"))
    step = F.floor((F.col("read") - F.col("a")) * steps / (F.col("b") - F.col("a")))
    by = first.crossJoin(F.broadcast(ends)).groupBy(step.alias("step")).agg(F.count("*").alias("new"))
    return by.select("step", F.sum("new").over(Window.orderBy("step")).alias("positions"))


def noise_profile(profile: DataFrame, bins: int = 100) -> DataFrame:
    """ref, base, bin, n and the running n: histogram of the share of each base off the reference (sub, pos, ref, counts)."""
    bases = ("A", "C", "G", "T")
    each = profile.select("ref", "count_total", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"count_{b.lower()}").alias("n")) for b in bases])).alias("x"))
    share = F.col("x.n") / F.col("count_total")
    rows = each.where((F.col("count_total") > 0) & (F.col("x.base") != F.col("ref")))
    by = rows.groupBy("ref", F.col("x.base").alias("base"), F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return by.withColumn("running", F.sum("n").over(Window.partitionBy("ref", "base").orderBy("bin")))


def tails(hits: DataFrame, lengths: DataFrame, bins: int = 100) -> DataFrame:
    """bin, n: where along their subject (0..bins - 1 from the 5' end) alignments start (sub, sub_start; sub, length)."""
    place = F.floor(F.col("sub_start") * bins / F.col("length"))
    return hits.join(lengths, "sub").groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def multi_qc(samples: dict[str, DataFrame]) -> DataFrame:
    """sample, reads, letters, mean_length, gc_pct, n_pct of several read sets."""
    out = None
    for name, reads in samples.items():
        count = lambda b: F.sum(F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit(b), F.lit(""))))
        one = reads.agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("letters"), F.avg(F.length("seq")).alias("mean_length"), (count("G") + count("C")).alias("_gc"), count("N").alias("_n"))
        one = one.select(F.lit(name).alias("sample"), "reads", "letters", "mean_length", F.call_function("try_divide", F.col("_gc") * 100.0, F.col("letters")).alias("gc_pct"), F.call_function("try_divide", F.col("_n") * 100.0, F.col("letters")).alias("n_pct"))
        out = one if out is None else out.unionAll(one)
    return out
