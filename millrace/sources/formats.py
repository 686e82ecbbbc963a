"""Readers and writers of tables and sequence files.

Line formats are read by Spark's own text and CSV readers, so files split over executors; records of several lines are put
together from any blocks (see ``records``).
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import ROW, Table
from . import lattice, records

GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
BLAST = "query string, subject string, identity double, length long, mismatches long, gaps long, q_start long, q_end long, s_start long, s_end long, evalue double, bits double"


def read_csv(
    spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",", quote: str = '"', comment: str | None = None,
    schema: str | None = None, sample: int = 0, parse_start: int = 0, parse_count: int = 0, null: str = "", texts: tuple[str, ...] = (),
) -> DataFrame:
    """A delimited file, folder or list of them (.tsv and .tab: tabs), read by many tasks; a row window may be set.

    A quoted field may hold newlines, wherever the file's blocks are cut.  Types come from all values (see ``lattice``), or
    from ``schema``; with ``sample``, from that many rows, and a value that doesn't fit raises.  Every file has a header, or
    none.  Rows keep the order of files and lines.  Cells that a row lacks are null, cells beyond the columns are left out.
    A cell that reads ``null`` is null; with one that isn't empty, a quoted empty cell of a text column is an empty text.
    Columns named in ``texts`` are texts, whatever they hold.
    """
    sep = "\t" if isinstance(path, str) and path.endswith((".tsv", ".tab")) else sep
    options = {"header": str(header).lower(), "sep": sep, "quote": quote, "escape": quote, "multiLine": "false", "nullValue": null} | ({"comment": comment} if comment else {})
    options["charToEscapeQuoteEscaping"] = quote  # Spark's default is the character 0, which texts would lose
    lines, rule = records.blocks(spark, path), records.Quoted(sep, quote, comment)
    states = records.passed(lines, rule).collect()  # two rows a block
    known, continued = records.chained(states)
    if not continued and not any(r["returns"] for r in states):  # every record is a line: Spark's own reader
        names = spark.read.options(**options).csv(path).columns
        text = spark.read.options(**options, enforceSchema="true").schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        rows = records.cut(lines, rule, known).withColumn("text", F.regexp_replace("text", "\r$", ""))
        first = rows.groupBy("file").agg(F.min(F.struct("block", "k", "text")).alias("first"))
        head = next(csv.reader(io.StringIO(first.orderBy("file").first()["first"]["text"]), delimiter=sep, quotechar=quote))
        names = column_names(head) if header else [f"_c{i}" for i in range(len(head))]
        if header:
            rows = rows.join(F.broadcast(first.select("file", F.col("first.block").alias("block"), F.col("first.k").alias("k"))), ["file", "block", "k"], "left_anti")
        parse = {k: v for k, v in options.items() if k not in ("header", "comment")} | {"maxCharsPerColumn": "-1"}
        text = rows.orderBy("file", "block", "k").select(F.from_csv("text", _ddl(names), parse).alias("r")).select("r.*")
    if schema:
        kinds = [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(schema).fields]
        df = text.toDF(*[n for n, _ in kinds]).select(*[F.col(f"`{n}`").try_cast(k).alias(n) for n, k in kinds])
    else:
        df = lattice.widened(text, text.limit(sample) if sample else None, texts)
    if parse_start or parse_count:
        t = Table.of(df).numbered()
        inside = F.col(ROW) >= parse_start
        df = t.where(inside & (F.col(ROW) < parse_start + parse_count) if parse_count else inside).result()
    return df


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def column_names(head: list[str]) -> list[str]:
    """Names of a header record: an empty one is _c and its place, a repeated one gets its place."""
    low = [n.lower() for n in head]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(head)]


def read_tables(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Files of one shape, one after the other in natural order of their names, by position; ``input_name`` tells the file."""
    natural = sorted(paths, key=lambda p: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", p)])
    out = None
    for p in natural:
        df = read_csv(spark, p, **options).withColumn("input_name", F.lit(p.rsplit("/", 1)[-1]))
        out = df if out is None else out.union(df)
    return out


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO (map) and any further columns; ``##`` lines are left out."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("##")))
    head = lines.where(F.startswith("value", F.lit("#"))).first()
    names = head[0][1:].split("\t") if head else ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    cells = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    kinds = {"POS": "bigint", "QUAL": "double"}
    cols = [(F.get(cells, F.lit(i)).try_cast(kinds[n]) if n in kinds else F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)]
    df = rows.select(*cols)
    if "INFO" in names:
        df = df.withColumn("INFO", F.call_function("str_to_map", F.col("INFO"), F.lit(";"), F.lit("=")))
    return df


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Nine fixed columns; ``attributes`` as a map of key "value" and key=value pairs."""
    df = spark.read.options(sep="\t", comment="#", quote="").schema(GTF).csv(path)
    pairs = F.filter(F.transform(F.split("attributes", ";"), lambda x: F.trim(x)), lambda x: x != "")
    kv = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^\s=]+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[^\s=]+[\s=]+(.*)$", 1), '^"|"$', "").alias("value")))
    one = F.filter(kv, lambda x: x["key"] != "")
    return df.withColumn("attributes", F.map_from_arrays(F.array_distinct(F.transform(one, lambda x: x["key"])), F.transform(F.array_distinct(F.transform(one, lambda x: x["key"])), lambda k: F.element_at(F.filter(one, lambda x: x["key"] == k), -1)["value"])))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    schema = "chrom string, start long, end long, name string, score double, strand string"
    return spark.read.options(sep="\t", comment="#", mode="PERMISSIVE").schema(schema).csv(path).where("start is not null")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, description, seq; a record begins at a line with ``>``, whichever block it falls into."""
    rows = records.records(spark, path, records.Headed(">"))
    head = F.regexp_extract("text", r"^>([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("text", r"^[^\r\n]*", ""), r"\s+", "")
    return rows.select(F.substring_index(head, " ", 1).alias("id"), F.regexp_replace(head, r"^\S*\s*", "").alias("description"), body.alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], offset: int = 33) -> DataFrame:
    """id, seq, qual (array of int): four lines a record, whichever blocks they fall into.

    A record whose first line lacks ``@``, whose third lacks ``+``, or with another number of qualities than letters raises.
    """
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    cells = records.records(spark, path, records.FourLines()).select(lines.alias("l"))
    head, seq, plus, qual = (F.get("l", F.lit(i)) for i in range(4))
    good = F.startswith(head, F.lit("@")) & F.startswith(plus, F.lit("+")) & (F.length(seq) == F.length(qual))
    name = F.when(good, F.substring_index(F.substring(head, 2, 1 << 30), " ", 1)).otherwise(F.raise_error(F.concat(F.lit("not a record of four lines: "), F.coalesce(head, F.lit("")))))
    values = F.transform(F.filter(F.split(qual, ""), lambda x: x != ""), lambda x: F.ascii(x) - offset)
    return cells.select(name.alias("id"), seq.alias("seq"), values.alias("qual"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed columns, typed, and ``tags``; header lines are left out."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    cells, ints = F.split("value", "\t"), {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [(F.get(cells, F.lit(i)).try_cast("bigint") if n in ints else F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(SAM)]
    return rows.select(*cols, F.slice(cells, 12, F.greatest(F.size(cells) - 11, F.lit(0))).alias("tags"))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n int, op string>>"""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def cigar_length(cigar: Column) -> Column:
    """Letters of the reference an alignment covers."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda s, x: s + x["n"])


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular output with its twelve columns."""
    return spark.read.options(sep="\t", comment="#").schema(BLAST).csv(path)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """locus, definition, organism, seq, features array<struct<type, location, qualifiers map>>; records end at ``//``."""
    schema = "locus string, definition string, organism string, seq string, features array<struct<type:string,location:string,qualifiers:map<string,string>>>"

    def record(text: str) -> tuple:
        head = dict(re.findall(r"^(LOCUS|DEFINITION)\s+(.*(?:\n {12}.*)*)", text, re.M))
        organism = re.search(r"^  ORGANISM\s+(.*)", text, re.M)
        body = re.search(r"^FEATURES.*\n((?: .*\n?)*)", text, re.M)
        found = []
        for kind, rest in re.findall(r"^ {5}(\S+)\s+((?:.*)(?:\n {21}.*)*)", body[1] if body else "", re.M):
            parts = re.split(r"\n {21}(?=/)", rest)
            pairs = (q[1:].partition("=") for q in parts[1:])
            found.append({"type": kind, "location": re.sub(r"\s+", "", parts[0]), "qualifiers": {k: re.sub(r"\s*\n\s+", " ", v).strip('"') for k, _, v in pairs}})
        origin = re.search(r"^ORIGIN.*\n((?:.|\n)*)", text, re.M)
        seq = re.sub(r"[^A-Za-z]", "", origin[1]).upper() if origin else ""
        return head.get("LOCUS", "").split(" ")[0], re.sub(r"\s+", " ", head.get("DEFINITION", "")), organism[1].strip() if organism else None, seq, found

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [record(v) for v in b["value"] if v.strip()]
            yield pd.DataFrame(rows, columns=["locus", "definition", "organism", "seq", "features"])

    return spark.read.option("lineSep", "//\n").text(path).mapInPandas(run, schema)


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(taxid, parent, rank) and (taxid, name, tag) from dump files whose cells end at tab-bar."""

    def cells(path: str, schema: dict[str, tuple[int, str]]) -> DataFrame:
        c = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
        return spark.read.text(path).select(*[F.get(c, F.lit(i)).cast(k).alias(n) for n, (i, k) in schema.items()])

    return cells(nodes, {"taxid": (0, "bigint"), "parent": (1, "bigint"), "rank": (2, "string")}), cells(names, {"taxid": (0, "bigint"), "name": (1, "string"), "tag": (3, "string")})


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """The cells of one sheet as texts (columns A, B, ...), a file a task."""

    def cells(data: bytes) -> list[dict[str, str]]:
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{ns['m']}}}row"):
                out = {}
                for c in row.findall("m:c", ns):
                    v, inline = c.find("m:v", ns), c.find("m:is", ns)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text if v is not None else None
                    out[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                rows.append(out)
            return rows

    def run(batches):
        import pandas as pd

        for b in batches:
            for data in b["content"]:
                rows = cells(bytes(data))
                yield pd.DataFrame({"row": list(range(1, len(rows) + 1)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, cells map<string,string>")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A query's rows from a SQLite file that the driver can open (a small catalog file, not a cluster source)."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return spark.createDataFrame(db.execute(query).fetchall(), schema)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A database table; with a whole-number column, in ``parts`` range scans."""
    more = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **more, **options).load()


# sinks

#: Options of Spark's CSV writer under which ``read_csv`` reads all texts back, with their outer blanks, quotes and backslashes.
CSV = {"header": "true", "escape": '"', "quoteAll": "true", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def metadata(t: Table, categories: dict[str, object] | None = None) -> str:
    """Column names and types, and named categories, as JSON."""
    kinds = {"bigint": "int", "int": "int", "double": "real", "float": "real", "boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    cols = [{"name": n, "type": kinds.get(k, k)} for n, k in zip(t.names, t.types)]
    return json.dumps({"columns": cols, "categories": {k: v if isinstance(v, list) else None for k, v in (categories or {}).items()}})


def write_table(t: Table, path: str, kind: str = "csv", categories: dict[str, object] | None = None) -> None:
    """csv, json or parquet in row order, with ``<path>.metadata`` beside it."""
    df = t.result()
    writer = Table(t.df, t.names).df.orderBy(ROW).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)]).write.mode("overwrite")
    {"csv": lambda: writer.option("header", "true").csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
    t.df.sparkSession.createDataFrame([(metadata(t, categories),)], "value string").write.mode("overwrite").text(f"{path}.metadata")


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    cut = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), cut).alias("value"))


def fastq_lines(df: DataFrame, offset: int = 33) -> DataFrame:
    quals = F.array_join(F.transform("qual", lambda q: F.char(q + offset)), "")
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("id")), "seq", F.lit("+"), quals).alias("value"))


def sam_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in SAM]).alias("value"))


def bed_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), *[c for c in ("name", "score", "strand") if c in df.columns]).alias("value"))


def vcf_lines(calls: DataFrame) -> DataFrame:
    """SNP calls (sub, pos, ref, snp, frequency, coverage) as VCF rows."""
    info = F.format_string("AF=%.4f;DP=%d", "frequency", "coverage")
    return calls.select(F.concat_ws("\t", F.col("sub").cast("string"), F.col("pos").cast("string"), F.lit("."), "ref", "snp", F.lit("."), F.lit("PASS"), info).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)

