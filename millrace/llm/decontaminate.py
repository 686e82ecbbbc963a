"""Benchmark decontamination by template windows, in DataFrame functions alone.

Numbers, names (runs of capitalised words) and units after numbers become typed placeholders.  Windows of WINDOW tokens
are hashed at every place of documents and items in two lanes: ``lit`` has the words as they are (case aside), ``tpl``
one placeholder for each number, name or unit.  Both sides are joined on the hashes, so a run of RUN equal tokens is
found however it is aligned.  Template windows carry the placeholders' values: a pair counts as re-parameterised only if
each value of the item goes with one value of the document throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

WINDOW, RUN, LONG, LEAST = 8, 11, 15, 5
#: Tokens beside the placeholders that a template window needs: placeholders alone tell nothing.
LITERAL = 2
#: Benchmark windows that are broadcast at most (about 40 bytes each).
BROADCAST = 400_000
UNITS = "kg|g|mg|lb|lbs|km|m|cm|mm|mi|mile|miles|ft|inch|inches|l|ml|h|hr|hrs|hour|hours|min|minutes|s|sec|seconds|day|days|week|weeks|year|years|percent|dollars|euros|usd|eur|kb|mb|gb|hz|khz|mhz|ghz|w|kw|v|c|f|k"
#: What stands between the parts of one number or name, and after a name while texts are marked.
JOINED, ENDED = "\u00b7", "\ue003"
LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"


#: Ids of dropped documents that are broadcast at most (8 bytes each); beyond, both sides meet by id.
DROPPED = 1_000_000


def with_tokens(rows: DataFrame) -> DataFrame:
    """Puts ``tok`` in place of ``text``: its words, lower-cased; ``num0``, ``nam0`` and ``uni0`` stand before numbers, names and units.

    A name is a run of words with a capital first letter and one blank between them; points and commas between digits
    belong to the number.
    """
    t = F.col("text")
    named = F.regexp_replace(t, rf"(?<![{LETTER}])(\p{{Lu}}[{LETTER}]*)", f"nam0$1{ENDED}")
    named = F.replace(F.replace(named, F.lit(f"{ENDED} nam0"), F.lit(JOINED)), F.lit(ENDED), F.lit(""))
    rows = rows.withColumn("text", F.lower(named))
    whole = F.regexp_replace(F.regexp_replace(t, "(?<=[0-9])[.,](?=[0-9])", JOINED), f"([0-9]+(?:{JOINED}[0-9]+)*)", "num0$1")
    counted = F.replace(whole, F.lit("namnum00"), F.lit("nam0"))
    measured = F.regexp_replace(counted, rf"(num0[0-9{JOINED}]+ ?)({UNITS})\b", "$1 uni0$2")
    rows = rows.withColumn("text", F.when(F.rlike(F.replace(t, F.lit("nam0"), F.lit("")), F.lit("[0-9]")), measured).otherwise(t))
    rows = rows.withColumn("text", F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))
    return rows.withColumn("tok", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))).drop("text")


def _words(tok: Column) -> Column:
    """The words without marks; parts of one number or name are words of their own."""
    line = F.array_join(tok, " ")
    for mark in ("nam0", "num0", "uni0"):
        line = F.replace(line, F.lit(mark), F.lit(""))
    return F.split(F.replace(line, F.lit(JOINED), F.lit(" ")), " ")


def _slot(x: Column) -> Column:
    return F.substring(x, 1, 4).isin("num0", "nam0", "uni0")


def _hashes(rows: DataFrame) -> DataFrame:
    """Adds to ``tok`` the lanes ``lit``, the hashes of the words, and ``tpl``, those of tokens without values; ``tpl`` is null without placeholders."""
    rows = rows.withColumn("marked", F.exists("tok", _slot))
    words = F.when(F.col("marked"), _words(F.col("tok"))).otherwise(F.col("tok"))
    masked = F.transform("tok", lambda x: F.xxhash64(F.when(_slot(x), F.substring(x, 1, 4)).otherwise(x)))
    return rows.withColumn("lit", F.transform(words, lambda x: F.xxhash64(x))).withColumn("tpl", F.when(F.col("marked"), masked)).drop("marked")


def _windows(width: int, lane: str) -> Column:
    """array<struct<hash, at>> over every place of ``lit`` or ``tpl``; empty for a null lane."""
    size = F.size(lane)
    starts = F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(width), F.lit(lane), *[F.get(lane, i + k) for k in range(width)]).alias("hash"), i.alias("at")))


def _slots(at: Column, width: Column) -> Column:
    return F.filter(F.slice("tok", at + 1, width), _slot)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, literal for each document and item that share enough.

    ``docs``: doc_id, text; ``benchmark``: item_id, text (other columns are ignored).  Enough: matched windows of one lane
    that cover RUN tokens of the item, or WINDOW where it is shorter than LONG tokens; an item of fewer than RUN tokens is
    looked for whole, one of fewer than LEAST literally.  A template window needs LITERAL tokens beside its placeholders.
    Where a document gives one value of an item several values, template windows with placeholders don't count.
    ``literal``: the words alone are enough.  Null texts and ids match nothing; repeated rows of a doc_id count as one
    document; an empty table on either side gives no rows; a very long text is one row of hashes, whatever its length.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    items = base.save(_hashes(with_tokens(items).where(F.size("tok") > 0)))
    index, widths = None, {}
    for lane in ("lit", "tpl"):
        size = F.size(lane)
        short = [r["n"] for r in items.where(size.between(1 if lane == "lit" else LEAST, RUN - 1)).select(size.alias("n")).distinct().collect()]  # below RUN values
        widths[lane] = [WINDOW, *(n for n in short if n != WINDOW)]
        for width, some in [(WINDOW, size >= RUN), *((n, size == n) for n in short)]:
            part = items.where(some).select("item_id", size.alias("n"), "tok", F.inline(_windows(width, lane)))
            slots = _slots(F.col("at"), F.lit(width)) if lane == "tpl" else F.array().cast("array<string>")
            part = part.select("hash", "item_id", "n", F.lit(width).alias("width"), F.lit(lane).alias("lane"), F.col("at").alias("item_at"), slots.alias("item_slots"))
            part = part.where(F.size("item_slots") <= width - LITERAL) if lane == "tpl" else part
            index = part if index is None else index.unionAll(part)
    index = base.save(index)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    every = F.concat(*[_windows(w, lane) for lane in ("lit", "tpl") for w in widths[lane]])
    found = _hashes(with_tokens(rows)).select("doc_id", "copy", F.inline(every))
    joined = base.save(found.join(F.broadcast(index) if index.count() <= BROADCAST else index, "hash").drop("hash"))
    place = ("item_id", "lane", "n", "width", "item_at")
    filled = joined.where(F.size("item_slots") > 0)
    # the values of the few documents that meet a template, at the places where they do
    wanted = filled.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("at", "width")).alias("want"))
    again = with_tokens(rows.dropDuplicates(["doc_id", "copy"]).join(wanted, ["doc_id", "copy"]))
    values = again.select("doc_id", "copy", F.inline(F.transform("want", lambda x: F.struct(x["at"].alias("at"), x["width"].alias("width"), _slots(x["at"], x["width"]).alias("slots")))))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    varied = filled.join(values, ["doc_id", "copy", "at", "width"]).select("doc_id", "copy", *place, shift, "slots", "item_slots")
    varied = base.save(varied)
    run = ("doc_id", "copy", "item_id", "shift")
    ranges = varied.select(*run, F.inline(F.arrays_zip("item_slots", "slots"))).groupBy(*run, "item_slots").agg(F.min("slots").alias("lo"), F.max("slots").alias("hi"))
    steady = ranges.groupBy(*run).agg(F.bool_and(F.col("lo") == F.col("hi")).alias("steady")).where("steady").drop("steady")
    moved = varied.join(steady, [*run], "left_semi").select("doc_id", *place)
    places = joined.where(F.size("item_slots") == 0).select("doc_id", *place).unionAll(moved)
    counted = places.groupBy("doc_id", "item_id", "lane", "n", "width").agg(F.array_sort(F.collect_set("item_at")).alias("ats"))
    none = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate("ats", none, lambda acc, x: F.struct((acc["covered"] + x + F.col("width") - F.greatest(x, acc["end"])).alias("covered"), (x + F.col("width")).alias("end")), lambda acc: acc["covered"])
    enough = F.when(F.col("n") >= LONG, RUN).when(F.col("n") >= RUN, WINDOW).otherwise(F.col("n"))
    good = counted.where(covered >= enough).select("doc_id", "item_id", (F.col("lane") == "lit").alias("literal"), F.size("ats").cast("long").alias("n_windows"))
    return good.groupBy("doc_id", "item_id").agg(F.max_by("n_windows", "literal").alias("n_windows"), F.max("literal").alias("literal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose doc_id matches no item; rows with a null doc_id stay."""
    gone = base.save(matches(docs, benchmark).select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= DROPPED else gone, "doc_id", "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
