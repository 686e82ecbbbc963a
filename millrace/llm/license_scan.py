"""License scans by ordered signature rules, in DataFrame functions alone.

Texts are reduced to words; a few base phrases are counted everywhere.  The method's rules are regexes over the
words, each with a label, a priority and a keyword that must occur in the text before the regex runs: passages of the
licenses' own texts and notices, and their names with versions.  Where the places of two rules overlap, the one of lower
priority that lies inside the other's interval is suppressed.  Places are compared within runs of places that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrase and label: fixed values of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Marks of a match's begin and end; words hold no such bytes.
START, END = "\x01", "\x02"


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regex over words joined by one space); a longer, more exact signature ranks higher."""
    out: list[tuple[str, int, str, str]] = []

    def versions(label: str, keyword: str, name: str, numbers: str, later: bool = False) -> None:
        for number in numbers.split():
            words = number.replace(".", " ")
            bare = words.removesuffix(" 0")
            shown = f"(?:{words}|{bare})" if bare != words else words
            stop = "" if bare == words else "(?! [0-9])"
            out.append((f"{label}-{number}", 80, keyword, f"{name}(?: (?:v|version))? {shown}{stop}"))
            out.append((f"{label}-{number}", 82, keyword, f"version {shown} of the {name}"))
            short = label.replace("-", " ") + " "
            out.append((f"{label}-{number}", 80, short, short + words))
            if later:
                out.append((f"{label}-{number}-or-later", 90, keyword, f"{name}(?: (?:v|version))? {shown} or (?:any|at your option any)? ?later(?: version)?"))
                out.append((f"{label}-{number}-or-later", 90, keyword, f"version {shown} of the {name} or (?:at your option )?any later version"))
                out.append((f"{label}-{number}-only", 88, keyword, f"{name}(?: (?:v|version))? {shown} only"))
        out.append((label, 40, keyword, name))

    versions("gpl", "general public", "(?:gnu )?general public licen[sc]e", "1.0 2.0 3.0", later=True)
    versions("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", "2.1 3.0", later=True)
    versions("lgpl", "library general", "(?:gnu )?library general public licen[sc]e", "2.0", later=True)
    versions("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "1.0 3.0", later=True)
    versions("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3", later=True)
    versions("apache", "apache", "apache(?: software)? licen[sc]e", "1.0 1.1 2.0")
    versions("mpl", "mozilla", "mozilla public licen[sc]e", "1.0 1.1 2.0")
    versions("epl", "eclipse", "eclipse public licen[sc]e", "1.0 2.0")
    versions("cddl", "common development", "common development and distribution licen[sc]e", "1.0 1.1")
    versions("eupl", "european union", "european union public licen[sc]e", "1.0 1.1 1.2")
    versions("artistic", "artistic", "artistic licen[sc]e", "1.0 2.0")
    versions("osl", "open software", "open software licen[sc]e", "1.0 2.0 2.1 3.0")
    versions("afl", "academic free", "academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0")
    versions("ofl", "open font", "(?:sil )?open font licen[sc]e", "1.0 1.1")
    versions("bsl", "boost", "boost software licen[sc]e", "1.0")
    versions("cpl", "common public", "common public licen[sc]e", "1.0")
    versions("odbl", "open database", "open database licen[sc]e", "1.0")
    spelled = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for parts in ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa"):
        label, rank = "cc-" + parts.replace(" ", "-"), 60 + len(parts)
        words = " ".join(spelled[p] for p in parts.split())
        for number in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            tail = f"(?: international| unported| generic)? {number.replace('.', ' ')}"
            out.append((f"{label}-{number}", rank + 20, "cc by", f"cc {parts}{tail}"))
            out.append((f"{label}-{number}", rank + 20, "creative commons", f"creative commons {words}{tail}"))
        out.append((label, rank, "cc by", f"cc {parts}"))
        out.append((label, rank, "creative commons", f"creative commons {words}"))
    for label, rank, keyword, pattern in (
        ("cc0-1.0", 80, "cc0", "cc0(?: 1 0)?"),
        ("cc0-1.0", 80, "creative commons zero", "creative commons zero(?: v?1 0)?"),
        ("mit", 70, "mit licen", "(?:the )?mit licen[sc]e"),
        ("mit", 72, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("bsd-2-clause", 75, "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?"),
        ("bsd-3-clause", 75, "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?"),
        ("bsd-4-clause", 75, "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
        ("bsd", 45, "bsd", "bsd(?: style)? licen[sc]e"),
        ("bsd", 44, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("isc", 70, "isc licen", "isc licen[sc]e"),
        ("isc", 72, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("zlib", 70, "zlib", "zlib(?: libpng)? licen[sc]e"),
        ("unlicense", 70, "unlicense", "(?:the )?unlicense"),
        ("wtfpl", 70, "wtfpl", "wtfpl(?: version 2)?"),
        ("public-domain", 50, "public domain", "(?:in|into|to|released to) the public domain"),
        ("proprietary", 55, "confidential", "proprietary and confidential|confidential and proprietary"),
        ("proprietary", 54, "written permission", "(?:without|no part) (?:[a-z]+ ){0,12}?(?:prior )?written permission"),
        # passages of license texts and of the notices they ask for
        ("gpl", 46, "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("gpl-2.0-or-later", 92, "either version 2 of the license", "either version 2 of the license or at your option any later version"),
        ("gpl-3.0-or-later", 92, "either version 3 of the license", "either version 3 of the license or at your option any later version"),
        ("gpl", 46, "useful but without any warranty", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
        ("lgpl", 47, "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
        ("gfdl", 47, "permission is granted to copy distribute", "permission is granted to copy distribute and or modify this document"),
        ("apache-2.0", 84, "you may not use this file except", "you may not use this file except in compliance with the license"),
        ("apache-2.0", 83, "terms and conditions for use reproduction", "terms and conditions for use reproduction and distribution"),
        ("apache-1.1", 83, "includes software developed by the apache", "this product includes software developed by the apache software foundation"),
        ("mpl-2.0", 84, "this source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("mpl-1.1", 83, "the contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1"),
        ("epl", 46, "accompanying materials are made available", "the accompanying materials are made available under the terms of the eclipse public license"),
        ("mit", 73, "the above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", 71, "in no event shall the authors", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
        ("mit-0", 76, "mit no attribution", "mit no attribution"),
        ("x11", 74, "the name of the x consortium", "except as contained in this notice the name of the x consortium"),
        ("json", 76, "shall be used for good", "the software shall be used for good not evil"),
        ("bsd-3-clause", 76, "neither the name of", "neither the names? of (?:[a-z]+ ){0,12}?nor the names of its contributors may be used to endorse"),
        ("bsd-4-clause", 77, "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display"),
        ("bsd", 45, "redistributions of source code must", "redistributions of source code must retain the above copyright notice this list of conditions"),
        ("bsd", 45, "redistributions in binary form must", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
        ("0bsd", 78, "zero clause bsd", "zero clause bsd"),
        ("isc", 71, "the software is provided as is and", "the software is provided as is and (?:the author|isc) disclaims all warranties"),
        ("ntp", 73, "permission to use copy modify and distribute this", "permission to use copy modify and distribute this software and its documentation for any purpose"),
        ("zlib", 72, "in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software"),
        ("zlib", 72, "the origin of this software must not", "the origin of this software must not be misrepresented"),
        ("libpng", 72, "libpng", "libpng(?: and zlib)? licen[sc]e"),
        ("bsl-1.0", 84, "any person or organization obtaining", "any person or organization obtaining a copy of the software and accompanying documentation"),
        ("unlicense", 72, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
        ("wtfpl", 72, "do what the fuck", "do what the fuck you want to"),
        ("beerware", 72, "buy me a beer", "you can buy me a beer in return"),
        ("beerware", 72, "beerware", "beerware licen[sc]e"),
        ("cc0-1.0", 82, "waived all copyright", "waived all copyright and related or neighboring rights"),
        ("cc0-1.0", 81, "no copyright reserved", "no copyright reserved"),
        ("cc-by", 61, "copy and redistribute the material", "copy and redistribute the material in any medium or format"),
        ("cc-by-sa", 67, "distribute your contributions under the same", "distribute your contributions under the same license as the original"),
        ("cc-by-nc", 67, "for commercial purposes", "may not use the material for commercial purposes"),
        ("cc-by-nd", 67, "may not distribute the modified", "may not distribute the modified material"),
        ("artistic", 46, "artistic control over the development", "copyright holder maintains some semblance of artistic control over the development"),
        ("ofl-1.1", 83, "this font software is licensed", "this font software is licensed under the sil open font license version 1 1"),
        ("ofl", 46, "reserved font name", "with reserved font names?"),
        ("psf-2.0", 80, "python software foundation", "python software foundation licen[sc]e(?: version 2)?"),
        ("php-3.01", 81, "php licen", "php licen[sc]e version 3 01"),
        ("php", 46, "php licen", "php licen[sc]e"),
        ("ruby", 46, "ruby licen", "ruby licen[sc]e"),
        ("ncsa", 74, "university of illinois", "university of illinois(?: ncsa)? open source licen[sc]e"),
        ("postgresql", 74, "postgresql licen", "postgresql licen[sc]e"),
        ("curl", 74, "curl licen", "curl licen[sc]e"),
        ("openssl", 74, "for use in the openssl", "for use in the openssl toolkit"),
        ("openssl", 74, "openssl licen", "openssl licen[sc]e"),
        ("zpl-2.1", 80, "zope public", "zope public licen[sc]e(?: zpl)?(?: version)? 2 1"),
        ("zpl", 46, "zope public", "zope public licen[sc]e"),
        ("ms-pl", 74, "microsoft public", "microsoft public licen[sc]e"),
        ("ms-rl", 74, "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
        ("ftl", 74, "freetype", "(?:the )?freetype(?: project)? licen[sc]e"),
        ("ijg", 74, "independent jpeg", "based in part on the work of the independent jpeg group"),
        ("sleepycat", 74, "sleepycat", "sleepycat(?: public)? licen[sc]e"),
        ("vim", 74, "vim licen", "vim licen[sc]e"),
        ("unicode", 74, "unicode", "unicode licen[sc]e(?: agreement)?(?: v3)?"),
        ("icu", 74, "icu licen", "icu licen[sc]e"),
        ("w3c", 74, "w3c software", "w3c software(?: and document)?(?: notice and)? licen[sc]e"),
        ("odc-by-1.0", 80, "open data commons attribution", "open data commons attribution licen[sc]e(?: v1 0)?"),
        ("pddl-1.0", 80, "public domain dedication", "public domain dedication and licen[sc]e"),
        ("elastic-2.0", 80, "elastic licen", "elastic licen[sc]e(?: version)? 2(?: 0)?"),
        ("sspl-1.0", 80, "server side public", "server side public licen[sc]e(?: v(?:ersion)? ?1)?"),
        ("busl-1.1", 80, "business source", "business source licen[sc]e(?: version)?(?: 1 1)?"),
        ("commons-clause", 80, "commons clause", "commons clause(?: licen[sc]e)? condition"),
        ("polyform-noncommercial-1.0", 80, "polyform", "polyform noncommercial licen[sc]e 1 0(?: 0)?"),
        ("upl-1.0", 80, "universal permissive", "universal permissive licen[sc]e(?: v(?:ersion)? ?1 0)?"),
        ("mulan-psl-2.0", 80, "mulan", "mulan (?:psl v2|permissive software licen[sc]e version 2)"),
        ("cecill-2.1", 80, "cecill", "cecill (?:free software licen[sc]e agreement version )?2 1"),
        ("cecill", 46, "cecill", "cecill"),
        ("proprietary", 56, "unauthorized copying", "unauthorized copying (?:of this file )?(?:via any medium )?is strictly prohibited"),
        ("proprietary", 53, "may not be reproduced", "may not be reproduced (?:or |distributed |copied |transmitted |in ){0,6}(?:any form|whole or in part)"),
        ("copyright", 20, "copyright", "copyright(?: c)?(?: [0-9]{4})+"),
        ("copyright", 19, "copyright", "copyright"),
        ("reserved", 30, "all rights reserved", "all rights reserved"),
        ("licensed", 10, "licensed under", "licensed under"),
        ("licensed", 9, "license", "(?:subject to|terms of|under) (?:the|this) (?:[a-z]+ ){0,3}?license"),
    ):
        out.append((label, rank, keyword, pattern))
    return out


def words_of(text: Column) -> Column:
    """The words of the text, A-Z lower-cased, each with one blank before and after; one blank where it has none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))


def _blanks(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _marked(regexes: dict[int, str]) -> Column:
    """array<struct<rule, text>>: the words ``w`` with START before and END after each of the rule's matches."""
    marked = "regexp_replace(w, {}, '{}$0{}')"  # as SQL, which builds hundreds of columns at once
    return F.expr(f"array({', '.join(f'named_struct(\'rule\', {k}, \'text\', {marked.format(_quoted(f" (?:{r})(?= )"), START, END)})' for k, r in regexes.items())})")


def _pieces(text: Column) -> Column:
    """array<struct<match, whole>>: the text cut before each match; a piece has its match's length and its own, without marks."""
    size = lambda x: F.struct(F.length(F.substring_index(x, END, 1)).alias("match"), (F.length(x) - F.when(F.contains(x, F.lit(END)), 1).otherwise(0)).alias("whole"))
    return F.transform(F.split(text, START, -1), size)


def scan(docs: DataFrame, extra: list[tuple[str, int, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for each row of ``docs``.

    ``docs``: doc_id, text (others are ignored).  Words are runs of bytes that are not ASCII punctuation, blanks or controls.
    A null or empty text has no words and empty labels; first_word and last_word are null without a base place.
    ``detections`` (label, rank, a, b: from one place in the words joined by blanks up to another): the rules' places that
    no containing place of higher priority (or equal priority and longer) suppresses; equal places of equal priority all
    stay.  score: 1 - 2 ** -(detections), 0 without any.  Repeated rows are scanned alike; very long texts cost in
    proportion to their length and places.  An empty table gives no rows.
    """
    table = [*rules(), *(extra or [])]
    w = F.col("w")
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    counts, firsts, lasts, base_labels = [], [], [], []
    for phrase, label in BASE:
        there, padded = F.contains(w, F.lit(f" {phrase} ")), F.lit(f" {phrase} ")
        counts.append(F.when(there, F.regexp_count(w, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, _blanks(F.substring_index(w, f" {phrase} ", 1))))
        lasts.append(F.when(there, _blanks(F.substr(w, F.lit(1), F.length(w) - F.length(F.substring_index(w, f" {phrase} ", -1)) - F.length(padded)))))
        base_labels.append(F.when(there, F.lit(label)))
    by_keyword: dict[str, dict[int, str]] = {}
    for k, (_, _, keyword, regex) in enumerate(table):
        by_keyword.setdefault(keyword, {})[k] = regex
    # a keyword's rules share one test; null where it isn't in the text
    gated = [F.when(F.contains(w, F.lit(keyword)), _marked(regexes)) for keyword, regexes in by_keyword.items()]
    rows = rows.select(
        "doc_id",
        (_blanks(w) - 1).alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*base_labels))).alias("base"),
        F.filter(F.flatten(F.array_compact(F.array(*gated))), lambda x: F.contains(x["text"], F.lit(START))).alias("matches"),
    )
    matches = F.transform("matches", lambda x: F.struct(x["rule"].alias("rule"), _pieces(x["text"]).alias("pieces")))
    rows = base.save(rows.withColumn("matches", matches).withColumn("row", F.monotonically_increasing_id()))
    # places: running sums over a rule's pieces of one text
    names = F.expr(f"array({', '.join(f'named_struct(\'label\', {_quoted(a)}, \'rank\', {p})' for a, p, _, _ in table)})")
    pieces = rows.where(F.size("matches") > 0).select("row", F.inline("matches")).select("row", "rule", F.posexplode("pieces").alias("k", "piece"))
    order = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    places = pieces.withColumn("a", F.coalesce(F.sum("piece.whole").over(order), F.lit(0)).cast("int")).where("k > 0")
    places = places.select("row", F.get(names, "rule").alias("n"), "a", (F.col("a") + F.col("piece.match")).cast("int").alias("b")).select("row", "n.*", "a", "b")
    # runs of overlapping places; what contains a place lies in its run
    along = Window.partitionBy("row").orderBy("a", F.desc("b"))
    seen = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    placed = places.withColumn("new", F.when(F.col("a") < seen, 0).otherwise(1)).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = placed.groupBy("row", "run").agg(F.collect_list(F.struct("label", "rank", "a", "b")).alias("places"))
    longer = lambda x, y: (y["a"] <= x["a"]) & (x["b"] <= y["b"]) & ((y["rank"] > x["rank"]) | (y["rank"] == x["rank"]) & (y["b"] - y["a"] > x["b"] - x["a"]))
    left = runs.select("row", F.explode(F.filter("places", lambda x: ~F.exists("places", lambda y: longer(x, y)))).alias("x"))
    found = left.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("x.a", "x.b", "x.label", "x.rank"))).alias("found"))
    joined = rows.drop("matches").join(found, "row", "left")
    detections = F.coalesce(F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["rank"].alias("rank"), x["a"].alias("a"), x["b"].alias("b"))), F.array().cast("array<struct<label:string,rank:int,a:int,b:int>>"))
    joined = joined.withColumn("detections", detections)
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        (1 - F.pow(F.lit(2.0), -F.size("detections"))).alias("score"),
        "detections",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(base.table(spark, sf_dir, "documents")).drop("detections")
