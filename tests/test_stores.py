import os
import zipfile

import pytest

from millrace.operators import graph, numeric, ranges, sequences
from millrace.plans.relations import Traversal
from millrace.sources import formats
from millrace.streaming import events
from millrace.table import PlanError, Table


def test_reach_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.node, r.depth) for r in graph.reach(spark.createDataFrame([("a",)], "seed string"), edges).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_traversal_loops_and_errors(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 0), (9, 9)], "id int, parent int")
    t = Traversal(spark, {"tree": tree, "two": [tree, tree]})
    got = t.run("a=find.tree(id==1); jump!.a(a.parent, 0); print(a.id);")
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]
    assert t.run("a=foreach.two(''); print(a.id);").count() == 8
    assert t.run("a=foreach.two(''); unique!.u(a.id); print(a.id);").count() == 0
    assert t.run("a=foreach(4, 5); print(a.value);").count() == 2
    for bad in ("a=find.none(x==1); print(a.x);", "a=fly.tree(id==1);", "a=find.tree(id==1);", "a=find.tree(id==$p); print(a.id);"):
        with pytest.raises(PlanError):
            t.run(bad)


def test_range_join_finds_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 25), (2, 30, 30), (3, 9, 3), (4, None, 5)], "a int, s int, e int")
    b = spark.createDataFrame([(7, 5, 40), (8, 26, 29)], "b int, s2 int, e2 int")
    from pyspark.sql import functions as F

    got = ranges.range_join(a.withColumn("k", F.lit(0)), b.withColumn("k", F.lit(0)), ["k"], ("s", "e"), ("s2", "e2"), 10)
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 7), (2, 7)]


def test_sequences(spark):
    reads = spark.createDataFrame([("r1", "ACGTN", [30, 30, 30, 2, 2]), ("r2", "AAAAA", [30] * 5), ("r3", "", [])], "id string, seq string, qual array<int>")
    assert {r.base: r.n for r in sequences.base_counts(reads).collect()} == {"A": 6, "C": 1, "G": 1, "T": 1, "N": 1}
    assert [r.seq for r in sequences.filter_reads(reads, min_length=1, trim_quality=20).orderBy("id").collect()] == ["ACG", "AAAAA"]
    assert [r.id for r in sequences.filter_reads(reads, min_length=1, min_complexity=500).collect()] == ["r1"]
    assert sequences.kmers(reads, 3).count() == 6
    assert sequences.codons()["ATG"] == "M" and len(sequences.codons()) == 64
    hits = spark.createDataFrame([("s", 1, "+", "ACaG"), ("s", 2, "-", "C-T")], "sub string, sub_start int, strand string, seq string")
    pile = {r.pos: r for r in sequences.pileup(hits).collect()}
    assert pile[2].count_c == 2 and pile[2].count_ins == 1 and pile[3].count_del == 1 and pile[4].count_t == 1
    assert sequences.consensus(sequences.pileup(hits)).first().consensus == "ACGT"
    pairs = spark.createDataFrame([("ACGTACGT", "TTACGTACGTTT", 2)], "query string, subject string, diagonal long")
    r = sequences.smith_waterman(pairs).first()
    assert (r.score, r.s_start, r.s_end, r.q_start, r.q_end) == (40, 2, 10, 0, 8)
    sim = sequences.simulate_reads(spark.createDataFrame([("g", "ACGT" * 10)], "id string, seq string"), 5, 8, 0.0)
    assert all(r.seq in "ACGT" * 10 and len(r.seq) == 8 for r in sim.collect())


def test_distances_and_peaks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(*[numeric.distance(F.col("a"), F.col("b"), k).alias(k) for k in ("euclidean", "manhattan", "maximum", "canberra", "cosine", "pnorm", "pearson")]).first()
    assert (got.euclidean, got.manhattan, got.maximum, got.canberra, got.cosine) == (5, 7, 4, 2, 1) and got.pearson == pytest.approx(2)
    series = spark.createDataFrame([(0, i, 100.0 if i == 8 else float(i % 2)) for i in range(12)], "k int, i int, v double")
    assert [r.i for r in numeric.peaks(series, ["k"], "i", "v").where("peak = 1").collect()] == [8]


def test_formats_round_trip(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    t = formats.read_csv(spark, put("a.csv", 'x,y,z\n1,"a,b",2020-01-01\n2,,\n'))
    assert t.dtypes[0][1] == "int" and t.first().y == "a,b"
    assert formats.read_csv(spark, str(tmp_path / "a.csv"), parse_start=1, parse_count=1).first().x == 2
    assert formats.read_csv(spark, put("a.tsv", "x\ty\n1\t2\n")).columns == ["x", "y"]
    v = formats.read_vcf(spark, put("a.vcf", "##h\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc1\t7\t.\tA\tG\t.\tPASS\tAF=0.5;DP=9\n")).first()
    assert v.POS == 7 and v.QUAL is None and v.INFO["DP"] == "9"
    g = formats.read_gtf(spark, put("a.gtf", 'c\ts\texon\t3\t9\t.\t+\t.\tgene_id "g1"; note "n"\n')).first()
    assert g.start == 3 and g.attributes["gene_id"] == "g1"
    fa = formats.read_fasta(spark, put("a.fa", ">s1 first one\nACG\nT\n>s2\nGG\n"))
    assert {(r.id, r.description, r.seq) for r in fa.collect()} == {("s1", "first one", "ACGT"), ("s2", "", "GG")}
    fq = formats.read_fastq(spark, put("a.fq", "@r1 x\nAC\n+\nI!\n")).collect()
    assert (fq[0].id, fq[0].seq, fq[0].qual) == ("r1", "AC", [40, 0])
    sam = formats.read_sam(spark, put("a.sam", "@HD\tVN:1\nr1\t0\tc\t5\t60\t2S3M1I2D\t*\t0\t0\tACGTAC\t*\tNM:i:1\n"))
    assert sam.first().tags == ["NM:i:1"] and sam.select(formats.cigar_length(sam["cigar"])).first()[0] == 5
    gb = formats.read_genbank(spark, put("a.gb", 'LOCUS       AB1 10 bp\nDEFINITION  a thing\nFEATURES             Location/Qualifiers\n     gene            1..5\n                     /gene="g"\nORIGIN\n        1 acgta cgtac\n//\n')).first()
    assert gb.locus == "AB1" and gb.seq == "ACGTACGTAC" and gb.features[0]["qualifiers"]["gene"] == "g"
    nodes, names = formats.read_taxonomy(spark, put("nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tkingdom\t|\n"), put("names.dmp", "2\t|\tB\t|\tscientific name\t|\n"))
    assert nodes.count() == 2 and names.first().name == "B"
    assert formats.read_bed(spark, put("a.bed", "c\t1\t5\tn\t0\t+\n")).first().end == 5
    assert formats.read_blast(spark, put("a.bl", "q\ts\t99.1\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\n")).first().bits == 50
    formats.write_lines(formats.fasta_lines(fa, 3), str(tmp_path / "out"))
    assert {(r.id, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "out")).collect()} == {("s1", "ACGT"), ("s2", "GG")}
    table = Table.of(t)
    formats.write_table(table, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 2 and '"int"' in formats.metadata(table)
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>hi</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>4.5</v></c></row></sheetData></worksheet>')
    assert formats.read_xlsx(spark, str(tmp_path / "a.xlsx")).first().cells == {"A": "hi", "B": "4.5"}
    assert formats.read_tables(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "a.tsv")]).count() == 2
    import sqlite3

    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t as select 1 as x")
    assert formats.read_sqlite(spark, str(tmp_path / "d.db"), "select x from t", "x long").first().x == 1


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "click", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double")
    out = events.run_once(events.trend(stream, "10 minutes", late="1 minute"), "trend_out", str(tmp_path / "c1"), "append")
    assert {r.n for r in out.collect()} == {10}
    state = events.run_once(events.running(stream), "state_out", str(tmp_path / "c2"), "update")
    assert {(r.user_id, r.n) for r in state.collect()} == {(0, 10), (1, 10)}
    assert events.sessions(df, "5 minutes").count() == 2
    assert os.path.isdir(tmp_path / "c1")


def test_runs_join_over_bins(spark):
    at = [1, 2, 3, 9, 10, 11, 12, 21, 40, 41]
    df = spark.createDataFrame([("s", p, p * 1.0) for p in at] + [("t", 5, None)], "sub string, pos long, v double")
    from pyspark.sql import functions as F

    rows = lambda width: sorted(tuple(r) for r in ranges.islands(df, ["sub"], "pos", 2, F.col("v"), width).collect())
    assert rows(10) == rows(1 << 16) == [("s", 1, 3, 3, 2.0, None), ("s", 9, 12, 4, 10.5, 5), ("s", 21, 21, 1, 21.0, 8), ("s", 40, 41, 2, 40.5, 18), ("t", 5, 5, 1, None, None)]


def test_gap_windows_against_a_plain_loop(spark):
    import random

    rnd, window, limit = random.Random(3), 6, 2
    cover = {s: [rnd.choice([0, 0, 5]) if (i // 25) % 2 else rnd.choice([1, 2, 3, 4]) for i in range(n)] for s, n in (("a", 130), ("b", 61), ("c", 4))}
    want = []
    for s, cells in cover.items():
        on = [sum(cells[max(0, i - window + 1) : i + 1]) > window * limit for i in range(len(cells))]
        starts = [i for i in range(len(cells)) if i == 0 or (i >= window and on[i] != on[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(cells)]):
            total = sum(cells[a:b])
            covered = total > max(b - a, window) * limit
            want.append((s, a + 1, b, b - a, total, covered, max(total // (b - a), 1) if covered else total // (b - a), b - a >= 10))
    profile = spark.createDataFrame([(s, i + 1, c) for s, cells in cover.items() for i, c in enumerate(cells) if c], "sub string, pos long, count_total long")
    lengths = spark.createDataFrame([(s, len(c)) for s, c in cover.items()] + [("none", 0)], "sub string, length long")
    for width in (7, 40, 1 << 16):
        got = sequences.gap_windows(profile, lengths, window, limit, 10, width)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        sequences.gap_windows(profile, lengths, 30, 1, 10, 30)


def test_codons_of_spliced_and_reverse_ranges(spark):
    exons = sequences.spliced(spark.createDataFrame([("s", "f", "+", 10, 13), ("s", "f", "+", 20, 24), ("s", "r", "-", 40, 43), ("s", "r", "-", 30, 34)], "sub string, id string, strand string, start int, end int"))
    assert {(r.id, r.start): r.cds_start for r in exons.collect()} == {("f", 10): 0, ("f", 20): 4, ("r", 40): 0, ("r", 30): 4}
    from pyspark.sql import functions as F

    frames = exons.withColumn("cds", F.lit("ATGGCCTAA"))
    calls = spark.createDataFrame([("s", 13, "T"), ("s", 20, "A"), ("s", 40, "A"), ("s", 34, "T")], "sub string, pos int, snp string")
    got = {(r.id, r.pos): (r.aa_pos, r.aa_ref, r.aa_sub) for r in sequences.codon_effect(calls, frames).collect()}
    assert got == {("f", 13): (2, "A", "S"), ("f", 20): (2, "A", "D"), ("r", 40): (2, "A", "S"), ("r", 34): (2, "A", "D")}


def test_key_join_and_search(spark):
    from pyspark.sql import functions as F

    from millrace.operators.keyed import key_join
    from millrace.plans.objects import object_search

    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "k int, x string")
    more = spark.createDataFrame([(1, 5, "z"), (1, 4, "q"), (3, 1, "w"), (None, 7, "m")], "k int, y int, x string")
    got = {tuple(r) for r in key_join(base, [more], "k").collect()}
    assert got == {(1, "z", 5), (2, None, None), (None, "m", 7)}
    objects = spark.createDataFrame([(1, None, None), (2, 5, None), (3, 5, 6), (4, 20, 30), (4, 20, 30)], "obj_id int, soft_expiration int, hard_expiration int")
    perms = spark.createDataFrame([(g, o) for g in (1, 2) for o in (1, 2, 3, 4)] + [(9, 4)], "group_id int, obj_id int")
    groups = spark.createDataFrame([(1,), (2,)], "group_id int")
    find = lambda **k: [r.obj_id for r in object_search(objects, perms, groups, now=F.lit(10), **k).collect()]
    assert (find(), find(expired=1), find(expired=2), find(expired=-1)) == ([4, 1], [2], [3], [4, 3, 2, 1])
    assert find(expired=-1, start=1, cnt=2) == [3, 2] and find(object_filter="obj_id < 4", expired=-1) == [3, 2, 1]
    with pytest.raises(PlanError):
        find(expired=5)


def test_json_functions(spark):
    from millrace.functions.expr import compile_formula

    def value(formula):
        return spark.range(1).select(compile_formula(formula).col.alias("v")).first()["v"]

    assert value("jsonprint([1,2])") == "[1,2]" and value('jsonprint("a\\"b")') in ('"a\\"b"', '"a\\\\\\"b"') and value("jsonprint(3)") == "3" and value("jsonprint(null)") == "null"
    assert value("jsonget('{\"a\":[1,{\"b\":\"x\"}]}', '$.a[1].b')") == "x" and value("jsonget('no', '$.a')") is None
    assert value("jsonlist('[1,\"b\",[2]]')") == ["1", "b", "[2]"] and value("jsondic('{\"a\":1}').a") == "1"


def test_pileup_places_insertions_after_the_last_position(spark):
    rows = [("s", 10, "+", "acACgtG-Tc"), ("s", 10, "-", ""), ("s", 10, "-", None)]
    got = {r.pos: (r.count_total, r.count_ins, r.count_del) for r in sequences.pileup(spark.createDataFrame(rows, "sub string, sub_start int, strand string, seq string")).collect()}
    assert got == {9: (0, 2, 0), 10: (1, 0, 0), 11: (1, 2, 0), 12: (1, 0, 0), 13: (0, 0, 1), 14: (1, 1, 0)}
