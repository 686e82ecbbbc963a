import os
import sys

import corpus_pipeline
from millrace.llm import base, bpe, decontaminate, jaccard_join, language_id, line_dedup

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_documents import brute_components, brute_language, brute_line_dedup, brute_matches  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_the_operators(spark):
    docs = base.save(base.table(spark, SF, "documents"))
    for name, stage in corpus_pipeline.STAGES:
        out = base.save(stage(spark, docs, SF))
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        before = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert out.columns == docs.columns == list(corpus_pipeline.COLUMNS)
            named = language_id.predict(docs, language_id.learn(docs)).collect()
            assert ids == sorted(r.doc_id for r in named if r.lang_pred != "und")
        elif name == "line_dedup":
            kept = {r.doc_id: r for r in line_dedup.drop_recurring(docs).collect()}
            assert ids == sorted(d for d, r in kept.items() if not r.n_removed or r.kept_text.strip())
            assert all(r.text == (kept[r.doc_id].kept_text if kept[r.doc_id].n_removed else before[r.doc_id].text) for r in out.collect())
        elif name == "jaccard_join":
            assert ids == sorted(r.doc_id for r in jaccard_join.jaccard_components(docs).collect() if r.doc_id == r.component_id)
        elif name == "decontamination":
            hit = {r.doc_id for r in decontaminate.matches(docs, base.table(spark, SF, "benchmark")).collect()}
            assert ids == sorted(set(before) - hit)
        else:
            tokens = bpe.load_tokens(bpe.public_vocabulary()[0])
            rows = out.collect()
            assert ids == sorted(before) and all(b"".join(tokens[i] for i in r.ids) == before[r.doc_id].text.encode() for r in rows)
        docs = out
    assert docs.count() > 0


def test_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some words in a line", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        current = table
        for _, stage in corpus_pipeline.STAGES:
            current = base.save(stage(spark, current, SF))
        assert [r.doc_id for r in current.collect() if r.doc_id != 2] == []


def test_run_against_brute_force(spark):
    """Five stages in plain Python, over whole tables, beside run()."""
    import tiktoken

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    named = brute_language([r[:2] for r in docs], [r[1:] for r in docs])
    text = {d: t for d, t, _ in docs if named[d][0] != "und"}
    kept = dict(brute_line_dedup(list(text.items())))
    text = {d: kept[d] for d, t in text.items() if kept[d] == t or kept[d].strip(" ")}
    best, _ = brute_components(list(text.items()))
    text = {d: t for d, t in text.items() if best[d] == d}
    hit = {d for d, _ in brute_matches(list(text.items()), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])}
    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = {d: (named[d][0], enc.encode_ordinary(t)) for d, t in text.items() if d not in hit}
    assert {r.doc_id: (r.lang, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert hit and len(want) < len(text) < len(docs)
