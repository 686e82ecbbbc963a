"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of one document.  Hashing every window of a corpus is what this avoids:
only runs of ANCHOR words at positions whose remainder modulo PERIOD is in COVER are hashed first.  COVER is a
difference cover (every difference modulo PERIOD is one between two of its members), so for any two places i and j
there is a shift below PERIOD that brings both onto cover positions: two equal windows always hold an equal anchor
at the same shift, since WINDOW = PERIOD - 1 + ANCHOR.  Anchors that occur once in the corpus end there; those that
recur are extended to the windows around them, and only these windows are compared, by least document id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, exchange

PERIOD, COVER = 7, (0, 1, 3)
LAST = np.iinfo(np.int64).max
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _ids(t: pa.Table) -> np.ndarray:
    return exchange.column(t, "doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _windows_at(hit: np.ndarray, n_words: int) -> np.ndarray:
    """Of all starts, those of windows that hold an anchor of ``hit``: up to PERIOD - 1 words before it."""
    mark = np.zeros(n_words + 1, np.int64)
    np.add.at(mark, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(mark, hit + 1, -1)
    return np.cumsum(mark)[:n_words] > 0


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Removes the words of windows that also start in a document with a smaller doc_id.

    In: doc_id, text (others are ignored).  Out, a row for each row of ``docs``: doc_id, n_words, n_removed, kept_text
    (the kept words joined by one space).  Words are runs of bytes other than ASCII white space.  Windows are judged on
    the input.  Null text: no words.  Null doc_id: counts as larger than any id.  Rows that repeat a doc_id are parts of
    one document in so far as neither removes words of the other; fewer words than a window: all kept.  Hashes have 64 bits.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    anchor, total = window - PERIOD + 1, base.text_bytes(docs)
    chunks = exchange.chunked(docs, total)
    n_anchor, n_window = exchange.buckets(total // 12), exchange.buckets(total // 48)

    def anchors(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, place, after = base.places(offsets)
        at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (after >= anchor - 1))
        return at, base.gram_hashes(words, anchor)[at]

    @base.tidy
    def send_anchors(key: tuple, t: pa.Table) -> pa.Table:
        words, offsets = base.split_words(exchange.column(t, "text"))
        return exchange.send(key[0].as_py(), anchors(base.hash_words(words), offsets)[1], n_anchor)

    @base.tidy
    def send_windows(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        (shared, _), none = exchange.told(replies), np.empty(0, np.uint64)
        if not len(shared):
            return exchange.send(key[0].as_py(), none, n_window, none.astype(np.int64))
        words, offsets = base.split_words(exchange.column(t, "text"))
        words = base.hash_words(words)
        text, _, after = base.places(offsets)
        at, h = anchors(words, offsets)
        near = np.flatnonzero(_windows_at(at[exchange.found(h, shared)], len(words)) & (after >= window - 1))
        grams = base.gram_hashes(words, window)[near] if len(near) else none
        return exchange.send(key[0].as_py(), grams, n_window, _ids(t)[text[near]])

    @base.tidy
    def cut(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        known, least = exchange.told(replies)
        words, offsets = base.split_words(exchange.column(t, "text"))
        keep = np.ones(len(words), bool)
        if len(known) and len(words) >= window:
            text, _, after = base.places(offsets)
            at = np.flatnonzero(after >= window - 1)
            grams = base.gram_hashes(base.hash_words(words), window)[at]
            same = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            gone = at[(known[same] == grams) & (least[same] < _ids(t)[text[at]])]
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, gone, 1)
            np.add.at(mark, gone + window, -1)
            keep = np.cumsum(mark)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(keep)])[offsets]
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep))), " ")
        n = np.diff(offsets)
        return pa.Table.from_arrays([exchange.column(t, "doc_id"), pa.array(n), pa.array(n - np.diff(left)), kept], schema=_OUT)

    shared = exchange.tell(chunks.groupBy("chunk").applyInArrow(send_anchors, exchange.SENT))
    windows = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, exchange.SENT)
    least = exchange.tell(windows, least=True)
    return chunks.groupBy("chunk").cogroup(least.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), least AS (
    SELECT g, min(doc_id) AS d FROM win GROUP BY g
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE d < doc_id
), dropped AS (
    SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
    SELECT w.doc_id, len(ws) AS n, [ws[p] FOR p IN range(1, len(ws) + 1) IF ps IS NULL OR NOT list_contains(ps, p)] AS k
    FROM w LEFT JOIN dropped ON w.doc_id = dropped.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""
