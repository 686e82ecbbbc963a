"""Byte-level BPE encoding and decoding with a given rank file.

A text longer than CHUNK characters is pre-tokenised in chunks that overlap by OVERLAP characters, each from its own
start as if it began there.  A match that ends before its chunk does is the match in the whole text, and the pattern
never looks back, so where two neighbouring chunks both have a boundary at one place, all later boundaries of the
second are those of the whole text: the two are stitched there.  Where they share none (one run without a boundary,
longer than the overlap), the stitched part is carried on from its last boundary instead.  Then the pieces are encoded.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces whose ids a worker keeps; longer pieces are never kept.
PIECE_CACHE, PIECE_LENGTH = 300_000, 40


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=4)
def load_tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def boundaries(pattern: regex.Pattern, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ends of all matches in ``text``, found chunk by chunk."""
    n, ends, start = len(text), [], 0
    while True:
        stop = min(n, start + size)
        own = [m.end() for m in pattern.finditer(text, start, stop)]
        if start:
            places, k = {start, *own}, len(ends)
            while k and ends[k - 1] >= start and ends[k - 1] not in places:
                k -= 1
            if k and ends[k - 1] >= start:
                del ends[k:]
                own = [b for b in own if b > ends[-1]]
            else:
                own = [m.end() for m in pattern.finditer(text, ends[-1] if ends else 0, stop)]
        ends += own if stop == n else [b for b in own if b < stop]
        if stop == n:
            return ends
        start = stop - overlap


def split(pattern: regex.Pattern, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    if len(text) <= size:
        return pattern.findall(text)
    ends = boundaries(pattern, text, size, overlap)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: always the leftmost pair of least rank is joined."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, mid, last = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != last:
            continue
        end[i], alive[j], after[i] = last, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return tuple(out)


class PieceIds(dict):
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = merge(piece.encode(), self.ranks)
        if len(piece) <= PIECE_LENGTH:
            if len(self) >= PIECE_CACHE:
                self.clear()
            self[piece] = ids
        return ids


def text_of(ids: np.ndarray, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", into: str = "ids", size: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None) -> DataFrame:
    """Adds ``into`` (array of int) to all columns of ``docs``; it replaces a column of that name.

    With ``decoded``, a column of that name (binary) holds the bytes that ``decode`` gives for the ids, made in the same
    pass: one worker a task instead of two.

    No special tokens: their strings are ordinary text.  A null or empty text has no ids.  Every row is encoded by
    itself, so ties, copies and repeated rows need nothing.
    """
    keep = [c for c in docs.columns if c not in (into, decoded)]
    back = [T.StructField(decoded, T.BinaryType(), False)] if decoded else []
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(into, T.ArrayType(T.IntegerType(), False), False), *back])

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pat = PieceIds(load_ranks(path)), regex.compile(pattern)
        tokens = load_tokens(path) if decoded else {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flat, offsets = [], [0]
                for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                    ids = np.fromiter(chain.from_iterable(map(known.__getitem__, split(pat, text, size, overlap))), np.int32) if text else np.empty(0, np.int32)
                    flat.append(ids)
                    offsets.append(offsets[-1] + len(ids))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat or [np.empty(0, np.int32)])))
                made = {into: ids}
                if decoded:
                    made[decoded] = pa.array([text_of(x, tokens) for x in flat], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *made.values()], names=[*keep, *made])

    base.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into`` (binary): the tokens' bytes in order.  Null ids give null; an id without a token is an error."""
    keep = [c for c in rows.columns if c != into]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(into, T.BinaryType())])

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = []
                for ids in batch.column(batch.schema.get_field_index(column)):
                    out.append(text_of(ids.values.to_numpy(), tokens) if ids.is_valid else None)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(out, pa.binary())], names=[*keep, into])

    base.small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    ids = encode(base.table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    return decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
