"""A two-hop exchange of word-run hashes: which hashes occur elsewhere, told back to those who asked.

Documents are dealt into chunks of bounded text.  A chunk sends every distinct hash of its own once, packed by
bucket of the hash range (so a run that a third of all rows hold costs one entry a chunk, not one a row); the
bucket's task compares the entries of all chunks and sends each chunk those of its hashes that matter.  Both hops
carry packed arrays, no row per hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Text bytes of a chunk, and hashes of a bucket, about.
CHUNK_BYTES, BUCKET_HASHES = 3 << 20, 1 << 20
SENT = "bucket int, chunk long, once binary, often binary, least binary"
TOLD = "chunk long, hashes binary, least binary"
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("once", pa.binary()), ("often", pa.binary()), ("least", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int64()), ("hashes", pa.binary()), ("least", pa.binary())])


def chunked(docs: DataFrame, total_bytes: int) -> DataFrame:
    """doc_id, text and the chunk of each row, dealt by both: a hot text under many ids spreads, and so does a hot id with many texts."""
    n = max(1, -(-total_bytes // CHUNK_BYTES))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk")).repartition("chunk")


def buckets(n_hashes: int) -> int:
    return max(1, -(-n_hashes // BUCKET_HASHES))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets of equal ranges of the upper 32 bits; sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def send(chunk: int, hashes: np.ndarray, n_buckets: int, ids: np.ndarray | None = None) -> pa.Table:
    """The rows of one chunk.  ``ids``: with them the least id of each hash is sent too, and all go into ``once``."""
    rows = []
    if ids is None:
        u, c = np.unique(hashes, return_counts=True)
        least = None
    else:
        order = np.lexsort((ids, hashes))
        u, first = np.unique(hashes[order], return_index=True)
        c, least = np.ones(len(u), np.int64), ids[order][first]
    buckets = _bucket(u, n_buckets)
    cuts = np.flatnonzero(np.diff(buckets, prepend=np.uint64(n_buckets)))  # buckets that have hashes, at most as many as hashes
    for i, j in zip(cuts, [*cuts[1:], len(u)]):
        part, single = u[i:j], c[i:j] == 1
        rows.append((int(buckets[i]), chunk, part[single].tobytes(), part[~single].tobytes(), None if least is None else least[i:j].tobytes()))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, _SENT.types)], schema=_SENT)


def _uint64(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.uint64)


@base.tidy
def _tell_shared(t: pa.Table) -> pa.Table:
    once, often = [_uint64(x) for x in t["once"].to_pylist()], [_uint64(x) for x in t["often"].to_pylist()]
    u, c = np.unique(np.concatenate(once + often), return_counts=True)
    shared = np.union1d(u[c > 1], np.concatenate(often))
    out = []
    for chunk, a, b in zip(t["chunk"].to_pylist(), once, often):
        mine = np.union1d(a[found(a, shared)], b)
        if len(mine):
            out.append((chunk, mine.tobytes(), None))
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 3, _TOLD.types)], schema=_TOLD)


@base.tidy
def _tell_least(t: pa.Table) -> pa.Table:
    once = [_uint64(x) for x in t["once"].to_pylist()]
    ids = [np.frombuffer(x or b"", np.int64) for x in t["least"].to_pylist()]
    h, i = np.concatenate(once), np.concatenate(ids)
    order = np.lexsort((i, h))
    u, first = np.unique(h[order], return_index=True)
    least = i[order][first]
    out = []
    for chunk, a in zip(t["chunk"].to_pylist(), once):
        if len(a):
            out.append((chunk, a.tobytes(), least[np.searchsorted(u, a)].tobytes()))
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 3, _TOLD.types)], schema=_TOLD)


def tell(sent: DataFrame, least: bool = False) -> DataFrame:
    """For each chunk the hashes it shares (``least``: all it sent, with the least id anywhere)."""
    return sent.groupBy("bucket").applyInArrow(_tell_least if least else _tell_shared, TOLD)


def told(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of a chunk's replies and, where sent, their least ids."""
    h = np.concatenate([_uint64(x) for x in t["hashes"].to_pylist()] or [np.empty(0, np.uint64)])
    i = np.concatenate([np.frombuffer(x or b"", np.int64) for x in t["least"].to_pylist()] or [np.empty(0, np.int64)])
    order = np.argsort(h)
    return h[order], i[order] if len(i) else i


def column(t: pa.Table, name: str) -> pa.Array:
    """A column of a chunk as one array."""
    c = t[name]
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() if c.num_chunks else pa.array([], c.type)


def found(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each hash, whether the sorted ``known`` has it."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
