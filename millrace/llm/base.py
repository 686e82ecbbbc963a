"""Session helpers and the numpy word kernels shared by the operators."""

from __future__ import annotations

import ctypes
from functools import cache
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Bytes of words hashed at once: the length of the power tables.
SPAN = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    return storage.materialize(df, "zstd", by)


#: Bytes of an Arrow batch that Spark sends to Python, where the session says nothing.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't add up; a setting other than the default stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns freed memory of this worker to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(f):
    """A function of Arrow tables or batches that gives memory back when it is done; as many arguments as ``f``, which Spark counts."""

    def table(*args):
        try:
            return f(*args)
        finally:
            give_back()

    def batches(it):
        try:
            yield from f(it)
        finally:
            give_back()

    if isgeneratorfunction(f):
        return batches
    return {1: lambda t: table(t), 2: lambda k, t: table(k, t), 3: lambda k, t, u: table(k, t, u)}[f.__code__.co_argcount]


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Odd multipliers, one for each place in a run of words; from a linear congruential rule.
COEFS = [0x9E3779B97F4A7C15]
for _ in range(63):
    COEFS.append((COEFS[-1] * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, one for each start; empty with fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += words[j : j + m] * np.uint64(COEFS[j])
    return mix(out)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd number and of its inverse modulo 2**64."""
    odd = 0x9E3779B97F4A7C15
    up, down = np.full(SPAN + 1, odd, np.uint64), np.full(SPAN + 1, pow(odd, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)), np.cumprod(up), np.cumprod(down)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of bytes other than ASCII white space) of an array of strings, and where each string's begin; null: none."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, offsets = lists.flatten(), np.asarray(lists.offsets)
    some = pc.greater(pc.binary_length(words), 0)
    counts = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), counts[offsets - offsets[0]]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes by prefix sums over SPAN bytes at once, then mixed."""
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    byte, up, down = _tables()
    out, i = np.empty(len(words), np.uint64), 0
    while i < len(words):
        j = int(np.searchsorted(offsets, offsets[i] + SPAN, "right")) - 1
        if j == i:  # a word of more than SPAN bytes
            out[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
            i += 1
            continue
        part = data[offsets[i] : offsets[j]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[part] * up[: len(part)])])
        at = offsets[i : j + 1] - offsets[i]
        out[i:j] = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64)
        i = j
    return mix(out)


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of consecutive texts: its text's number, its place in that text, and how many words follow it there."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(offsets[-1]) - offsets[text]
    return text, at, n[text] - at - 1
