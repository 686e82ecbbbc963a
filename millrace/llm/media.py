"""Media columns: payloads kept as 8-bit grey PNG images in a binary column, read back and described.

The writer filters each row by the kind whose samples have the least sum of sizes, and makes IHDR, IDAT (zlib) and IEND
chunks with their CRCs; the reader tests the signature, every chunk's CRC and the zlib checksum, then undoes the five
row filters in numpy: along the diagonals of all images of a batch at once, since a sample needs its left, upper and
corner neighbour.  The feature is a 64-bit hash of the low frequencies of a cosine transform of the image, scaled to
GRID x GRID.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

WIDTH, GRID, LOW = 64, 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filtered(rows: np.ndarray, kind: int | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples under PNG filters (0 none, 1 left, 2 up, 3 mean, 4 Paeth), one byte a sample, and each row's kind.

    ``first``: which rows begin an image (else the first alone).  Without ``kind`` a row takes the one whose signed samples
    have the least sum of sizes; ties the lower kind.
    """
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    if first is not None:
        up[first] = 0
    corner[:, 1:] = up[:, :-1]
    makers = (lambda: x, lambda: x - left, lambda: x - up, lambda: x - ((left + up) >> 1), lambda: x - _paeth(left, up, corner))
    if kind is not None:
        return makers[kind]().astype(np.uint8), np.full(len(x), kind, np.uint8)
    all_ = np.stack([make().astype(np.uint8) for make in makers])
    kinds = abs(all_.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return all_[kinds, np.arange(len(x))], kinds.astype(np.uint8)


def unfiltered(data: np.ndarray, kinds: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Undoes ``filtered``: step by step along the diagonals, on which samples don't need each other, of all images."""
    if kinds.max(initial=0) > 4:
        raise ValueError(f"no PNG filter {kinds.max()}")
    if not kinds.any():
        return data.copy()
    n, width = data.shape
    begins = np.zeros(n, bool) if first is None else first.copy()
    begins[0] = True
    row = np.arange(n) - np.flatnonzero(begins)[np.cumsum(begins) - 1]  # within its image
    order = np.argsort(row, kind="stable")
    row = row[order]
    steps = np.arange(int(row[-1]) + width)
    lows, highs = np.searchsorted(row, steps - width + 1), np.searchsorted(row, steps, "right")
    line = width + 1  # a column of zeros on the left; the last row is zeros too
    out = np.zeros((n + 1) * line, np.int16)
    place, above = order * line, np.where(row == 0, n, order - 1) * line
    source, kind, flat = order * width, kinds[order], data.ravel()
    for t, lo, hi in zip(steps, lows, highs):
        at = t - row[lo:hi]
        here, over, k = place[lo:hi] + at, above[lo:hi] + at, kind[lo:hi]
        a, b, c = out[here], out[over + 1], out[over]
        pred = np.choose(k, (0, a, b, (a + b) >> 1, _paeth(a, b, c)))
        out[here + 1] = (flat[source[lo:hi] + at] + pred) & 255
    return out.reshape(n + 1, line)[:n, 1:].astype(np.uint8)


def write_pngs(payloads: list[bytes], width: int = WIDTH, kind: int | None = None, level: int = 6) -> list[bytes]:
    """Each payload (a positive multiple of ``width`` bytes) as the samples of an image."""
    if not payloads:
        return []
    heights = np.array([len(p) // width for p in payloads])
    starts = np.concatenate([[0], np.cumsum(heights)])
    first = np.zeros(starts[-1], bool)
    first[starts[:-1]] = True
    lines = np.empty((starts[-1], width + 1), np.uint8)
    lines[:, 1:], lines[:, 0] = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width), kind, first)
    out = []
    for i, j in zip(starts, starts[1:]):
        head = struct.pack(">IIBBBBB", width, j - i, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines[i:j].tobytes(), level)) + _chunk(b"IEND", b""))
    return out


def write_png(payload: bytes, width: int = WIDTH, kind: int | None = None, level: int = 6) -> bytes:
    return write_pngs([payload], width, kind, level)[0]


def _lines(media: bytes) -> np.ndarray:
    """The filtered rows, each with its kind before it."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if len(media) < at + 12:
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(body) != n or len(crc) != 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("length of IHDR")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
        raise ValueError("not an 8-bit grey image without interlace")
    size, stream = head[1] * (head[0] + 1), zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(data), size + 1)
        while len(raw) <= size and not stream.eof and stream.unconsumed_tail:
            raw += stream.decompress(stream.unconsumed_tail, size + 1 - len(raw))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size or not stream.eof:
        raise ValueError("sample count")
    return np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1)


def read_pngs(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each image; ValueError for a wrong signature, checksum, filter or shape."""
    lines = [_lines(m) for m in media]
    out: list[np.ndarray | None] = [None] * len(lines)
    for width in {x.shape[1] for x in lines}:
        own = [i for i, x in enumerate(lines) if x.shape[1] == width]
        starts = np.cumsum([0, *(len(lines[i]) for i in own)])
        first = np.zeros(starts[-1], bool)
        first[starts[:-1]] = True
        rows = np.concatenate([lines[i] for i in own])
        samples = unfiltered(rows[:, 1:], rows[:, 0], first)
        for i, a, b in zip(own, starts, starts[1:]):
            out[i] = samples[a:b]
    return out


def read_png(media: bytes) -> np.ndarray:
    return read_pngs([media])[0]


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_LOW = _cosines(GRID, LOW)


def _resized(image: np.ndarray) -> np.ndarray:
    """Means over a GRID x GRID partition; a side shorter than GRID has its samples repeated."""
    for axis in (0, 1):
        n = image.shape[axis]
        cuts = np.arange(GRID) * n // GRID
        if n >= GRID:
            sums = np.add.reduceat(image, cuts, axis=axis, dtype=np.float64)
            counts = np.diff(np.append(cuts, n))
            image = sums / (counts[:, None] if axis == 0 else counts)
        else:
            image = np.take(image, cuts, axis=axis)
    return image.astype(np.float64)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: a bit for each of LOW x LOW low frequencies, set above the median of those but the first."""
    low = np.round(_LOW @ _resized(image) @ _LOW.T, 6).ravel()
    return f"{int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), 'big'):016x}"


def store(docs: DataFrame, level: int = 6, kind: int | None = None) -> DataFrame:
    """doc_id, n_bytes, media (binary) for each row of ``docs`` (doc_id, text; others are ignored).

    A null text is empty; the payload is the text's bytes and bytes 0 up to a positive multiple of WIDTH.  ``kind``: the
    filter of all rows (else the best of each).  Equal texts give equal media, whatever rows stand beside them.
    """

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                media = write_pngs([x + b"\0" * (-len(x) % WIDTH if x else WIDTH) for x in raw], kind=kind, level=level)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    base.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame, column: str = "media") -> DataFrame:
    """Reads ``column`` back; adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, drops ``column``.

    Null media gives nulls.  Media that fail a checksum raise ValueError.
    """
    keep = [c for c in stored.columns if c != column]
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = T.StructType([*stored.select(*keep).schema.fields, *T._parse_datatype_string(added).fields])
    names = [f.name for f in schema.fields]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(media: bytes | None, image: np.ndarray | None) -> tuple:
        if media is None:
            return (None,) * 6
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                media = part.column(part.schema.get_field_index(column)).to_pylist()
                images = iter(read_pngs([m for m in media if m is not None]))
                cols = zip(*[row(m, None if m is None else next(images)) for m in media])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    base.small_batches(stored.sparkSession)
    return stored.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(base.table(spark, sf_dir, "documents")))
