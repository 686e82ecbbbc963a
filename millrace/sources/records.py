"""Records of more than one line, whichever blocks of a file their lines fall into.

Spark's text reader deals a file out in blocks of lines.  Where a record begins depends on all lines before (is a quote
open? which of four lines is this?), but only through a state of a few values.  A first pass finds for each block where
each state leads, one small row a block; chained together these give each block the state it begins in.  A second pass
cuts all blocks into records side by side; the pieces of a record that crosses blocks are joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

SKIP, BEGINS, GOES_ON = 0, 1, 2
_PASSED = "file string, block long, state int, ends int, begun long, continued long, returns long"
_CUT = "file string, block long, k long, at long, text string, whole boolean"
_CUT_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])


class Quoted:
    """Delimited lines: a quote that begins a field opens it, a doubled one is a quote, the next single one closes it.

    Quotes elsewhere are letters.  States: 0 outside, 1 inside a quoted field.  Blank lines and comments between records
    are skipped.
    """

    states = 2

    def __init__(self, sep: str = ",", quote: str = '"', comment: str | None = None):
        self.sep, self.quote, self.comment = sep, quote, comment

    def after(self, line: str, inside: bool) -> bool:
        """Whether a field is open at the end of a line."""
        i = 0
        while True:
            if inside:
                i = line.find(self.quote, i)
                if i < 0:
                    return True
                if line.startswith(self.quote, i + 1):
                    i += 2
                    continue
                inside = False
            elif line.startswith(self.quote, i):
                inside, i = True, i + 1
                continue
            i = line.find(self.sep, i)
            if i < 0:
                return False
            i += len(self.sep)

    def kinds(self, lines: pa.Array, state: int) -> tuple[np.ndarray, int]:
        """What each line is (SKIP, BEGINS, GOES_ON), and the state after the last."""
        skip = pc.is_in(lines, pa.array(["", "\r"]))
        if self.comment:
            skip = pc.or_(skip, pc.starts_with(lines, self.comment))
        outside = np.where(skip.to_numpy(zero_copy_only=False), SKIP, BEGINS).astype(np.int8)
        out, at = outside.copy(), 0
        for i in np.flatnonzero(pc.match_substring(lines, self.quote).to_numpy(zero_copy_only=False)):
            if state:
                out[at : i + 1] = GOES_ON
            if state or outside[i] == BEGINS:
                state = int(self.after(lines[i].as_py(), bool(state)))
            at = i + 1
        if state:
            out[at:] = GOES_ON
        return out, state

    def open(self, state: int) -> bool:
        """Whether a record may go on in the next block."""
        return state == 1

    def returns(self, lines: pa.Array) -> int:
        """How many lines hold carriage returns inside quoted fields only, if each is a record: Spark would end a line there."""

        def inside(line: str) -> bool:
            state = False
            return all(state := self.after(part, state) for part in line.removesuffix("\r").split("\r")[:-1])

        held = pc.and_(pc.match_substring_regex(lines, "\r(?s:.)"), pc.match_substring(lines, self.quote))
        return sum(map(inside, lines.filter(held).to_pylist()))


class FourLines:
    """Records of four lines; the state is how many of them have passed.  Blank lines between records are skipped."""

    states = 4

    def kinds(self, lines: pa.Array, state: int) -> tuple[np.ndarray, int]:
        blank = pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        if not blank.any():
            return np.where((state + np.arange(len(lines))) % 4 == 0, BEGINS, GOES_ON).astype(np.int8), (state + len(lines)) % 4
        out = np.full(len(lines), GOES_ON, np.int8)
        for i, empty in enumerate(blank):
            if state == 0:
                out[i] = SKIP if empty else BEGINS
            state = (state + (out[i] != SKIP)) % 4
        return out, state

    def open(self, state: int) -> bool:
        return state != 0


class Headed:
    """Records that begin with a line of a certain start; what comes before the first is left out."""

    states = 1

    def __init__(self, start: str = ">"):
        self.start = start

    def kinds(self, lines: pa.Array, state: int) -> tuple[np.ndarray, int]:
        blank = pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        return np.where(blank, SKIP, np.where(pc.starts_with(lines, self.start).to_numpy(zero_copy_only=False), BEGINS, GOES_ON)).astype(np.int8), 0

    def open(self, state: int) -> bool:
        return True


def blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, value: lines in the order of their block, dealt out as Spark's text reader does."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Lines of one block at a time; a block may come in several parts."""
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(1).to_numpy()
        file = b.column(0).dictionary_encode()
        code = file.indices.to_numpy()
        new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])))
        for i, j in zip(new, [*new[1:], len(block)]):
            yield (file.dictionary[int(code[i])].as_py(), int(block[i])), b.column(2).slice(i, j - i)


def passed(lines: DataFrame, rule: Quoted | FourLines | Headed) -> DataFrame:
    """For each block and state it may begin in: the state it ends in, records begun, lines that continue one; and its lines with
    quoted carriage returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: tuple | None = None
        sums: list[list[int]] = []
        returns = 0

        def done() -> pa.RecordBatch:
            rows = [(*where, s, *x, returns) for s, x in enumerate(sums)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "block", "state", "ends", "begun", "continued", "returns"])

        for key, part in _runs(batches):
            if key != where:
                if where:
                    yield done()
                where, sums, returns = key, [[s, 0, 0] for s in range(rule.states)], 0
            returns += rule.returns(part) if isinstance(rule, Quoted) else 0
            for x in sums:
                kinds, x[0] = rule.kinds(part, x[0])
                x[1] += int((kinds == BEGINS).sum())
                x[2] += int((kinds == GOES_ON).sum())
        if where:
            yield done()

    return lines.mapInArrow(run, _PASSED)


def chained(rows: list) -> tuple[dict, int]:
    """By (file, block): the state a block begins in and the block that holds the start of the record it begins in; and how
    many lines continue a record anywhere."""
    by: dict = {}
    for r in rows:
        by.setdefault((r["file"], r["block"]), {})[r["state"]] = r
    out, file, state, owner, continued = {}, None, 0, None, 0
    for key in sorted(by):
        if key[0] != file:
            file, state, owner = key[0], 0, None
        out[key] = (state, owner)
        r = by[key][state]
        state, owner = r["ends"], key[1] if r["begun"] else owner
        continued += r["continued"]
    return out, continued


def cut(lines: DataFrame, rule: Quoted | FourLines | Headed, known: dict) -> DataFrame:
    """file, block, k, text: the records, in order of (file, block, k), each with its lines as they were."""
    begins = lines.sparkSession.sparkContext.broadcast(known)  # one entry a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, state, k, held = None, 0, -1, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CUT_ARROW)], schema=_CUT_ARROW)

        def rest(whole: bool) -> list[tuple]:
            """The record held so far; a block's first lines belong to a record of another block."""
            if not held:
                return []
            owner = begins.value[where][1] if k < 0 else where[1]
            return [] if owner is None else [(where[0], owner, None if k < 0 else k, where[1], "\n".join(held), whole and k >= 0)]

        for key, part in _runs(batches):
            if key != where:
                if where and (rows := rest(not rule.open(state))):
                    yield made(rows)
                where, state, k, held = key, begins.value[key][0], -1, []
            kinds, state = rule.kinds(part, state)
            part, kinds = part.filter(pa.array(kinds != SKIP)), kinds[kinds != SKIP]
            first = np.flatnonzero(kinds == BEGINS)
            held += part.slice(0, first[0] if len(first) else len(part)).to_pylist()
            if not len(first):
                continue
            if rows := rest(True):
                yield made(rows)
            if len(first) > 1:
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), part), "\n")
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([where[0]] * n), pa.array([where[1]] * n), pa.array(np.arange(k + 1, k + 1 + n)), pa.array([where[1]] * n), texts, pa.array([True] * n)], schema=_CUT_ARROW)
            k, held = k + len(first), part.slice(int(first[-1])).to_pylist()
        if where and (rows := rest(not rule.open(state))):
            yield made(rows)

    found = materialize(lines.mapInArrow(run, _CUT))
    pieces = found.where("not whole").groupBy("file", "block").agg(F.max("k").alias("k"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    joined = pieces.select("file", "block", "k", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return found.where("whole").select("file", "block", "k", "text").unionByName(joined)


def records(spark: SparkSession, path: str | list[str], rule: Quoted | FourLines | Headed) -> DataFrame:
    """The records of all files at ``path`` under ``rule``: file, block, k, text."""
    lines = blocks(spark, path)
    known, _ = chained(passed(lines, rule).collect())  # a row for each block and state
    return cut(lines, rule, known)
