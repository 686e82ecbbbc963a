"""Conversation structure repair by a time-major tensor DP.

A conversation is brought to the shape ``(system? (user assistant)+)?`` by the cheapest edits: rows are kept, given
another role, deleted, and empty turns are inserted.  Conversations are bucketed by length; for a bucket the costs to
the end of all its conversations are updated a turn at a time, from the last to the first, as a (state, conversation)
matrix, and every turn's costs are stored.  Edits are then traced forwards for all conversations at once: of the edits
that keep to the stored cost the first in order of its letter is taken, so of all cheapest edit strings the least is
found.

Rows are sorted over range partitions, so a conversation of any length is cut into pieces of bounded size.  A piece is
a 4 x 4 matrix of costs from state to state; the few conversations that cross partitions (one a partition at most) are
put together from these, which gives each piece its state at either end, and their texts are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prefix
from . import base

#: States: nothing yet, after system, after user, after assistant.  The role inserted or assigned in each, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
NAMES = ("user", "user", "assistant", "user")
#: Where a kept row leads by state and by the role's initial (s, u, a, any other); 0: not allowed.
KEEP = np.array([[SYSTEM, USER, 0, 0], [0, USER, 0, 0], [0, 0, ASSISTANT, 0], [0, USER, 0, 0]])
ENDS = np.array([START, ASSISTANT])
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = np.int64(1) << 60
#: UTF-8 bytes of roles and texts in a range partition, about; rows of it.
PIECE_BYTES, PIECE_ROWS = 8 << 20, 100_000


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs (..., state, conversation) where up to two turns may be inserted first; more never help."""
    for _ in range(2):
        cost = np.minimum(cost, cost[..., NEXT, :] + INSERT)
    return cost


def ending() -> np.ndarray:
    out = np.full(4, FAR)
    out[ENDS] = 0
    return out


class Bucket:
    """Conversations (or pieces) of like length as time-major tensors: (turn, conversation); short ones are filled up at the end."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, role: np.ndarray, forced: np.ndarray, cut: np.ndarray, copies: np.ndarray):
        n = int(lengths.max(initial=0))
        at = starts[None, :] + np.arange(n)[:, None]
        self.there = np.arange(n)[:, None] < lengths[None, :]
        at = np.where(self.there, at, 0)
        self.role, self.forced = role[at] if n else at, forced[at] if n else at.astype(bool)
        # a row stands for ``copies`` equal ones; all but the first must go, and all of a row that must go itself
        self.drop = DELETE * copies[at] if n else at
        self.stay = (TRUNCATED * cut[at] + DELETE * (copies[at] - 1)) if n else at
        self.turns, self.size = n, len(lengths)

    def backward(self, end: np.ndarray) -> np.ndarray:
        """(turn, state, conversation): the cost from each turn's state to the end, given the costs (state, conversation) of what follows."""
        cost = np.empty((self.turns + 1, 4, self.size), np.int64)
        cost[-1] = closed(end)
        for t in range(self.turns - 1, -1, -1):
            after = cost[t + 1]
            to = KEEP[:, self.role[t]]
            keep = np.where(to > 0, np.take_along_axis(after, to, 0), FAR)
            stay = np.minimum(keep, after[NEXT] + REROLE) + self.stay[t]
            best = np.minimum(after + self.drop[t], np.where(self.forced[t], FAR, stay))
            cost[t] = np.where(self.there[t], closed(best), after)
        return cost

    def trace(self, cost: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first edits in order of their letters: inserts before each turn, each turn's letter (0: none), the last state."""
        inserts = np.zeros((self.turns + 1, self.size), np.int8)
        letters = np.zeros((self.turns, self.size), np.uint8)
        here, state = np.arange(self.size), state.copy()

        def insert(t: int, may: np.ndarray) -> None:
            for _ in range(2):
                yes = may(state) & (cost[t][NEXT[state], here] + INSERT == cost[t][state, here])
                inserts[t] += yes
                state[yes] = NEXT[state[yes]]

        for t in range(self.turns):
            there = self.there[t]
            delete = lambda q: cost[t + 1][q, here] + self.drop[t] == cost[t][q, here]  # noqa: E731
            insert(t, lambda q: there & ~delete(q))
            gone = delete(state)
            to = KEEP[state, self.role[t]]
            kept = (to > 0) & ~self.forced[t] & (np.where(to > 0, cost[t + 1][to, here], FAR) + self.stay[t] == cost[t][state, here])
            letters[t] = np.where(~there, 0, np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R"))))
            state = np.where(there & ~gone, np.where(kept, to, NEXT[state]), state)
        insert(self.turns, lambda q: end[q, here] != cost[self.turns][q, here])
        return inserts, letters, state

    def through(self) -> np.ndarray:
        """(from, to, conversation): the cost between states at either end."""
        return np.stack([self.backward(np.where(np.arange(4)[:, None] == q, 0, FAR) + np.zeros((4, self.size), np.int64))[0] for q in range(4)], axis=1)


def by_length(lengths: np.ndarray) -> list[np.ndarray]:
    """Numbers of the conversations of each bucket: lengths up to the same power of two."""
    kind = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    return [np.flatnonzero(kind == k) for k in np.unique(kind)]


def edits(inserts: list[int], letters: list[int], copies: list[int]) -> str:
    """The string of one conversation's edits: copies of a row after the first are deleted after it."""
    out = []
    for k, letter, n in zip(inserts, letters, copies):
        out.append("I" * k + chr(letter) + "D" * (n - 1))
    return "".join(out) + "I" * inserts[len(letters)]


def repaired(state: int, inserts: list[int], letters: list[int], roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the rows that one conversation has after its edits."""
    out = []

    def add(n: int) -> None:
        nonlocal state
        for _ in range(n):
            out.append(f"{NAMES[state]}:")
            state = NEXT[state]

    for k, letter, role, text in zip(inserts, letters, roles, texts):
        add(k)
        if letter == ord("K"):
            out.append(f"{role}:{text}")
            state = KEEP[state, initial(role)]
        elif letter == ord("R"):
            out.append(f"{NAMES[state]}:{text}")
            state = NEXT[state]
    add(inserts[len(letters)])
    return out


def initial(role: str) -> int:
    return "sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3


_PIECE = "conv_id long, part long, n_rows long, first_turn long, last_turn long, turns long, first_role int, last_role int, blank long, duplicate long, truncated long, illegal long, costs array<long>, states array<int>, audit string, text binary, sha string"
_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("part", "n_rows", "first_turn", "last_turn", "turns")], ("first_role", pa.int32()), ("last_role", pa.int32()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("costs", pa.list_(pa.int64())), ("states", pa.list_(pa.int32())), ("audit", pa.string()), ("text", pa.binary()), ("sha", pa.string())])  # fmt: skip
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def pieces(known: dict | None = None, step: str = "whole"):
    """The function over one range partition's rows.

    ``known``: by (conv_id, partition), what is known of pieces of conversations that cross partitions.  ``whole``: all rows;
    conversations of this partition alone are finished, pieces of others give their costs from state to state.  ``states``:
    only pieces; given the costs after them, the last state for each first one.  ``edits``: given the first state too.
    """
    known = known or {}

    @base.tidy
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_at", "ascending")])
        part = t["_part"][0].as_py()
        ids, turn, copies = t["conv_id"].to_pylist(), t["turn"].to_pylist(), t["copies"].to_numpy()
        roles, texts = t["role"].to_pylist(), t["text"].to_pylist()
        fault, role = t["fault"].to_numpy(), t["code"].to_numpy()
        new = np.array([True, *[a != b for a, b in zip(ids, ids[1:])]])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(ids)))
        # rows that the damage dropped only keep their conversation's id
        own = np.repeat(np.arange(len(first)), sizes)[copies > 0]
        live = np.flatnonzero(copies > 0)
        lengths = np.bincount(own, minlength=len(first))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        forced, cut = (fault == 1) | (fault == 2), fault == 3
        lane = (role[live], forced[live], cut[live].astype(np.int64), copies[live])
        out = []
        for group in by_length(lengths):
            bucket = Bucket(starts[group], lengths[group], *lane)
            keys = [(ids[first[c]], part) for c in group]
            told = [known.get(k, {}) for k in keys]
            end = np.stack([x.get("end", ending()) for x in told], axis=1)
            state = np.array([x.get("state", START) for x in told])
            ready = [k not in known or step != "whole" for k in keys]
            cost = bucket.backward(end)
            through = bucket.through() if step == "whole" and not all(ready) else None
            leads = [bucket.trace(cost, end, np.full(len(group), q))[2] for q in range(4)] if step == "states" else None
            inserts, letters, _ = bucket.trace(cost, end, state)
            for j, c in enumerate(group):
                at = live[starts[c] : starts[c] + lengths[c]]
                n, f = copies[at], fault[at]
                dated = [turn[i] for i in at if turn[i] is not None]
                row = {"conv_id": ids[first[c]], "part": part, "n_rows": int(n.sum()), "first_turn": dated[0] if dated else None, "last_turn": dated[-1] if dated else None, "turns": len(set(dated))}
                row |= {"first_role": int(role[at[0]]) if len(at) else None, "last_role": int(role[at[-1]]) if len(at) else None}
                row |= {"blank": int(n[f == 1].sum()), "duplicate": int(n[f == 2].sum() + (n[(f == 0) | (f == 3)] - 1).sum()), "truncated": int((f == 3).sum())}
                row["illegal"] = int((~_LEGAL[role[at[:-1]], role[at[1:]]]).sum() + (n - 1).sum()) if len(at) else 0
                row |= dict.fromkeys(("costs", "states", "audit", "text", "sha"))
                if step == "states":
                    row["states"] = [int(q[j]) for q in leads]
                elif not ready[j]:
                    row["costs"] = through[:, :, j].ravel().tolist()
                else:
                    signs, last = letters[: lengths[c], j], inserts[lengths[c] :, j].sum()
                    moves = [*inserts[: lengths[c], j].tolist(), int(last)]
                    row["audit"] = edits(moves, signs.tolist(), n.tolist())
                    lines = repaired(int(state[j]), moves, signs.tolist(), [roles[i] for i in at], [texts[i] for i in at])
                    data = "\n".join(lines).encode("utf-8", "surrogatepass")
                    row["costs"] = [int(cost[0][state[j], j])]
                    row["sha"], row["text"] = (hashlib.sha256(data).hexdigest(), None) if keys[j] not in known else (None, data if lines else None)
                out.append(row)
        return pa.Table.from_pylist(out, schema=_ARROW)

    return run


def _bounds(parts: list[dict]) -> tuple[list[np.ndarray], int]:
    """Costs after each piece of one conversation, and of all of it: the pieces' matrices from the last to the first."""
    ends = [ending()]
    for p in reversed(parts[1:]):
        ends.append(np.minimum((np.array(p["costs"]).reshape(4, 4) + closed(ends[-1][:, None])[:, 0]).min(axis=1), FAR))
    ends.reverse()
    whole = (np.array(parts[0]["costs"]).reshape(4, 4) + closed(ends[0][:, None])[:, 0]).min(axis=1)
    return ends, int(whole[START])


@base.tidy
def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, audit and hash of conversations whose pieces follow each other, in order."""
    names = ["conv_id", "audit", "sha"]
    current, audit, sha, some = None, [], None, False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=names)

    for b in batches:
        for conv, edit, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if current != (conv,):
                if current is not None:
                    yield done()
                current, audit, sha, some = (conv,), [], hashlib.sha256(), False
            audit.append(edit or "")
            if text is not None:
                sha.update((b"\n" if some else b"") + text)
                some = True
    if current is not None:
        yield done()


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with ``fault``: 1 blank, 2 duplicate, 3 truncated, 0 none; by the first copy of a row.

    A duplicate has the role and text of a row earlier in its conversation, by turn (nulls first).
    """
    white = r"[\x20\x09-\x0D]"
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.withColumn("_h", F.unhex(key))
    again = keyed.where("copies > 0").groupBy("conv_id", "_h").agg(F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("_first"), F.max("turn").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("_h").alias("_k"), "_first")
    met = keyed.join(again, keyed["conv_id"].eqNullSafe(again["_c"]) & (keyed["_h"] == again["_k"]), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.col("_first").isNotNull() & (F.coalesce("turn", F.lit(-(1 << 63))) > F.col("_first"))
    cut = ~F.col("text").rlike(rf"[.!?]{white}*\z")
    fault = F.when(blank, 1).when(later, 2).when(cut, 3).otherwise(0)
    return met.select(*rows.columns, fault.cast("int").alias("fault"))


def repair(rows: DataFrame, piece_bytes: int = PIECE_BYTES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    In: conv_id long, turn long, role string, text string (none of role and text null) and copies long, how often the
    row stands there: 0 keeps only the conversation's id.  Other columns are ignored.  Rows are taken by turn (nulls
    first), ties by role and text.  A null conv_id is a conversation of its own.  Rows equal in all columns are one
    row with copies, so a group of copies never fills a partition; conversations of any length are cut into pieces.
    Conversations without rows get zeros, an empty audit and the empty string's hash; an empty table gives no rows.
    """
    spark = rows.sparkSession
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    code = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    code = F.when(F.col("role") == "", 3).otherwise(code).cast("int")
    marked = base.save(faults(same).withColumn("code", code))
    size = marked.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("role")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-int(size[0]) // piece_bytes), -(-size[1] // piece_rows))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = prefix.ranged(marked, order, parts=parts)
    spread = placed.groupBy("conv_id").agg(F.min(prefix.PART).alias("a"), F.max(prefix.PART).alias("b")).where("a < b")
    crossing = [r["conv_id"] for r in spread.select("conv_id").collect()]  # one for each border between partitions at most
    held = placed.join(F.broadcast(spark.createDataFrame([(c,) for c in crossing], "_c long")), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c") if crossing else None
    known = {(r["conv_id"], r[prefix.PART]): {} for r in held.groupBy("conv_id", prefix.PART).count().collect()} if crossing else {}  # two a partition at most
    found = base.save(placed.groupBy(prefix.PART).applyInArrow(pieces(known), _PIECE))
    done = found.where("sha is not null").select("conv_id", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), "audit", "sha")
    if crossing:
        slim = [c for c in found.columns if c not in ("audit", "text", "sha")]
        by_id: dict = {}
        for r in found.where("sha is null").select(*slim).orderBy("conv_id", "part").collect():  # two a partition at most
            by_id.setdefault(r["conv_id"], []).append(r.asDict())
        costs = {}
        for conv, parts_ in by_id.items():
            ends, costs[conv] = _bounds(parts_)
            for p, end in zip(parts_, ends):
                known[conv, p["part"]] = {"end": end}
        led = {(r["conv_id"], r["part"]): r["states"] for r in held.groupBy(prefix.PART).applyInArrow(pieces(known, "states"), _PIECE).select("conv_id", "part", "states").collect()}
        for conv, parts_ in by_id.items():
            state = START
            for p in parts_:
                known[conv, p["part"]]["state"] = state
                state = led[conv, p["part"]][state]
        made = held.groupBy(prefix.PART).applyInArrow(pieces(known, "edits"), _PIECE).select("conv_id", "part", "audit", "text")
        streams = made.repartition(max(1, len(by_id)), "conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "audit", "text").mapInArrow(_stream, "conv_id long, audit string, sha string")
        rest = spark.createDataFrame([(c, *_together(p), costs[c]) for c, p in by_id.items()], "_c long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long")
        whole = base.save(streams).join(F.broadcast(rest), F.col("conv_id").eqNullSafe(F.col("_c")))
        done = done.unionByName(whole.select(*done.columns))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return done.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def _together(parts: list[dict]) -> tuple:
    """first_turn, last_turn, turns, blank, duplicate, truncated, illegal of all pieces of one conversation."""
    turns, last_turn, last_role, illegal = 0, None, None, 0
    for p in parts:
        if p["first_turn"] is not None:
            turns += p["turns"] - (p["first_turn"] == last_turn)
            last_turn = p["last_turn"]
        if p["first_role"] is not None:
            illegal += p["illegal"] + (last_role is not None and not _LEGAL[last_role, p["first_role"]])
            last_role = p["last_role"]
    first = next((p["first_turn"] for p in parts if p["first_turn"] is not None), None)
    return first, last_turn, turns, *[sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")], int(illegal)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by crc32 of ``conv_id:turn`` modulo 20 rows are dropped (0), emptied (1), robbed of ``.!?``
    (2), doubled (3) or given to the user (4).  Null roles and texts are one space, and so is a null id or turn in the key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(base.table(spark, sf_dir, "conversations")))


_CRC = "xor(list_reduce(list_concat([4294967295], flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(s, '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
#: The conversations' costs row by row, forwards: of each state the least cost and string, with its rows; inserts come before a row's edit.
ORACLE_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
), coded AS (
    SELECT conv_id, turn, role, text, {_CRC} % 20 AS k FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN k = 0 THEN []::INT[] WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM coded
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM placed
), counted AS (
    SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY c.conv_id
), inserts(q, q1, cost1, audit1, made) AS (
    VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
        (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
        (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (3, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:'])
), moves(q1, letter, code, q2, cost2) AS (
    VALUES (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4),
        (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
        (0, 'R', '', 2, 3), (1, 'R', '', 2, 3), (2, 'R', '', 3, 3), (3, 'R', '', 2, 3)
), walk AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS best FROM counted
    UNION ALL
    SELECT w.conv_id, f.i, m.q2, min({{
        'c': w.best.c + n.cost1 + m.cost2 + CASE WHEN fault = 3 AND letter <> 'D' THEN 3 ELSE 0 END, 'a': w.best.a || n.audit1 || m.letter,
        'l': list_concat(list_concat(w.best.l, n.made), CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END)}})
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts n ON n.q = w.q
        JOIN moves m ON m.q1 = n.q1 AND (letter = 'D' OR fault IN (0, 3)) AND (letter <> 'K' OR m.code = left(f.role, 1))
    GROUP BY w.conv_id, f.i, m.q2
), ended AS (
    SELECT w.conv_id, min({{'c': w.best.c + n.cost1, 'a': w.best.a || n.audit1, 'l': list_concat(w.best.l, n.made)}}) AS best
    FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.q = w.q AND n.q1 IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM counted c JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
