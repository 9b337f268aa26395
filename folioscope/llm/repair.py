"""Conversation repair: cheapest edits to the turns of all conversations at once, by dynamic programming over arrays.

Turns of a conversation are emitted through four states: nothing yet (0), after the system message (1), after a user
message (2), after an assistant message (3).  From each state one role of user and assistant may come next; the end may be
reached from 0 and 3.  Costs run backward through the turns for a whole bucket of conversations of like length in
one array (time first), and the edits are read forward from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns and bytes of one piece: a longer conversation is worked on in pieces, so that no task holds a whole one.
PIECE_TURNS, PIECE_BYTES = 4096, 4 << 20
#: Turns times conversations of one array.
CELLS = 1 << 20

STATES = 4
_FAR = np.int64(1) << 40
#: The state after a user or assistant message that may follow, and the class of row that may be kept for it.
_NEXT = np.array([2, 2, 3, 2])
_CLASS = np.array([1, 1, 2, 1])
_END = np.array([0, _FAR, _FAR, 0])
#: Bits of a turn's code beside its class (0 system, 1 user, 2 assistant, 3 other).
_TRUNC, _GONE = 4, 8
#: Nothing, then the edits in the order of their letters.
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
D, I, K, R = 1, 2, 3, 4  # noqa: E741


def _options(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and re-roling a turn from each state, given the costs after it (state, conversation)."""
    kind, extra, gone = code & 3, np.where(code & _TRUNC, TRUNCATED, 0), (code & _GONE) > 0
    delete = DELETE + after
    fits = ~gone & (kind == _CLASS[:, None])
    keep = np.where(fits, extra + after[_NEXT], _FAR)
    keep[0] = np.where(~gone & (kind == 0), extra + after[1], keep[0])
    rerole = np.where(gone, _FAR, REROLE + extra + after[_NEXT])
    return delete, keep, rerole


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs with messages put in first: two at most, as a third one would undo the first."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[_NEXT])
    return costs


def backward(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost from each turn and state to the end; ``codes`` is (turn, conversation), ``end`` (state, conversation)."""
    longest, many = codes.shape
    costs = np.empty((longest + 1, STATES, many), np.int64)
    last = _with_inserts(np.minimum(end, _FAR))
    costs[longest] = last
    for t in range(longest - 1, -1, -1):
        delete, keep, rerole = _options(codes[t], costs[t + 1])
        now = _with_inserts(np.minimum(np.minimum(delete, keep), rerole))
        costs[t] = np.minimum(np.where(t < lengths, now, last), _FAR)
    return costs


def forward(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray, costs: np.ndarray, start: np.ndarray, closing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits (slot, conversation), least letters first, and the state after them.

    A turn has three slots: two for messages put in before it and one for itself; the last two are for messages at the end.
    Where the conversation goes on in another piece (not ``closing``) messages between the two belong to the next one.
    """
    longest, many = codes.shape
    edits, state, at = np.zeros((3 * longest + 2, many), np.int8), start.copy(), np.arange(many)

    def put_in(slot: int, live: np.ndarray, now: np.ndarray, without: np.ndarray) -> None:
        chosen = live & ~without & (now[state, at] == INSERT + now[_NEXT[state], at])
        edits[slot] = np.where(chosen, I, 0)
        state[:] = np.where(chosen, _NEXT[state], state)

    for t in range(longest):
        live, now = t < lengths, costs[t]
        delete, keep, rerole = _options(codes[t], costs[t + 1])
        for slot in (3 * t, 3 * t + 1):
            put_in(slot, live, now, delete[state, at] == now[state, at])
        best = now[state, at]
        gone, kept = delete[state, at] == best, keep[state, at] == best
        edits[3 * t + 2] = np.where(live, np.where(gone, D, np.where(kept, K, R)), 0)
        system = (codes[t] & 3 == 0) & (state == 0) & kept
        state = np.where(live & ~gone, np.where(system, 1, _NEXT[state]), state)
    if closing:
        for slot in (3 * longest, 3 * longest + 1):
            put_in(slot, np.ones(many, bool), costs[longest], end[state, at] == costs[longest][state, at])
    return edits, state


# ---------------------------------------------------------------- turns

_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("code", pa.int8()), ("initial", pa.string())])
_TURNS_SQL = "array<struct<role:string,text:string,code:tinyint,initial:string>>"
_BLANK = 16
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = ("su", "ua", "au")


class Turns:
    """Turns of some conversations (or pieces) one behind the other, as arrays."""

    def __init__(self, lists: list[list[dict]], firsts: list[set[int]] | None = None) -> None:
        self.lists, self.lengths = lists, np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(lists)), self.lengths)
        code = np.array([t["code"] for x in lists for t in x], np.int64)
        blank = (code & _BLANK) > 0
        if firsts is None:
            seen = pa.array([f"{i} {len(t['role'])} {t['role']}{t['text']}" for i, x in enumerate(lists) for t in x], pa.large_string()).dictionary_encode().indices.to_numpy()
            first = np.zeros(len(code), bool)
            first[np.unique(seen, return_index=True)[1]] = True
        else:
            first = np.array([at in mine for x, mine in zip(lists, firsts, strict=True) for at in range(len(x))], bool)
        twin = ~blank & ~first
        cut = ~blank & first & ((code & _TRUNC) > 0)
        self.codes = (code & 3) | np.where(cut, _TRUNC, 0) | np.where(blank | twin, _GONE, 0)
        initials = [t["initial"] for x in lists for t in x]
        odd = np.array([f"{a}{b}" not in _LEGAL for a, b in zip(initials, initials[1:])] + [False] * bool(initials), bool)
        odd[(self.starts + self.lengths - 1)[self.lengths > 0]] = False  # no pair over the end
        self.counts = {n: np.bincount(self.owner[x], minlength=len(lists)) for n, x in zip(_COUNTS, (blank, twin, cut, odd), strict=True)}

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, codes (turn, conversation) and lengths of conversations of like length: the longest at most twice the shortest."""
        order, at = np.argsort(self.lengths, kind="stable"), 0
        ranked = self.lengths[order]
        while at < len(order):
            least = max(int(ranked[at]), 1)
            end = max(at + 1, min(at + max(1, CELLS // (2 * least)), int(np.searchsorted(ranked, 2 * least, side="right"))))
            places, at = order[at:end], end
            turns = np.arange(int(self.lengths[places].max()))[:, None]
            spots = np.minimum(self.starts[places] + turns, max(len(self.codes) - 1, 0))
            yield places, self.codes[spots] if len(self.codes) else np.zeros(spots.shape, np.int64), self.lengths[places]


def _lines(turns: list[dict], edits: bytes, state: int) -> Iterator[str]:
    """The repaired messages, by the edits' letters."""
    at = 0
    for edit in edits:
        if edit == 68:  # D
            at += 1
            continue
        wanted = "assistant" if state == 2 else "user"
        if edit == 73:  # I
            yield f"{wanted}:"
        else:
            turn = turns[at]
            yield f"{turn['role'] if edit == 75 else wanted}:{turn['text']}"
            at += 1
            if edit == 75 and turn["code"] & 3 == 0:
                state = 1
                continue
        state = int(_NEXT[state])


def _whole(ids: list, lists: list[list[dict]]) -> Iterator[tuple]:
    """Results of conversations that are at hand as a whole."""
    turns = Turns(lists)
    for places, codes, lengths in turns.buckets():
        end = np.repeat(_END[:, None], len(places), axis=1)
        costs = backward(codes, lengths, end)
        edits, _ = forward(codes, lengths, end, costs, np.zeros(len(places), np.int64))
        for column, place in enumerate(places.tolist()):
            audit = _LETTERS[edits[:, column]].tobytes().replace(b"\0", b"")
            digest = hashlib.sha256("\n".join(_lines(lists[place], audit, 0)).encode())
            yield (ids[place], *(int(turns.counts[n][place]) for n in _COUNTS), int(costs[0, 0, column]), audit.decode(), digest.hexdigest())


_DONE = pa.struct([("conv_id", pa.int64()), *((n, pa.int64()) for n in (*_COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DONE_SQL = "struct<conv_id:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,repaired_sha256:string>"
_FIRST = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("turns", pa.list_(_TURN)), ("done", _DONE)])


def _sorted_turns(batches: Iterator[pa.RecordBatch], piece_turns: int) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie in this task as a whole; pieces of the others.

    A task's first and last conversation may go on in its neighbours, so those are handed on as pieces, and so are
    conversations of more than one piece.
    """
    number = TaskContext.get().partitionId() << 32
    held: list[dict] = []  # turns of the piece that is being read
    ready: list[tuple] = []  # whole conversations
    size = ready_size = 0
    current, known, split = None, 0, False

    def piece() -> pa.RecordBatch:
        nonlocal number
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([number], pa.int64()), pa.array([held], pa.list_(_TURN)), pa.nulls(1, _DONE)], schema=_FIRST)

    def results() -> pa.RecordBatch:
        names = [f.name for f in _DONE]
        done = [dict(zip(names, x, strict=True)) for x in _whole([c for c, _ in ready], [t for _, t in ready])]
        return pa.RecordBatch.from_arrays([pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.list_(_TURN)), pa.array(done, _DONE)], schema=_FIRST)

    for batch in batches:
        ids, turns = batch.column("conv_id").to_pylist(), batch.column("turn_of").to_pylist()
        for conv, turn in zip(ids, turns, strict=True):
            if not known or conv != current:
                if known == 1 or split:
                    yield piece()
                elif known:
                    ready.append((current, held))
                    ready_size += size
                if len(ready) >= 4096 or ready_size >= PIECE_BYTES:
                    yield results()
                    ready, ready_size = [], 0
                current, known, split, held, size = conv, known + 1, False, [], 0
            elif len(held) >= piece_turns or size >= PIECE_BYTES:
                yield piece()
                split, held, size = True, [], 0
            held.append(turn)
            size += len(turn["text"])
    if ready:
        yield results()
    if held:
        yield piece()


# ---------------------------------------------------------------- conversations of several pieces


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_MARKED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("codes", pa.binary()), *((n, pa.int64()) for n in _COUNTS), ("opens", pa.string()), ("ends", pa.string()), ("ways", pa.list_(pa.int64()))])
_MARKED_SQL = "conv_id long, piece long, codes binary, blank long, duplicate long, truncated long, illegal long, opens string, ends string, ways array<long>"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and counts of each piece, and ``ways``: the least cost from each state before it to each state after it."""
    for row in _pieces(batches):
        turns = Turns([row["turns"]], [set(row["firsts"] or ())])
        codes, lengths = np.repeat(turns.codes[:, None], STATES, axis=1), np.repeat(turns.lengths, STATES)
        goals = np.where(np.eye(STATES, dtype=bool), 0, _FAR)
        # messages put in at the end are the next piece's: they are in its costs
        ways = backward(codes, lengths, goals)[0] if len(turns.codes) else goals
        out = {"conv_id": row["conv_id"], "piece": row["piece"], "codes": turns.codes.astype(np.int8).tobytes(), "opens": row["turns"][0]["initial"], "ends": row["turns"][-1]["initial"], "ways": ways.reshape(-1).tolist()}
        yield _batch([out | {n: int(turns.counts[n][0]) for n in _COUNTS}], _MARKED)


_AFTER = pa.schema([("piece", pa.int64()), ("after", pa.list_(pa.int64()))])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from the end of each piece on; pieces come last first, so only the running costs are held."""
    current, known, after = None, False, _END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not known or row["conv_id"] != current:
                current, known, after = row["conv_id"], True, _END
            out.append({"piece": row["piece"], "after": after.tolist()})
            after = np.minimum((np.array(row["ways"]).reshape(STATES, STATES) + _with_inserts(after[:, None])[:, 0]).min(axis=1), _FAR)
        yield _batch(out, _AFTER)


def _read_on(codes: bytes, after: list[int], starts: np.ndarray, closing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, edits and end states of one piece from each of ``starts``."""
    flat = np.frombuffer(codes, np.int8).astype(np.int64)
    many = len(starts)
    block, lengths = np.repeat(flat[:, None], many, axis=1), np.full(many, len(flat))
    end = np.repeat(np.array(after)[:, None], many, axis=1)
    costs = backward(block, lengths, end)
    edits, state = forward(block, lengths, end, costs, starts.copy(), closing)
    return costs, edits, state


_STEPS = pa.schema([("piece", pa.int64()), ("leads", pa.list_(pa.int64())), ("costs", pa.int64())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each piece for each state before it, and the cost from its beginning on."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            costs, _, state = _read_on(row["codes"], row["after"], np.arange(STATES), False)
            out.append({"piece": row["piece"], "leads": state.tolist(), "costs": int(costs[0, 0, 0])})
        yield _batch(out, _STEPS)


_STARTS = pa.schema([("piece", pa.int64()), ("start", pa.int64()), ("closing", pa.bool_()), ("costs", pa.int64()), ("pair", pa.int64())])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each piece, pieces in order: whether it is the last is known when the next row is read."""
    before, state = None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            same = before is not None and before["conv_id"] == row["conv_id"]
            if before is not None:
                out.append(before["out"] | {"closing": not same})
            state = state if same else 0
            odd = same and before["ends"] + row["opens"] not in _LEGAL
            before = {"conv_id": row["conv_id"], "ends": row["ends"], "out": {"piece": row["piece"], "start": state, "costs": None if same else row["costs"], "pair": int(odd)}}
            state = row["leads"][state]
        yield _batch(out, _STARTS)
    if before is not None:
        yield _batch([before["out"] | {"closing": True}], _STARTS)


_SPOKEN = pa.schema([("piece", pa.int64()), ("part", pa.string()), ("lines", pa.list_(pa.string()))])


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's edits and repaired messages."""
    for row in _pieces(batches):
        _, edits, _ = _read_on(row["codes"], row["after"], np.array([row["start"]]), row["closing"])
        part = _LETTERS[edits[:, 0]].tobytes().replace(b"\0", b"")
        yield _batch([{"piece": row["piece"], "part": part.decode(), "lines": list(_lines(row["turns"], part, row["start"]))}], _SPOKEN)


_JOINED = pa.schema(list(_DONE))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as one result a conversation: the digest takes the messages as they come, only the letters are held."""
    current, known = None, False

    def result() -> pa.RecordBatch:
        return _batch([totals | {"conv_id": current, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}], _JOINED)

    for row in _pieces(batches):
        if not known or row["conv_id"] != current:
            if known:
                yield result()
            current, known, digest, letters, empty = row["conv_id"], True, hashlib.sha256(), [], True
            totals = dict.fromkeys((*_COUNTS, "cost"), 0)
        for n in _COUNTS:
            totals[n] += row[n]
        totals["illegal"] += row["pair"]
        totals["cost"] += row["costs"] or 0
        letters.append(row["part"])
        for line in row["lines"]:
            digest.update(line.encode() if empty else b"\n" + line.encode())
            empty = False
    if known:
        yield result()


def _long(pieces: DataFrame) -> DataFrame:
    """Conversations in several pieces: costs of each piece as a matrix, chained last to first, states chained first to last."""
    turn = pieces.select("conv_id", "piece", F.posexplode("turns").alias("at", "t")).where(f"(t.code & {_BLANK}) = 0")
    said = F.sha2(F.concat(F.length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")), 256)
    firsts = turn.groupBy("conv_id", said.alias("said")).agg(F.min(F.struct("piece", "at")).alias("f")).groupBy(F.col("f.piece").alias("piece")).agg(F.collect_list("f.at").alias("firsts"))
    spark = pieces.sparkSession
    with common.batches_of(spark, 4):
        marked = common.stored(pieces.join(firsts, "piece", "left").select("conv_id", "piece", "turns", "firsts").mapInArrow(_marked, _MARKED_SQL))
    after = marked.select("conv_id", "piece", "ways").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(_suffixes, "piece long, after array<long>")
    reach = common.stored(marked.select("piece", "codes").join(after, "piece"))
    steps = reach.mapInArrow(_steps, "piece long, leads array<long>, costs long")
    chain = marked.select("conv_id", "piece", "opens", "ends").join(steps, "piece").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    starts = common.stored(chain.mapInArrow(_starts, "piece long, start long, closing boolean, costs long, pair long"))
    told = pieces.select("piece", "turns").join(reach, "piece").join(starts.select("piece", "start", "closing"), "piece")
    with common.batches_of(spark, 4):
        spoken = common.stored(told.mapInArrow(_spoken, "piece long, part string, lines array<string>"))
        parts = marked.select("conv_id", "piece", *_COUNTS).join(starts.select("piece", "costs", "pair"), "piece").join(spoken, "piece")
        fields = ", ".join(f"{n} long" for n in (*_COUNTS, "cost"))
        return common.stored(parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_joined, f"conv_id long, {fields}, audit string, repaired_sha256 string"))


def repair(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Faults of each conversation and the cheapest edits that make it alternate: ``(system? (user assistant)+)?``.

    Takes conv_id, turn, role and text.  Turns stand by number, nulls first, then by role and text; a null role or text
    counts as one blank.  The first fault of a turn counts: blank (nothing but white space), duplicate (role and text
    seen earlier), truncated (its last character that is not white space is none of ``.!?``).  Edits: keep (0), re-role to user or
    assistant (2), delete (3, the only one for blank and duplicate turns), insert an empty user or assistant message (2);
    truncated turns that are not deleted add 1.  Among the cheapest edits those with the least letters are taken.

    Turns are dealt by ranges of (conv_id, turn, ...), so a conversation of any length is spread over tasks.  What lies in
    one task is repaired there, many conversations at once; longer ones are cut into pieces, each piece's costs become a
    matrix of 4 x 4, and costs and states are chained through these.  Only a conversation's digest is taken in one task, by
    its definition; it streams.

    Returns conv_id, gaps (numbers missing between the least and the largest turn), blank, duplicate, truncated, illegal
    (neighbouring roles other than system-user, user-assistant, assistant-user, by their initials), cost, audit (initials of the
    edits) and repaired_sha256 (of ``role:text`` lines).  Rows with a null conv_id are one conversation; an empty table gives
    no rows.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = kind + F.when(cut, _TRUNC).otherwise(0) + F.when(blank, _BLANK).otherwise(0)
    spread = rows.select("conv_id", "turn", F.substring("text", 1, 64).alias("beginning"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"), F.struct("role", "text", code.cast("tinyint").alias("code"), initial.alias("initial")).alias("turn_of"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_of.role"), F.col("beginning"), F.col("mark"), F.col("row")]
    with common.batches_of(conversations.sparkSession, 500):
        dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn_of")
        first = common.stored(dealt.mapInArrow(lambda it: _sorted_turns(it, piece_turns), f"conv_id long, piece long, turns {_TURNS_SQL}, done {_DONE_SQL}"))
    done = first.where("done is not null").select("done.*").unionByName(_long(first.where("done is null").drop("done")))
    gaps = rows.groupBy(F.col("conv_id").alias("gap_id")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return done.join(gaps, done["conv_id"].eqNullSafe(gaps["gap_id"])).select("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one blank).

    0 drops the turn, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes the user say it.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    dealt = rows.withColumn("fault", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    once = dealt.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return once.drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`repair` after :func:`damage`, with a row for every conversation, also those that lost all turns."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("asked")).distinct()
    mended = repair(damage(conversations))
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    joined = ids.join(mended, F.col("asked").eqNullSafe(mended["conv_id"]), "left")
    return joined.select(F.col("asked").alias("conv_id"), *(F.coalesce(c, F.lit(none.get(c, 0))).alias(c) for c in mended.columns[1:]))
