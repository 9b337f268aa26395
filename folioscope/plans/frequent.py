"""Runs of words that are frequent in a manuscript, found without moving the rare ones: Spark's rendering.

The runs of all texts are nearly as many as their words, and nearly all of them are rare.  A run needs a number of places that
grows with its manuscript, so runs are counted in a fixed number of slots first, each place weighing one over that number:
a slot under one holds no run that is frequent enough.  What passes is counted run by run, so no slot decides a result; if
many manuscripts fill all slots, all runs are counted that way.
"""

from __future__ import annotations

from folioscope.functions.dialect import Dialect

#: Slots, a power of two; as bits they are 128 KB, whatever the input.
SLOT_BITS = 20


def _slots(h: str, probes: int) -> list[str]:
    """The slots of a hash: of two, both must be set, which few other runs have."""
    return [f"(shiftrightunsigned({h}, {SLOT_BITS * i}) & {(1 << SLOT_BITS) - 1}L)" for i in range(probes)]


def bits(slots: str) -> str:
    """A relation of slots (slot) as one array of bits, 64 in a number."""
    numbers = f"(SELECT shiftright(slot, 6) AS at, bit_or(shiftleft(1L, CAST(slot & 63 AS INT))) AS b FROM {slots} s0 GROUP BY shiftright(slot, 6))"
    return f"(SELECT transform(sort_array(collect_list(struct(r.id, coalesce(n.b, 0L) AS b))), x -> x.b) AS bits, CAST(count(*) > 0 AS INT) AS one FROM range(0, {1 << (SLOT_BITS - 6)}) r LEFT JOIN {numbers} n ON n.at = r.id)"


def beside(rel: str, array: str) -> str:
    """Rows of a relation that are of a manuscript, with the array of bits.  A join: what several parts of a plan read is then worked out once."""
    return f"(SELECT /*+ BROADCAST(o) */ l.*, o.bits FROM {rel} l JOIN {array} o ON o.one = CAST(length(CAST(l.manuscript_id AS STRING)) >= 0 AS INT))"


def _bit(slot: str) -> str:
    return f"bit_get(bits[CAST(shiftright({slot}, 6) AS INT)], CAST({slot} & 63 AS INT)) = 1"


def held(h: str) -> str:
    """Whether the bits beside it hold a hash."""
    return " AND ".join(_bit(s) for s in _slots(h, 2))


def key_bits(d: Dialect, keys: str, names: str) -> str:
    """Bits of the keys of a relation, two for each."""
    return bits(d.spread(f"(SELECT array({', '.join(_slots('h', 2))}) AS ss FROM (SELECT xxhash64({names}) AS h FROM {keys} k0) k1)", "ss", "ss", "at", "slot"))


def _dealt(rel: str) -> str:
    """Chapters as arrays ts of their name, coded, and then their words: cut into words once, dealt once as lines and read by all parts of a plan.

    A column of its own for the name would be left out where it is not read, and texts be cut anew for that.
    """
    name = "coalesce(concat('c', hex(CAST(chapter AS STRING))), '-')"
    lines = f"(SELECT /*+ REPARTITION(line) */ manuscript_id, line FROM (SELECT manuscript_id, concat_ws(' ', {name}, toks) AS line FROM {rel} d0 WHERE manuscript_id IS NOT NULL) d1)"
    return f"(SELECT manuscript_id, split(line, ' ') AS ts FROM {lines} d2)"


def _runs(d: Dialect, rel: str, idle: str, keep: str) -> str:
    """Runs of three words of a chapter of which two are not ``idle`` (a list), as rows with the hash h and the place at, from 1.

    ``rel`` has manuscript_id, ts and the column ``keep``.  Words are rows, not elements of arrays: Spark compiles what it
    does with a row and interprets what it does with an element.
    """
    words = d.spread(rel, f"manuscript_id, ts, {keep}", "ts", "at", "w")
    # a word is never empty; of a null test, the optimizer would infer one of ts, which it would push down to the texts
    after = [f"get(ts, CAST(at AS INT) + {i})" for i in (1, 2)]
    busy = " + ".join(f"CASE WHEN {w} IN ({idle}) THEN 0 ELSE 1 END" for w in ("w", "w1", "w2"))
    near = f"(SELECT manuscript_id, ts, {keep}, CAST(at AS INT) AS at, w, {after[0]} AS w1, {after[1]} AS w2 FROM {words} f0)"
    return f"(SELECT manuscript_id, ts, {keep}, at, xxhash64(manuscript_id, w, w1, w2) AS h FROM {near} f1 WHERE at > 0 AND coalesce(w2, '') <> '' AND {busy} >= 2)"


def seeds(d: Dialect, rel: str, idle: str, least: float, rate: float, span: int) -> str:
    """Runs (manuscript_id, gram) with ``least`` places, ``rate`` of 10,000 words and two chapters at least: their places n and chapters chs.

    ``rel`` has manuscript_id, chapter and toks.  With them the smallest and largest text to the right and to the left of
    all places of a run, the run included.  Words joined by blanks sort so that what the smallest and the largest begin
    with, all begin with.
    """
    rel = _dealt(rel)
    totals = f"(SELECT manuscript_id, CAST(greatest(sum(CAST(size(ts) - 1 AS BIGINT)), 1) AS DOUBLE) AS total FROM {rel} t0 GROUP BY manuscript_id)"
    weighed = f"(SELECT /*+ BROADCAST(w) */ r.manuscript_id, r.ts, 1E0 / greatest({least}, {rate} * w.total / 10000E0) AS weight FROM {rel} r JOIN {totals} w ON w.manuscript_id = r.manuscript_id)"
    slots = f"(SELECT weight, {_slots('h', 1)[0]} AS slot FROM {_runs(d, weighed, idle, 'weight')} w1)"
    # a sum of doubles may fall short by its rounding
    heavy = f"(SELECT slot FROM {slots} w2 GROUP BY slot HAVING sum(weight) > 0.999E0)"
    ahead = f"array_join(slice(ts, at + 1, {span}), ' ')"
    behind = f"array_join(reverse(slice(ts, greatest(at - {span - 4}, 2), at + 2 - greatest(at - {span - 4}, 2))), ' ')"
    each = f"(SELECT manuscript_id, nullif(get(ts, 0), '-') AS chapter, array_join(slice(ts, at + 1, 3), ' ') AS gram, {ahead} AS ahead, {behind} AS behind FROM {_runs(d, beside(rel, bits(heavy)), idle, 'bits')} r2 WHERE {_bit(_slots('h', 1)[0])})"
    # dealt once, by run: places meet by chapter and then by run where they are
    dealt = f"(SELECT /*+ REPARTITION(manuscript_id, gram) */ manuscript_id, chapter, gram, ahead, behind FROM {each} e)"
    told = ", ".join(f"{f}(CASE WHEN chapter IS NOT NULL THEN {k} END) AS {k}{end}" for k in ("ahead", "behind") for f, end in (("min", ""), ("max", "_max")))
    counted = f"(SELECT manuscript_id, gram, count(*) AS total_n, count(chapter) AS n, count(DISTINCT chapter) AS chs, {told} FROM {dealt} e2 GROUP BY manuscript_id, gram HAVING count(*) >= {least} AND count(DISTINCT chapter) >= 2)"
    parted = ", ".join(f"split(s.{k}, ' ') AS {k}" for k in ("ahead", "ahead_max", "behind", "behind_max"))
    return f"(SELECT /*+ BROADCAST(t) */ s.manuscript_id, s.gram, s.n, s.chs, {parted} FROM {counted} s JOIN {totals} t ON t.manuscript_id = s.manuscript_id WHERE s.total_n * 10000.0 / t.total >= {rate})"
