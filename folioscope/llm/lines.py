"""Line dedup: lines within a small edit distance of an earlier line go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, cluster, common

THRESHOLD = 2
#: Code points from which edits count; shorter lines repeat by equality alone.  In sf0.1 the pairs of 10 to 14 code points
#: within two edits are mostly other words ('Ingth the.', 'Ingon the.'), those from 16 mostly one line with another comma.
EDIT_CHARS = 15
#: What parts words; a line of nothing else is blank.
BLANKS = " \t\n\v\f\r"


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` at most.

    Common ends are cut off; the rest runs through a bit-parallel band of ``2 * most + 1`` diagonals: bit
    ``d`` of the state for ``e`` edits tells that diagonal ``d`` has been followed as far as column ``j``.
    """
    if abs(len(a) - len(b)) > most:
        return False
    p, n = 0, min(len(a), len(b))
    while p < n and a[p : p + 64] == b[p : p + 64]:
        p += 64
    p = min(p, n)
    while p < n and a[p] == b[p]:
        p += 1
    a, b, n = a[p:], b[p:], n - p
    s = 0
    while s < n and a[-1 - s] == b[-1 - s]:
        s += 1
    a, b = a[: len(a) - s], b[: len(b) - s]
    if not a or not b:
        return len(a) + len(b) <= most
    width = 2 * most + 1
    mask = (1 << width) - 1
    # where each character stands in a, and which rows there are, both shifted so that bit 0 is the band's lowest row at j = 0
    stands: dict[str, int] = {}
    for i, c in enumerate(a):
        stands[c] = stands.get(c, 0) | 1 << i + most
    rows = ((1 << len(a) + 1) - 1) << most >> 1
    # states[e]: diagonals (row of a minus place in b, shifted by most) reachable with e edits
    states = [((1 << (e + 1)) - 1) << most & mask for e in range(most + 1)]
    for j, c in enumerate(b):
        equal, real = stands.get(c, 0) >> j & mask, rows >> j & mask
        fresh: list[int] = []
        for e, now in enumerate(states):
            here = now & equal
            if e:
                here |= states[e - 1]  # replaced
                here |= states[e - 1] >> 1  # the character of b is extra: one row less ahead
                here |= fresh[e - 1] << 1  # the character of a is extra
            fresh.append(here & real)
        # rows move on with the place in b, so a diagonal keeps its bit
        states = fresh
        if not states[-1]:
            return False
    goal = len(a) - len(b) + most
    return any(x >> goal & 1 for x in states)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of nearly equal parts, longer ones last."""
    base, longer = divmod(length, parts)
    sizes = [base + (i >= parts - longer) for i in range(parts)]
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


_PLANS: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}


def probes(length: int, most: int) -> list[tuple[int, int, bytes]]:
    """(start, end, tag) of the substrings by which a line of ``length`` meets any line within ``most`` edits.

    Of ``most + 1`` segments of the shorter line one at least stands unedited in the longer one, near its
    own place (within the shifts that the edits left and right of it allow).  The tag names the shorter line's length and
    the segment.  A line's own segments come first.
    """
    if (length, most) not in _PLANS:
        out = []
        for shorter in range(length, max(most, length - most - 1), -1):
            gap = length - shorter
            for i, (start, size) in enumerate(segments(shorter, most + 1)):
                low = max(0, start - i, start + gap - (most - i))
                high = min(length - size, start + i, start + gap + (most - i))
                out += [(p, p + size, b"%d.%d|" % (shorter, i)) for p in sorted(range(low, high + 1), key=lambda p, s=start: p != s)]
        _PLANS[length, most] = out
    return _PLANS[length, most]


def eligible(text: str) -> list[tuple[int, str]]:
    """Number and text of the lines that may be repeats: all with a word."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if line.strip(BLANKS)]


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _keys(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for _, docs in blocks.bodies(batches):
        distinct = {line for text in docs.column("text").to_pylist() if text for _, line in eligible(text) if len(line) >= least}
        keys, ids, counts = [], [], []
        for line in distinct:
            plan = probes(len(line), most)
            keys += [digest(tag + line[a:b].encode()) for a, b, tag in plan]
            ids.append(line_id(line))
            counts.append(len(plan))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), counts))], names=["key", "id"])


_PLACES = "id long, block long, doc_id long, doc int, line int, spots array<struct<doc:int,line:int>>"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each line with a word stands: one row for a block and line, with the first place and all places."""
    spot = pa.struct([("doc", pa.int32()), ("line", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("doc", pa.int32()), ("line", pa.int32()), ("spots", pa.list_(spot))])
    for block, docs in blocks.bodies(batches):
        names = docs.column("doc_id").to_pylist()
        found: dict[int, list[tuple[int, int]]] = {}
        for d, text in enumerate(docs.column("text").to_pylist()):
            for i, line in eligible(text or ""):
                found.setdefault(line_id(line), []).append((d, i))
        first = [min(x, key=lambda p: (names[p[0]] is not None, names[p[0]] or 0, p)) for x in found.values()]
        counts = np.array([len(x) for x in found.values()], np.int64)
        flat = np.array([p for x in found.values() for p in x], np.int32).reshape(-1, 2)
        spots = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(spot)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array([names[d] for d, _ in first], pa.int64()), pa.array([d for d, _ in first], pa.int32()), pa.array([i for _, i in first], pa.int32()), spots], schema=schema)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, docs, picks in blocks.bodies(batches, "picks"):
        texts = docs.column("text")
        split: dict[int, list[str]] = {}
        out = []
        for p in sorted(picks, key=lambda p: p["doc"]):
            if p["doc"] not in split:
                split = {p["doc"]: texts[p["doc"]].as_py().split("\n")}
            out.append(split[p["doc"]][p["line"]])
        yield pa.RecordBatch.from_arrays([pa.array([p["id"] for p in sorted(picks, key=lambda p: p["doc"])], pa.int64()), pa.array(out, pa.string())], names=["id", "text"])


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within(a, b, most) for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, docs, gone in blocks.bodies(batches, "gone"):
        lost: dict[int, set] = {}
        for g in gone or ():
            lost.setdefault(g["doc"], set()).add(g["line"])
        out: dict[str, list] = {"doc_id": docs.column("doc_id").to_pylist(), "n_lines": [], "n_eligible": [], "n_removed": [], "kept_sha256": [], "emptied": [], "kept_text": []}
        for d, text in enumerate(docs.column("text").to_pylist()):
            mine = lost.get(d, set())
            able = eligible(text or "")
            lines = (text or "").split("\n")
            left = "\n".join(x for i, x in enumerate(lines) if i not in mine) if mine else text
            out["n_lines"].append(sum(bool(x.strip(BLANKS)) for x in lines))
            out["n_eligible"].append(len(able))
            out["n_removed"].append(len(mine))
            out["kept_sha256"].append(hashlib.sha256((left or "").encode()).hexdigest())
            out["emptied"].append(bool(mine) and not left.strip(BLANKS))
            out["kept_text"].append(left)
        made = pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_eligible", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("emptied", pa.bool_()), ("kept_text", pa.string())]))
        yield made.append_column("rest", docs.column("rest")) if "rest" in docs.schema.names else made


ROWS = "doc_id long, n_lines long, n_eligible long, n_removed long, kept_sha256 string, emptied boolean, kept_text string"


def dedup_lines(docs: DataFrame, most: int = THRESHOLD, least: int = EDIT_CHARS, whole: bool = False) -> DataFrame:
    r"""Removes lines that equal an earlier line or are linked with one by edit distances up to ``most``.

    Lines are what ``\n`` separates; all with a word (anything but space and U+0009-U+000D) take part.  Lines of under ``least`` code points are
    linked by equality only, as two edits make another line of them; two of ``least`` or more by edit
    distance.  Lines linked directly or through others are one class, and its first line in the
    order of (doc_id, place) stays; a null doc_id comes first.  Links are found by segments: ``most + 1``
    parts of a line, met by the longer line's substrings of the same length near the same place, then
    verified by a bit-parallel banded edit distance.  Lines are told apart by a 64-bit hash.

    A null text has no lines and stays null.  Repeated rows are documents of their own.  Returns a row for
    each input row: doc_id, n_lines (with a word), n_eligible, n_removed, kept_sha256, emptied (lines
    went and none with a word is left) and kept_text, and the other columns as ``rest`` if ``whole``.
    """
    table = blocks.build(docs, whole)
    places = common.stored(table.mapInArrow(_places, _PLACES))
    live = cluster.shared_keys(table.mapInArrow(lambda it: _keys(it, most, least), "key long, id long"))
    where = places.join(live.select("id").distinct(), "id").groupBy("id").agg(F.min(F.struct("block", "doc", "line")).alias("p"))
    picks = where.select("p.block", F.struct("id", "p.doc", "p.line").alias("p")).groupBy("block").agg(F.collect_list("p").alias("picks"))
    texts = common.stored(table.join(picks, "block").mapInArrow(_pick, "id long, text string"))
    pairs = cluster.star_pairs(live)
    beside = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    links = common.stored(beside.select("a", "b", "left", "right").mapInArrow(lambda it: _linked(it, most), "a long, b long"))
    comps = cluster.components(links)
    judge = lambda data, a, b, _=None: np.array([within(x, y, most) for x, y in zip(data.take(pa.array(a)).to_pylist(), data.take(pa.array(b)).to_pylist(), strict=True)], bool)
    across = common.stored(cluster.cross_pairs(cluster.placed_ids(live, comps), texts.select("id", F.col("text").alias("payload")), judge))
    if not across.isEmpty():
        comps = cluster.components(links.union(across))
    spot = F.struct("doc_id", "block", "doc", "line")
    lines = common.stored(places.groupBy("id").agg(F.min(spot).alias("first"), F.sum(F.size("spots")).alias("n")))
    linked = lines.join(comps, "id")
    facts = linked.groupBy("comp").agg(F.min("first").alias("first"))
    repeated = cluster.spread_join(linked.select("id", "comp"), facts, "comp").select("id", "first")
    repeated = repeated.union(lines.where("n > 1").join(comps, "id", "left_anti").select("id", "first"))
    here = F.col("first.block") == F.col("block")
    others = F.filter("spots", lambda s: ~(here & (s["doc"] == F.col("first.doc")) & (s["line"] == F.col("first.line"))))
    gone = places.join(repeated, "id").select("block", others.alias("gone")).where(F.size("gone") > 0).groupBy("block").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    return table.join(gone, "block", "left").mapInArrow(_rewrite, common.with_rest(ROWS, docs) if whole else ROWS)


def strip_lines(docs: DataFrame, most: int = THRESHOLD, least: int = EDIT_CHARS) -> DataFrame:
    """Documents without the lines that :func:`dedup_lines` removes, in the columns of ``docs``.

    A document that loses lines and has none with a word left goes as a whole.  ``n_chars`` follows the text where the table
    has it; all other columns pass unchanged.
    """
    rows = dedup_lines(docs, most, least, whole=True).where("not emptied")
    return common.unpacked(rows, docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))
