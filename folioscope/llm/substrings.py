"""Substring dedup: repeated runs of words found through super-k-mer buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common

WINDOW, MINIMISER = 35, 8
#: Places of a minimiser from which its windows travel singly, dealt by their own hash.
HOT = 20_000
#: Packed bytes sorted at once in a bucket's task.
CHUNK_BYTES = 4 << 20


def super_kmers(hashes: np.ndarray, starts: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of consecutive windows with one minimiser."""
    fits = common.in_row(starts, window)
    least = common.window_min(common.grams(hashes, m), window - m + 1)
    opens = fits.copy()
    opens[1:] &= ~(fits[:-1] & (least[1:] == least[:-1]))
    first = np.flatnonzero(opens)
    counts = np.bincount(np.cumsum(opens)[fits] - 1, minlength=len(first)) if len(first) else first
    return first, counts, least[first]


def _light(batches: Iterator[pa.RecordBatch], window: int, m: int) -> Iterator[pa.RecordBatch]:
    """How often each minimiser of a block stands in it: equal windows hold it at different places."""
    for block, docs in blocks.bodies(batches):
        words = common.words_of(docs.column("text"), common.BLANK_SPLIT)
        hashes = words.hashes()
        keys = np.unique(super_kmers(hashes, words.starts, window, m)[2])
        if not len(keys):
            continue
        every = common.grams(hashes, m)[common.in_row(words.starts, m)]
        at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
        times = np.bincount(at[keys[at] == every], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), block)), pa.array(times.astype(np.int64))], names=["minimiser", "block", "times"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, m: int) -> Iterator[pa.RecordBatch]:
    for block, docs, wanted, hot in blocks.bodies(batches, "wanted", "hot"):
        if not wanted:
            continue
        words = common.words_of(docs.column("text"), common.BLANK_SPLIT)
        hashes, rows = words.hashes(), common.rows_of(words.starts)
        first, count, least = super_kmers(hashes, words.starts, window, m)
        picked = np.isin(least, np.array(wanted, np.int64).view(np.uint64))
        first, count, least = first[picked], count[picked], least[picked]
        salt = np.zeros(len(first), np.uint64)
        if hot:  # single windows
            single = np.isin(least, np.array(hot, np.int64).view(np.uint64))
            at = np.repeat(first[single], count[single]) + _within(count[single])
            whole = common.grams(hashes, window)[at] | np.uint64(1)
            first, count, least, salt = (np.concatenate(x) for x in ((first[~single], at), (count[~single], np.ones(len(at), count.dtype)), (least[~single], np.repeat(least[single], count[single])), (salt[~single], whole)))
        vocab, codes = words.vocab.to_pylist(), words.codes
        found: dict[tuple, list] = {}
        for p, n, key, s in zip(first.tolist(), count.tolist(), least.view(np.int64).tolist(), salt.view(np.int64).tolist(), strict=True):
            text = b" ".join([vocab[c] for c in codes[p : p + n + window - 1].tolist()])
            found.setdefault((key, s, text), []).append(p)
        items = list(found.items())
        for i in range(0, len(items), 20_000):
            part = items[i : i + 20_000]
            places = [np.array(v) for _, v in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([k[2] for k, _ in part], pa.binary()).cast(pa.string()), pa.array([block] * len(part), pa.int64()), pa.array([rows[p].tolist() for p in places], pa.list_(pa.int32())), pa.array([(p - words.starts[rows[p]]).tolist() for p in places], pa.list_(pa.int32()))],
                names=["minimiser", "salt", "packed", "block", "docs", "starts"],
            )


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``counts``."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _repeated(packed: pa.Array, weight: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and length of the runs of windows that start twice or more among whole buckets."""
    words = common.words_of(packed, common.BLANK_SPLIT)
    fits = np.flatnonzero(common.in_row(words.starts, window))
    rows = common.rows_of(words.starts)
    codes = words.codes.astype(np.uint64) + np.uint64(1)
    order = np.argsort(common.grams(codes, window)[fits], kind="stable")
    at = fits[order]
    same = np.ones(max(0, len(at) - 1), bool)
    for j in range(window):  # equal hashes are told apart by the words themselves
        same &= words.codes[at[:-1] + j] == words.codes[at[1:] + j]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(at) else np.empty(0, np.int64)
    total = np.bincount(group, weights=weight[rows[at]]) if len(at) else group
    twice = np.sort(at[total[group] >= 2]) if len(at) else at
    breaks = np.flatnonzero(np.concatenate([[True], (np.diff(twice) > 1) | (np.diff(rows[twice]) > 0)])) if len(twice) else twice
    lengths = np.diff(np.append(breaks, len(twice)))
    begin = twice[breaks]
    return rows[begin], begin - words.starts[rows[begin]], lengths


_RUNS = ["block", "doc", "start", "windows"]


def _spread(part: pa.RecordBatch, row: np.ndarray, offset: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Runs for every place that the packed string came from."""
    docs, starts = part.column("docs").to_pylist(), part.column("starts").to_pylist()
    block = part.column("block").to_numpy()
    n = np.array([len(docs[r]) for r in row.tolist()], np.int64)
    flat = lambda lists, kind: np.array([x for r in row.tolist() for x in lists[r]], kind)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(block[row], n)), pa.array(flat(docs, np.int32)), pa.array(flat(starts, np.int32) + np.repeat(offset, n).astype(np.int32)), pa.array(np.repeat(length, n).astype(np.int32))], names=_RUNS)


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Buckets arrive one after another; whole buckets are counted some megabytes at a time."""
    held: list[pa.RecordBatch] = []
    limit = CHUNK_BYTES
    current, seen = None, {}
    for batch in batches:
        salts = batch.column("salt").to_numpy()
        held.append(batch.filter(pa.array(salts == 0)))
        if sum(x.nbytes for x in held) >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("minimiser").to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left"))  # the last bucket waits for the rest of it
            yield from _flush(table.slice(0, last).to_batches(), window)
            held = table.slice(last).to_batches()
            limit = CHUNK_BYTES if last else 2 * limit
        for i in np.flatnonzero(salts != 0).tolist():  # one window each: the first waits for an equal one
            row = batch.slice(i, 1)
            key = (row.column("minimiser")[0].as_py(), row.column("salt")[0].as_py())
            if current != key:
                current, seen = key, {}
            text = row.column("packed")[0].as_py()
            if text not in seen and len(row.column("docs")[0]) == 1:
                seen[text] = row
                continue
            first, seen[text] = seen.get(text), None
            for x in (first, row):
                if x is not None:
                    yield _spread(x, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    yield from _flush(held, window)


def _flush(held: list[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    if held and sum(x.num_rows for x in held):
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        weight = np.array([len(x) for x in part.column("docs").to_pylist()])
        yield _spread(part, *_repeated(part.column("packed"), weight, window))


def _remove(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for _, docs, runs in blocks.bodies(batches, "runs"):
        words = common.words_of(docs.column("text"), common.BLANK_SPLIT)
        edge = np.zeros(len(words.codes) + 1, np.int64)
        if runs:
            doc, start, count = (np.array([r[k] for r in runs], np.int64) for k in _RUNS[1:])
            begin = words.starts[doc] + start
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + count + window - 1, -1)
        gone = np.cumsum(edge)[:-1] > 0
        vocab = words.vocab.to_pylist()
        out: dict[str, list] = {"doc_id": docs.column("doc_id").to_pylist(), "n_words": np.diff(words.starts).tolist(), "n_removed": [], "kept_sha256": [], "kept_text": []}
        for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
            lost, codes = gone[a:b], words.codes[a:b]
            kept = b" ".join([vocab[c] for c in (codes[~lost] if lost.any() else codes).tolist()])
            out["n_removed"].append(int(lost.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode() if texts else None)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, hot: int = HOT, texts: bool = True) -> DataFrame:
    """Removes every word that a window of ``window`` words covers whose word sequence also starts elsewhere.

    Words are runs of anything but space and U+0009-U+000D.  Windows lie in one document and are judged on
    the input.  A null or blank text, and one shorter than a window, loses nothing; repeated rows are
    documents of their own, so each of them loses every window.  Returns one row for each input row, with
    doc_id (null stays null), n_words, n_removed, kept_sha256 and kept_text (null unless ``texts``).

    Minimisers are counted first (a number for each block and minimiser), and only super-k-mers of a
    minimiser that stands in two or more places travel.  Those of a minimiser with ``hot`` places or more are
    split into single windows, dealt by their hash, after equal ones in a block became one row.
    """
    table = blocks.build(docs)
    light = common.stored(table.mapInArrow(lambda it: _light(it, window, m), "minimiser long, block long, times long"), "none")
    total = light.groupBy("minimiser").agg(F.sum("times").alias("n")).where("n > 1")
    wanted = light.join(total, "minimiser").groupBy("block").agg(F.collect_list("minimiser").alias("wanted"), F.collect_list(F.when(F.col("n") >= hot, F.col("minimiser"))).alias("hot"))
    packed = table.join(wanted, "block").mapInArrow(lambda it: _cut(it, window, m), "minimiser long, salt long, packed string, block long, docs array<int>, starts array<int>")
    runs = packed.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt").mapInArrow(lambda it: _count(it, window), "block long, doc int, start int, windows int")
    placed = runs.groupBy("block").agg(F.collect_list(F.struct("doc", "start", "windows")).alias("runs"))
    return table.join(placed, "block", "left").mapInArrow(lambda it: _remove(it, window, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
