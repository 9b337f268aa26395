"""Benchmark decontamination: winnowed fingerprints of documents and benchmark items joined by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 10, 5
#: Places of the table of bits by which documents leave out what no item can hold; 2 MB, whatever the benchmark's size.
#: A larger benchmark lets more through to the join, which decides.
BITS = 1 << 24


def chosen(hashes: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of ``span`` words and its fingerprint, the least hash of the window's grams.

    Neighbouring windows mostly share their fingerprint, and windows of equal words always do.
    """
    at = np.flatnonzero(common.in_row(starts, span))
    least = common.window_min(common.grams(hashes, gram), span - gram + 1)
    return at, least[at] if len(at) else np.empty(0, np.uint64)


def _short(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``n`` words, for items that have no more."""
    at = np.flatnonzero(common.in_row(starts, n))
    return at, common.grams(hashes, n)[at] + np.uint64(n) if len(at) else np.empty(0, np.uint64)


def _said(words: common.Words, at: np.ndarray, n: int) -> pa.Array:
    """The ``n`` words from each place on, joined by one space."""
    if not len(at):
        return pa.array([], pa.string())
    flat = words.vocab.take(pa.array(words.codes[(at[:, None] + np.arange(n)).ravel()])).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * n + 1, n, dtype=np.int32)), flat)
    return pa.compute.binary_join(lists, " ")


_ITEM = "print long, words string, size int, item_id string"


def _item_windows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of benchmark items; an item of fewer words is one window."""
    for part in common.slices(batches):
        words = common.words_of(part.column("text"), common.ALNUM_SPLIT)
        hashes, size, rows = words.hashes(), np.diff(words.starts), common.rows_of(words.starts)
        found = [(*chosen(hashes, words.starts, span, gram), span)]
        for n in sorted({int(x) for x in size if 0 < x < span}):
            at, print_ = _short(hashes, words.starts, n)
            whole = size[rows[at]] == n
            found.append((at[whole], print_[whole], n))
        for at, print_, n in found:
            yield pa.RecordBatch.from_arrays([pa.array(print_.view(np.int64)), _said(words, at, n), pa.array(np.full(len(at), n, np.int32)), part.column("item_id").take(pa.array(rows[at]))], names=["print", "words", "size", "item_id"])


_SCANNED = "rid long, doc_id long, n_words long, print long, words string, size int, at array<int>"


def _scan(batches: Iterator[pa.RecordBatch], bits: np.ndarray, sizes: list[int], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the windows that may stand in an item, equal short ones of a document in one row."""
    task, seen = TaskContext.get().partitionId(), 0
    for part in common.slices(batches):
        words = common.words_of(part.column("text"), common.ALNUM_SPLIT)
        hashes, rows, n = words.hashes(), common.rows_of(words.starts), part.num_rows
        rid = (task << 33) + seen + np.arange(n)
        seen += n
        more = part.schema.names[1:]  # text and rest, where they are asked for
        blank = lambda kind, size: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays([pa.array(rid), part.column("doc_id"), pa.array(np.diff(words.starts)), blank(pa.int64(), n), blank(pa.string(), n), blank(pa.int32(), n), blank(pa.list_(pa.int32()), n), *(part.column(c) for c in more)], names=[*_names(), *more])
        for size in sizes:
            at, prints = chosen(hashes, words.starts, span, gram) if size == span else _short(hashes, words.starts, size)
            slot = prints % np.uint64(BITS)
            maybe = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool) if len(at) else np.empty(0, bool)
            at, prints = at[maybe], prints[maybe]
            if not len(at):
                continue
            key = np.column_stack([rows[at], *(words.codes[at + j] for j in range(size))])
            order = np.lexsort(key.T[::-1])
            opens = np.concatenate([[True], (np.diff(key[order], axis=0) != 0).any(axis=1)])
            first = at[order][opens]
            places = (at - words.starts[rows[at]])[order].astype(np.int32)
            m = len(first)
            spots = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(opens), len(at)).astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([pa.array(rid[rows[first]]), blank(pa.int64(), m), blank(pa.int64(), m), pa.array(prints[order][opens].view(np.int64)), _said(words, first, size), pa.array(np.full(m, size, np.int32)), spots, *(blank(part.column(c).type, m) for c in more)], names=[*_names(), *more])


def _names() -> list[str]:
    return [c.split()[0] for c in _SCANNED.split(", ")]


def _covered(spans: Column) -> Column:
    """Number of places that (start, size) spans cover, overlaps counted once."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["past"], s["start"] + s["size"]).alias("past"),
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["past"], s["start"]))).cast("long").alias("n"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("past"), F.lit(0).cast("long").alias("n")), step)["n"]


def _judged(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored scan, what each hit document holds (rid, n_hit, wids), and the items of the windows (wid, item_id)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    told = common.stored(items.mapInArrow(lambda it: _item_windows(it, span, gram), _ITEM).distinct())
    windows = common.stored(told.groupBy("print", "words", "size").agg(F.count("item_id").alias("n")).withColumn("wid", F.monotonically_increasing_id()))
    sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]
    # longs are signed, but BITS is a power of two, so pmod gives the unsigned place
    slots = windows.selectExpr(f"pmod(print, {BITS}) AS slot").selectExpr("CAST(slot DIV 64 AS INT) AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
    words_of_bits = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(BITS // 64, np.int64)
    table[words_of_bits["word"].to_numpy(np.int64)] = words_of_bits["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([common.rest_of(docs)] if whole else []))
    columns = common.with_rest(f"{_SCANNED}, text string", docs) if whole else _SCANNED
    names = [*_names(), *(["text", "rest"] if whole else [])]

    def scan(it):
        for batch in _scan(it, shared.value, sizes, span, gram):
            yield batch.select(names)

    scanned = common.stored(picked.mapInArrow(scan, columns))
    hits = scanned.where("size is not null").select("rid", "print", "words", "size", "at").join(windows.select("print", "words", "size", "wid"), ["print", "words", "size"])
    each = hits.select("rid", "wid", F.transform("at", lambda p: F.struct(p.alias("start"), F.col("size").alias("size"))).alias("spans"))
    held = each.groupBy("rid").agg(_covered(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.sort_array(F.collect_set("wid")).alias("wids"))
    named = told.where("item_id is not null").join(windows.select("print", "words", "size", "wid"), ["print", "words", "size"]).select("wid", "item_id")
    return scanned, held, named


def find(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Words of documents inside a run of ``span`` words that a benchmark item holds too.

    Words are lower-cased runs of letters, digits and characters beyond ASCII.  By winnowing, the least hash of
    the ``span - gram + 1`` grams in a window is its fingerprint on either side, so any shared run of ``span``
    words shares fingerprints.  Spark joins documents' and items' fingerprints, and with them the words of the
    windows, which a shared fingerprint is extended to: equal hashes alone are no hit.  The distinct windows
    of the benchmark stand on one side, so a fingerprint or passage that many items and documents share makes
    no pairs.  Documents' windows that no item's fingerprint can match stay out of the join by a table of
    ``BITS`` bits.  Documents with the same windows have the same items, which are gathered once for all of them.

    An item of fewer words, but not none, is one window of its own.  Null texts have no words; an item without
    an id hits but is not named; repeated items count once; an empty benchmark hits nothing; repeated rows are
    rows of their own.  Returns a row for each input row: doc_id (null stays null), n_words, n_hit, n_items,
    items_sha256, contaminated and items.
    """
    scanned, held, named = _judged(docs, benchmark, span, gram, False)
    held = common.stored(held)
    sets = held.select("wids").distinct()
    items = sets.select("wids", F.explode("wids").alias("wid")).join(named, "wid").groupBy("wids").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    known = held.join(items, "wids", "left").select("rid", "n_hit", "items")
    rows = scanned.where("size is null").select("rid", "doc_id", "n_words").join(known, "rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), items.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Documents without any hit of :func:`find`, in the columns of ``docs``."""
    scanned, held, _ = _judged(docs, benchmark, span, gram, True)
    return common.unpacked(scanned.where("size is null").join(held.select("rid"), "rid", "left_anti"), docs, text=F.col("text"))
