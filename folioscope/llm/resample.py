"""Quality classifier by importance resampling of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
#: Labelled good documents whose n-grams make the target model; those with the least hash of their id.
TARGETS = 20_000
SEED = 17


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of words, and the row of each."""
    words = common.words_of(texts, common.BLANK_SPLIT_LOWER)
    hashes, rows = words.hashes(), common.rows_of(words.starts)
    pairs = np.flatnonzero(common.in_row(words.starts, 2))
    both = np.concatenate([common.mixed(hashes), common.grams(hashes, 2)[pairs] if len(pairs) else hashes[:0]])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[pairs]])


def _count(batches: Iterator[pa.RecordBatch], targets: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for part in common.slices(batches):
        which, rows = features(part.column("text"), buckets)
        raw += np.bincount(which, minlength=buckets)
        ids = part.column("doc_id").fill_null(-(1 << 62)).to_numpy()
        good += np.bincount(which[np.isin(ids, targets)[rows]], minlength=buckets)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(good)], names=["bucket", "raw", "good"])


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    task, at = TaskContext.get().partitionId(), 0
    for part in common.slices(batches):
        which, rows = features(part.column("text"), len(gain))
        n = np.bincount(rows, minlength=part.num_rows)
        weight = np.bincount(rows, weights=gain[which], minlength=part.num_rows).astype(float)  # of no n-grams it makes integers
        ids = part.column("doc_id").fill_null(-(1 << 62)).to_numpy().astype(np.uint64)
        uniform = ((common.mixed(ids + common.mixed(np.full(len(ids), seed + 1, np.uint64))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        rid = (task << 33) + at + np.arange(part.num_rows)
        at += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(rid), part.column("doc_id"), pa.array(n), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))], names=["rid", "doc_id", "n_grams", "log_ratio", "score"])


def _edge(scored: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest score, and how many rows with just that score belong to the first k.

    The interval that holds it is cut into 4096 parts again and again; only counts reach the driver.
    """
    low, high, above = *scored.agg(F.min("score"), F.max("score")).first(), 0
    while low < high:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        inside = scored.where(F.col("score").between(low, high))
        part = F.least(F.floor((F.col("score") - low) / width), F.lit(4095))
        counts = {r.part: (r.n, r.least, r.most) for r in inside.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).collect()}
        for p in sorted(counts, reverse=True):
            n, least, most = counts[p]
            if above + n >= k:
                low, high = least, most
                break
            above += n
    return high, k - above


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, targets: int = TARGETS, seed: int = SEED) -> DataFrame:
    """Draws documents like the good ones: weights by two hashed n-gram models, sample by Gumbel top-k.

    The target model counts words and word pairs of ``targets`` documents labelled good (all if there are
    fewer), the raw model those of all documents; both are smoothed by one count a bucket.  A document's
    log_ratio sums the models' log ratio over its n-grams; adding Gumbel noise (from its doc_id and ``seed``)
    and keeping the ``share`` of documents with the largest score draws without replacement.  ``share``
    defaults to the share of good documents among the labels.  Of equal scores at the edge
    (equal rows, but for chance) as many stay as there is room for.

    Null and blank texts have no n-grams and weigh 0; a null doc_id draws one common noise value; repeated
    rows are rows of their own; without a good label nothing sets documents apart and ``share`` is 1.
    Returns a row for each input row: doc_id, n_grams, log_ratio, score and kept.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = np.array([r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).collect()], np.int64)
    if share is None:
        share = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0] if len(ids) else 1.0
    chosen = spark.sparkContext.broadcast(ids)
    counts = picked.mapInArrow(lambda it: _count(it, chosen.value, buckets), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, aim = np.ones(buckets), np.ones(buckets)
    for r in counts:
        raw[r.bucket] += r.raw
        aim[r.bucket] += r.good
    gain = spark.sparkContext.broadcast(np.log(aim / aim.sum()) - np.log(raw / raw.sum()) if len(ids) else np.zeros(buckets))
    scored = common.stored(picked.mapInArrow(lambda it: _weigh(it, gain.value, seed), "rid long, doc_id long, n_grams long, log_ratio double, score double"))
    k = round(share * scored.count())
    if k <= 0:
        return scored.withColumn("kept", F.lit(False)).drop("rid")
    score, room = _edge(scored, k)
    # equal scores come from one doc_id's repeats or from rows without an id: the first in the stored table stay
    place, _ = _edge(scored.where(F.col("score") == score).select((-F.col("rid")).cast("double").alias("score")), room)
    kept = (F.col("score") > score) | ((F.col("score") == score) & (-F.col("rid") >= F.lit(place)))
    return scored.withColumn("kept", kept).drop("rid")
