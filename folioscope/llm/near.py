"""MinHash near-dedup with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, common

BANDS, ROWS, BATCH = 32, 5, 32
#: Probability with which a pair at the threshold may be pruned by its signatures.
MISS = 1e-7
#: Two-word shingles, as the operator's contract has them, for the pipeline's stage too: planted near copies that have passed
#: line dedup hardly share runs of five words (sf0.1: 166 documents go at two words, 5 at five).
SHINGLE, PER_CENT = 2, 80

_RNG = np.random.default_rng(20_240_229)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``k`` words; a shorter text is one run."""
    words = common.words_of(texts, common.BLANK_SPLIT_LOWER)
    hashes, starts = words.hashes(), words.starts
    every = common.grams(hashes, k)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(common.mixed(common.grams(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def least_matches(per_cent: int, miss: float, total: int, step: int) -> list[tuple[int, int]]:
    """(n, m): with fewer than m of the first n values equal, similarity at the threshold or above has a
    posterior probability under ``miss`` (uniform prior; that is a binomial sum)."""
    t, out = per_cent / 100, []
    for n in range(step, total + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def alike(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays may still be similar, compared batch after batch."""
    live, seen, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds:
        seen = seen + (a[live, done:n] == b[live, done:n]).sum(axis=1)
        passed = seen >= least
        live, seen, done = live[passed], seen[passed], n
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    task, at = TaskContext.get().partitionId(), 0
    for part in common.slices(batches):
        sets = shingle_sets(part.column("text"), k)
        size = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(size)
        values = np.concatenate([sets[i] for i in full]) if len(full) else np.empty(0, np.uint64)
        begin = np.cumsum(size[full]) - size[full]
        low = np.empty((len(full), BANDS * ROWS), np.uint64)
        for i in range(BANDS * ROWS if len(full) else 0):
            hashed = values * _MUL[i]
            hashed += _ADD[i]
            hashed >>= np.uint64(32)
            low[:, i] = np.minimum.reduceat(hashed, begin)
        banded = low.reshape(len(full), BANDS, ROWS)
        keys = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = common.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, r])
        keys = keys & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)  # the low bits name the band
        short = (low & np.uint64(0xFFFF)).astype("<u2")
        where = {int(r): i for i, r in enumerate(full)}
        n = part.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((task << 33) + at + np.arange(n)), part.column("doc_id"), pa.array(size),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([short[where[i]].tobytes() if i in where else None for i in range(n)], pa.binary()),
                pa.array([keys[where[i]].view(np.int64).tolist() if i in where else None for i in range(n)], pa.list_(pa.int64())),
                *(part.column(c) for c in part.schema.names[1:]),
            ],
            names=["rid", "doc_id", "n", "print", "signature", "bands", *part.schema.names[1:]],
        )
        at += n


def _matrix(column) -> np.ndarray:
    column = common.as_array(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return data[ends[0] : ends[-1]].view("<u2").reshape(len(column), BANDS * ROWS) if len(column) else np.empty((0, BANDS * ROWS), "<u2")


def _prune(batches: Iterator[pa.RecordBatch], bounds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = alike(_matrix(batch.column("left")), _matrix(batch.column("right")), bounds)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _confirm(batches: Iterator[pa.RecordBatch], k: int, per_cent: int) -> Iterator[pa.RecordBatch]:
    """Links that hold on the whole sets.  Rows with one a stand together, so its set is made once."""
    last, kept = None, None
    for batch in common.slices(batches, "right", 2 << 20):
        a = batch.column("a").to_numpy()
        opens = np.concatenate([[True], np.diff(a) != 0])
        if last is not None and len(a) and a[0] == last:
            opens[0] = False
        heads = shingle_sets(batch.column("left").filter(pa.array(opens)), k)
        ok, turn = [], -1
        for i, right in enumerate(shingle_sets(batch.column("right"), k)):
            if opens[i]:
                turn += 1
                kept = heads[turn]
            both = len(np.intersect1d(kept, right, assume_unique=True))
            ok.append(100 * both >= per_cent * (len(kept) + len(right) - both))
        last = a[-1] if len(a) else last
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _linked(inside: pa.Array, outside: pa.Array, bounds: list, k: int, per_cent: int) -> np.ndarray:
    """For each row outside the index of a row inside that it is linked with, or -1: signatures first, then whole sets."""
    member, guest = _matrix(inside.field("signature")), _matrix(outside.field("signature"))
    maybe = {i: hits for i in range(len(guest)) if len(hits := np.flatnonzero(alike(member, np.broadcast_to(guest[i], member.shape), bounds)))}
    out = np.full(len(guest), -1)
    if not maybe:
        return out
    rows = np.unique(np.concatenate(list(maybe.values())))
    sets = dict(zip(rows.tolist(), shingle_sets(inside.field("text").take(pa.array(rows)), k), strict=True))
    others = shingle_sets(outside.field("text").take(pa.array(list(maybe))), k)
    for (i, hits), other in zip(maybe.items(), others, strict=True):
        for j in hits.tolist():
            both = len(np.intersect1d(sets[j], other, assume_unique=True))
            if 100 * both >= per_cent * (len(sets[j]) + len(other) - both):
                out[i] = j
                break
    return out


def _judge(data: pa.Array, a: np.ndarray, b: np.ndarray, keys: np.ndarray, bounds: list, k: int, per_cent: int) -> np.ndarray:
    """Which pairs of a band's groups are linked: each pair in the first band key it shares, by signatures, then whole sets."""
    sign = _matrix(data.field("signature"))
    bands = data.field("bands").flatten().to_numpy().reshape(-1, BANDS)
    ok = np.zeros(len(a), bool)
    sets: dict[int, np.ndarray] = {}
    for low in range(0, len(a), 20_000):
        part = slice(low, low + 20_000)
        first = (bands[a[part]] == bands[b[part]]).argmax(axis=1) == (keys[part] & (BANDS - 1))
        ok[part] = first & alike(sign[a[part]], sign[b[part]], bounds)
    live = np.flatnonzero(ok)
    wanted = np.unique(np.concatenate([a[live], b[live]]))
    sets.update(zip(wanted.tolist(), shingle_sets(data.field("text").take(pa.array(wanted)), k) if len(wanted) else [], strict=True))
    for i in live.tolist():
        x, y = sets[int(a[i])], sets[int(b[i])]
        if 100 * min(len(x), len(y)) < per_cent * max(len(x), len(y)):
            ok[i] = False
            continue
        shared = len(np.intersect1d(x, y, assume_unique=True))
        ok[i] = 100 * shared >= per_cent * (len(x) + len(y) - shared)
    return ok


def _signed(docs: DataFrame, k: int, whole: bool) -> DataFrame:
    """The stored table of all rows: a row number, the set's size and fingerprint, the signature and its bands, the text."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([common.rest_of(docs)] if whole else []))
    columns = "rid long, doc_id long, n long, print binary, signature binary, bands array<long>, text string"
    return common.stored(picked.mapInArrow(lambda it: _signatures(it, k), common.with_rest(columns, docs) if whole else columns))


def near_groups(docs: DataFrame, k: int = SHINGLE, per_cent: int = PER_CENT, miss: float = MISS) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``per_cent`` or more on word shingles.

    Words are lower-cased (A-Z) runs of anything but space and U+0009-U+000D.  Documents with equal sets
    are one class from the start.  Signatures fall into bands; pairs that share a band are compared batch
    by batch of signature values and given up as soon as the posterior probability of reaching the
    threshold is under ``miss``; what is left is confirmed on the whole sets (see ``cluster`` for how pairs
    of a large band are covered).  With 32 bands of 5 a pair at 0.8 shares none with probability 3e-6.

    A null or blank text has no shingle and is linked with nothing.  Rows with one doc_id are rows of their
    own.  A null doc_id is linked with nothing and kept, its component null.  Returns a row for each input
    row: doc_id, n_shingles, component_id and kept.
    """
    return _grouped(_signed(docs, k, False), k, per_cent, miss).drop("rid", "comp")


def _grouped(table: DataFrame, k: int, per_cent: int, miss: float) -> DataFrame:
    """The rows of :func:`near_groups` with their ``rid`` and ``comp``, which tells groups with one lowest doc_id apart and
    is null without shingles."""
    bounds = least_matches(per_cent, miss, BANDS * ROWS, BATCH)
    classes = common.stored(table.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("rid").alias("id"), F.min("doc_id").alias("low")))
    firsts = table.join(classes.select(F.col("id").alias("rid")), "rid", "left_semi")
    live = cluster.shared_keys(firsts.select(F.explode("bands").alias("key"), F.col("rid").alias("id")))
    ids = live.select(F.col("id").alias("rid")).distinct()
    signed = common.stored(table.join(ids, "rid", "left_semi").select(F.col("rid").alias("id"), "signature", "bands", "text"))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        right = pairs.join(signed.select(F.col("id").alias("b"), F.col(column).alias("right")), "b")
        return right.join(signed.select(F.col("id").alias("a"), F.col(column).alias("left")), "a").select("a", "b", "left", "right")

    stars = beside(cluster.star_pairs(live), "signature").mapInArrow(lambda it: _prune(it, bounds), "a long, b long")
    links = common.stored(beside(stars, "text").mapInArrow(lambda it: _confirm(it, k, per_cent), "a long, b long"))
    comps = cluster.components(links)
    placed = common.stored(cluster.placed_ids(live, comps))
    judge = lambda data, a, b, keys: _judge(data, a, b, keys, bounds, k, per_cent)
    linked = lambda inside, outside: _linked(inside, outside, bounds, k, per_cent)
    across = cluster.cross_pairs(placed.where(F.col("size") < cluster.LARGE), signed.select("id", F.struct("signature", "bands", "text").alias("payload")), judge)
    joined = cluster.large_links(placed, comps, signed.select("id", F.struct("signature", "text").alias("payload")), linked)
    comps = cluster.components(common.stored(links.union(across).union(joined).distinct()))
    # the lowest doc_id of each component; classes without a link are their own
    lowest = comps.join(classes, "id").groupBy("comp").agg(F.min("low").alias("component"))
    named = classes.join(cluster.spread_join(comps, lowest, "comp"), "id", "left").select("print", F.coalesce("comp", "id").alias("comp"), F.coalesce("component", "low").alias("component"))
    rows = table.select("rid", "doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("print")).alias("print"))
    out = rows.where("print is not null").join(named, "print").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "comp")
    alone = rows.where("print is null").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("comp"))
    return out.union(alone)


def keep_one(docs: DataFrame, k: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """One document of each group of :func:`near_groups`, the one with the smallest doc_id, in the columns of ``docs``.

    Rows that share the kept doc_id and group are all kept only if their doc_id is null; otherwise one stays, of unlike
    texts the one with the least hash.  Rows with one doc_id in several groups stay for each; those without a word count
    as one group.
    """
    table = _signed(docs, k, True)
    groups = _grouped(table, k, per_cent, MISS).where("kept and doc_id is not null")
    marks = table.select("rid", F.xxhash64("text").alias("mark"))
    stay = groups.select("rid", "doc_id", "comp").join(marks, "rid").groupBy("doc_id", "comp").agg(F.min(F.struct("mark", "rid")).alias("first"))
    kept = table.join(stay.select(F.col("first.rid").alias("rid")), "rid", "left_semi").unionByName(table.where("doc_id is null"))
    return common.unpacked(kept, docs, text=F.col("text"))
