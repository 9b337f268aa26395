"""Centroid clustering: Lloyd's rounds in whole numbers, with nothing but sums of centroids coming back to the driver."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Sums travel as digits of this many bits, so that partial sums of any size add up in longs.
DIGIT_BITS = 40
_MOST = (1 << 63) - 1


def _safe(width: int) -> int:
    """Size of components up to which squared distances fit a long; larger ones are reckoned in Python's integers."""
    return math.isqrt((1 << 62) // width) // 2


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each double: as longs where all are small, else as Python integers."""
    if not len(values) or np.abs(values).max() * scale <= _safe(values.shape[1]):
        return np.floor(values * scale).astype(np.int64)
    exact = lambda x: int(np.floor(x * scale)) if abs(x) < 2.0**52 else int(x) * scale
    return np.array([[exact(x) for x in row] for row in values.tolist()], object)


def nearest(vectors: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one among equals, and the squared distance from it."""
    safe = vectors.dtype != object and max((abs(x) for c in centres for x in c), default=0) <= _safe(vectors.shape[1])
    kind = np.int64 if safe else object
    rows = vectors.astype(kind)
    best, which = None, np.zeros(len(rows), np.int64)
    for number, centre in enumerate(centres):
        apart = rows - np.array(centre, kind)
        distance = (apart * apart).sum(axis=1)
        if best is None:
            best = distance
        else:
            nearer = (distance < best).astype(bool)
            best, which = np.where(nearer, distance, best), np.where(nearer, number, which)
    return which, best


def _digits(total: int) -> Iterator[tuple[int, int]]:
    """Signed digits of a whole number that are not zero, with their places."""
    sign, rest, place = (-1 if total < 0 else 1), abs(int(total)), 0
    while rest:
        rest, digit = rest >> DIGIT_BITS, rest & ((1 << DIGIT_BITS) - 1)
        if digit:
            yield place, sign * digit
        place += 1


def _sums(batches: Iterator[pd.DataFrame], centres: list[list[int]], scale: int) -> Iterator[pd.DataFrame]:
    """One task's sums: a row for each cluster that it met and each digit of the sums."""
    width, counts, totals = len(centres[0]), {}, {}
    for batch in batches:
        if batch.empty:
            continue
        vectors = whole(np.stack(batch["vector"]), scale)
        which, _ = nearest(vectors, centres)
        for cluster in np.unique(which).tolist():
            mine = vectors[which == cluster]
            counts[cluster] = counts.get(cluster, 0) + len(mine)
            totals[cluster] = [a + int(b) for a, b in zip(totals.get(cluster, [0] * width), mine.sum(axis=0), strict=True)]
    rows = []
    for cluster, total in totals.items():
        digits: dict[int, list[int]] = {0: [0] * width}
        for at, value in enumerate(total):
            for place, digit in _digits(value):
                digits.setdefault(place, [0] * width)[at] = digit
        rows += [[cluster, place, counts[cluster] if place == 0 else 0, *found] for place, found in digits.items()]
    yield pd.DataFrame(rows, columns=["cluster", "place", "members", *(f"s{i}" for i in range(width))])


def _long(total) -> int | None:
    return int(total) if total is not None and total <= _MOST else None


def _assigned(batches: Iterator[pd.DataFrame], centres: list[list[int]], scale: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if batch.empty:
            continue
        which, distance = nearest(whole(np.stack(batch["vector"]), scale), centres)
        fits = [_long(d) for d in distance.tolist()]
        yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": which.astype(np.int32), "distance": pd.array(fits, "Int64")})


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """Plain Lloyd over ``vec_id`` and ``embedding``, in whole numbers ``floor(scale * x)``.

    Vectors with ``width`` components, none null or not finite, take part; the others have no row.  The first centroids
    are the ``clusters`` vectors with the least sha256 of ``salt`` and vec_id (ties by their components; null ids
    last); with fewer vectors there are fewer centroids.  Each round sends the centroids (``clusters * width`` integers,
    whatever the input) to all tasks, every task assigns its vectors and sums them by cluster, and these sums meet in one
    ``groupBy``: no vector is shuffled, and a value that many vectors share loads no task.  An empty cluster keeps its
    centroid.

    Returns, for every vector that takes part (repeated rows each), vec_id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256 of the final centroid.  Components of any finite size are reckoned exactly; a distance or
    a sum of distances beyond a long is null.
    """
    # ids are strings on their way: pandas has no whole numbers with nulls
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = common.stored(vectors.select(F.col("vec_id").cast("string").alias("vec_id"), doubles.alias("vector")).where((F.size("vector") == width) & finite))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id")), 256)
    seeds = kept.select(order.alias("rank"), "vector").orderBy(F.col("rank").asc_nulls_last(), "vector").limit(clusters).collect()
    centres = [whole(np.array([r.vector]), scale)[0].tolist() for r in seeds]
    sums = [f"s{i}" for i in range(width)]
    schema = "cluster int, place int, members long, " + ", ".join(f"{s} long" for s in sums)
    for _ in range(rounds if centres else 0):
        now = centres
        merged = kept.mapInPandas(lambda it: _sums(it, now, scale), schema).groupBy("cluster", "place").agg(F.sum("members").alias("members"), *(F.sum(s).alias(s) for s in sums)).collect()
        members, totals = {}, {}
        for row in merged:
            members[row.cluster] = members.get(row.cluster, 0) + row.members
            before = totals.get(row.cluster, [0] * width)
            totals[row.cluster] = [a + (row[s] << (DIGIT_BITS * row.place)) for a, s in zip(before, sums, strict=True)]
        centres = [[t // members[i] for t in totals[i]] if i in members else c for i, c in enumerate(centres)]
    final = centres
    assigned = common.stored(kept.mapInPandas(lambda it: _assigned(it, final, scale), "vec_id string, cluster int, distance long"))
    # a sum with a distance that does not fit is unknown too
    known = lambda: F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    totals = {r.cluster: r.own for r in assigned.groupBy("cluster").agg(known().alias("own")).collect()}
    inertia = None if None in totals.values() else _long(sum(totals.values()))
    rows = [(i, _long(totals[i]), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(final) if i in totals]
    table = kept.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
