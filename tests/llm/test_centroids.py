"""Lloyd's rounds against a plain loop over Python's integers."""

import hashlib
import math
import random

import pytest

from folioscope.llm import centroids, queries


def plain(rows, clusters=40, rounds=5, width=64):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**52 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for n in set(mine):
            of = [v for (_, v), m in zip(kept, mine) if m == n]
            centres[n] = [sum(x) // len(of) for x in zip(*of)]
    last = [near(v) for _, v in kept]
    own = {n: sum(d for d, m in last if m == n) for _, n in last}
    fits = lambda x: x if x < 2**63 else None
    return [(i, n, fits(d), fits(own[n]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last)]


def same(frame, wanted):
    assert frame.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == sorted(wanted, key=repr)


def vectors(seed, many, width, size=1.0):
    dice = random.Random(seed)
    middle = [[dice.gauss(0, size) for _ in range(width)] for _ in range(4)]
    return [(i, [x + dice.gauss(0, size / 4) for x in dice.choice(middle)]) for i in range(many)]


AWKWARD = [(900, None), (901, []), (902, [1.0]), (903, [None] * 3), (904, [1.0, float("nan"), 0.0]), (905, [1.0, float("inf"), 0.0]), (None, [0.5, 0.25, -0.001]), (7, [0.0, 0.0, -0.0]), (7, [0.0, 0.0, -0.0]), (8, [9.0, 9.0, 9.0]), (2**60 + 1, [9.0, 9.0, 9.0])]


@pytest.mark.parametrize("size", [1.0, 1e7, 1e30, 1e300])
def test_against_plain_loop(spark, size):
    table = vectors(1, 120, 3, size) + AWKWARD
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(5).selectExpr("'x' AS cluster", "*", "1 AS distance", "'y' AS `odd.name`")
    same(centroids.cluster(frame, clusters=9, rounds=3, width=3), plain(table, 9, 3, 3))


def test_fewer_vectors_than_clusters_and_equal_ones(spark):
    table = [(i, [0.5, 0.5]) for i in range(6)] + [(10, [0.5, 0.75])]
    same(centroids.cluster(spark.createDataFrame(table, "vec_id int, embedding array<float>"), width=2), plain(table, width=2))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    same(centroids.cluster(none), [])
    same(centroids.cluster(spark.createDataFrame([(1, [1.0])], none.schema)), [])


def test_whole_table(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same(queries.op12_centroid_clusters(spark, "/root/testdata/sf0.001"), plain(table))
