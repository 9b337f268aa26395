"""Source mixing: targets against fractions, quotas and pieces against the words they stand for."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from folioscope.llm import mixing, queries

from .brute import BLANK

SCHEMA = "doc_id long, text string, source string"


def shares(sizes):
    """Water-filling in fractions: give all the rest by weight, hold what is above, again."""
    weights, held = [i % 3 + 1 for i in range(len(sizes))], {}
    while True:
        rest = Fraction(sum(sizes) - sum(held.values()))
        open_ones = [i for i in range(len(sizes)) if i not in held]
        found = {i: rest * weights[i] / sum(weights[j] for j in open_ones) for i in open_ones}
        above = [i for i in open_ones if found[i] > 3 * sizes[i]]
        if not above:
            return [float(held.get(i, found.get(i, 0))) for i in range(len(sizes))]
        held |= {i: 3 * sizes[i] for i in above}


def corpus(seed, many=80):
    dice = random.Random(seed)
    word = lambda i, j: f"d{i}w{j}"
    rows = [(i, " ".join(word(i, j) for j in range(dice.choice([1, 5, 30, 90]))), dice.choice(["a", "a", "a", "b", "c", "é", "", None])) for i in range(many)]
    return [*rows, (500, None, "a"), (501, " \n", "b"), (502, "", None), (503, "only", "z"), (504, None, "void"), (505, "\x0b two\twords ", "c"), (505, "\x0b two\twords ", "c"), (None, "no id", "a"), (506, " ".join(word(506, j) for j in range(700)), "long")]


def counts(frame):
    assert frame.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_targets():
    dice = random.Random(1)
    for _ in range(300):
        sizes = [dice.choice([0, 1, 7, 100, 5000]) for _ in range(dice.randint(1, 9))]
        found = mixing.targets(sizes)
        assert np.allclose([t for t, _ in found], shares(sizes))
        assert all(abs(t - w) <= 0.5 and w <= 3 * s for (t, w), s in zip(found, sizes)) and abs(sum(w for _, w in found) - sum(sizes)) <= len(sizes)
    assert mixing.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    for key in range(5):
        found = mixing.permuted(np.arange(n), n, np.full(n, key, np.uint64))
        assert sorted(found.tolist()) == list(range(n))
    assert n < 17 or len({tuple(mixing.permuted(np.arange(n), n, np.full(n, key, np.uint64))) for key in range(5)}) == 5


def test_tree_gives_exact_quotas_and_disjoint_draws():
    slots = [700, 3, 0, 41, 256]
    parts = np.array([[i, s * 10, s, 0, 0, s] for i, s in enumerate(slots) if s])
    leaves = list(mixing._halves(0, 16, parts, 7, 9))
    assert [x[0] for x in leaves] == list(range(16))
    assert {int(p[:, 5].sum()) for _, _, p in leaves} <= {62, 63}
    for number, s in enumerate(slots):
        drawn = [x for _, _, p in leaves for n, _, _, _, offset, quota in p.tolist() if n == number for x in range(offset, offset + quota)]
        assert drawn == list(range(s))
    # another seed deals otherwise
    assert any((a[2][:, 5].tolist() != b[2][:, 5].tolist()) for a, b in zip(leaves, mixing._halves(0, 16, parts, 8, 9)))
    # going down in two steps is the same as in one
    steps = [y for s, many, p in mixing._halves(0, 16, parts, 7, 2) for y in mixing._halves(s, many, p, 7, 9)]
    assert all(np.array_equal(a[2], b[2]) for a, b in zip(leaves, steps))


def test_split_follows_the_hypergeometric_mean():
    parts = np.array([[0, 0, 3000, 0, 0, 3000], [1, 0, 1000, 0, 0, 1000]])
    first = [next(iter(mixing._halves(0, 2, parts, seed, 1)))[2][0, 5] for seed in range(200)]
    assert abs(np.mean(first) - 1500) < 5 and 8 < np.std(first) < 20  # 13.7 by the formula


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_pieces_are_the_words_they_stand_for(spark, block):
    table = corpus(block)
    frame = spark.createDataFrame(table, SCHEMA).repartition(3).selectExpr("'x' AS size", "*", "1 AS number", "'y' AS `odd.name`")
    how = {"block_words": block, "shard_blocks": 4, "run_docs": 9}
    found = counts(mixing.taken(frame, **how))
    size = lambda t: len(BLANK.findall(t or ""))
    names = sorted({s for _, _, s in table if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in table if s == n) for n in names]
    target = dict(zip(names, shares(sizes), strict=True))
    wanted = [(d, size(t), sizes[names.index(s)]) for d, t, s in table]
    assert sorted([r[:3] for r in found], key=repr) == sorted(wanted, key=repr)
    by_source = Counter()
    for _, s, whole, aim, took in found:
        assert took <= 3 * s
        by_source[whole, aim] += took
    assert all(abs(took - aim) <= 0.5 * sum(x == whole for x in sizes) for (whole, aim), took in by_source.items())
    assert sorted({r[3] for r in found}) == pytest.approx(sorted(set(target.values())))
    pieces = mixing.mix(frame, **how).collect()
    texts = {d: BLANK.findall(t or "") for d, t, _ in table}
    took = Counter()
    for p in pieces:
        assert BLANK.findall(p.text) == texts[p.doc_id][p.first_word : p.first_word + p.n_words] and 0 < p.n_words <= block
        took[p.doc_id] += p.n_words
    per_id = Counter()
    for d, _, _, _, n in found:
        per_id[d] += n
    assert +took == +per_id
    shards = Counter(p.shard for p in pieces)
    assert all({p.place for p in pieces if p.shard == s} == set(range(1, n + 1)) for s, n in shards.items())
    # reruns agree however the rows are dealt
    again = spark.createDataFrame(table[::-1], SCHEMA).repartition(7, "text")
    assert counts(mixing.taken(again, **how)) == found
    assert sorted(map(tuple, mixing.mix(again, **how).collect()), key=repr) == sorted(map(tuple, pieces), key=repr)


def test_empty_and_wordless_tables(spark):
    assert counts(mixing.taken(spark.createDataFrame([], SCHEMA))) == []
    assert counts(mixing.taken(spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0


def test_whole_table(spark):
    found = counts(queries.op11_source_mix(spark, "/root/testdata/sf0.001"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted((r.doc_id, len(BLANK.findall(r.text or ""))) for r in docs) == sorted(r[:2] for r in found)
    took = Counter()
    for _, size, whole, aim, n in found:
        assert n <= 3 * size
        took[whole, aim] += n
    assert all(abs(n - aim) <= 1 for (_, aim), n in took.items())
