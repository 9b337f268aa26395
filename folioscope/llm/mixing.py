"""Mixing of sources to target weights: block quotas dealt to shards by a tree of exact random splits.

A source is one stream of words, its documents in the order of a hash.  The stream is cut into blocks; a source's target
becomes a number of block draws (whole rounds through a permutation of its blocks, then the beginning of another).  The
draws of all sources together are what the shards share: the root of a binary tree holds every source's draws, each node
gives half of its draws to its left child by a multivariate hypergeometric draw, and so every shard gets the sources as a
uniform shuffle of all draws would give them, with exact sums.  A shard's draws of a source are consecutive places of that
source's permutation, so no two shards share any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order, again from the start where there are more sources.
WEIGHTS = (1, 2, 3)
#: Times that a document is taken at most.
ROUNDS = 3
#: Words of a block, but more for a corpus of over ``MOST_BLOCKS`` blocks; blocks of a shard.
BLOCK_WORDS, MOST_BLOCKS, SHARD_BLOCKS = 1024, 1 << 28, 256
#: Documents whose sizes are summed up one behind the other; a source is many such runs.
RUN_DOCS = 20_000
#: Levels of the tree that one task goes down at a time.
LEVELS = 5

_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_PARTS = "number int, size long, slots long, cut long, offset long, quota long"
_NODE = f"shard long, shards long, parts array<struct<{', '.join(p.replace(' ', ':') for p in _PARTS.split(', '))}>>"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> list[tuple[float, int]]:
    """Target and whole words to take of each source, in order: shares by weight, none over ``rounds`` times its size."""
    total, mine = sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = total - sum(rounds * sizes[i] for i in full)
        scale = sum(w for i, w in enumerate(mine) if i not in full)
        above = [i for i, w in enumerate(mine) if i not in full and rest * w > rounds * sizes[i] * scale]
        if not above:
            break
        full.update(above)
    exact = [(rounds * s, 1) if i in full else (rest * w, scale) for i, (s, w) in enumerate(zip(sizes, mine, strict=True))]
    return [(a / b, min((2 * a + b) // (2 * b), rounds * s)) for (a, b), s in zip(exact, sizes, strict=True)]


def _quotas(batches: Iterator[pd.DataFrame], weights: tuple[int, ...], rounds: int, block: int) -> Iterator[pd.DataFrame]:
    """Numbers, targets and block draws of the sources: one small row each."""
    rows = [r for b in batches for r in b.itertuples(index=False)]
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    out = []
    for number, (row, (target, words)) in enumerate(zip(rows, targets([int(r.size) for r in rows], weights, rounds), strict=True)):
        size = int(row.size)
        whole, rest = divmod(words, size) if size else (0, 0)
        draws = -(-rest // block)
        # words of the last draw, where it is not the whole block
        cut = rest - (draws - 1) * block if draws else 0
        out.append((row.source, number, size, target, whole * -(-size // block) + draws, cut))
    yield pd.DataFrame(out, columns=["source", "number", "size", "target", "slots", "cut"])


def _halves(shard: int, shards: int, parts: np.ndarray, seed: int, levels: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Nodes ``levels`` below a node; the columns of ``parts`` are number, size, slots, cut, offset and quota."""
    if shards == 1 or levels == 0:
        yield shard, shards, parts
        return
    quota = parts[:, 5]
    dice = np.random.default_rng([seed, shards, shard])
    left = dice.multivariate_hypergeometric(quota, int(quota.sum()) // 2, method="marginals")
    for at, offset, mine in ((shard, parts[:, 4], left), (shard + shards // 2, parts[:, 4] + left, quota - left)):
        child = np.column_stack([parts[:, :4], offset, mine])[mine > 0]
        yield from _halves(at, shards // 2, child, seed, levels - 1)


def _split(batches: Iterator[pd.DataFrame], seed: int, levels: int) -> Iterator[pd.DataFrame]:
    names = [p.split()[0] for p in _PARTS.split(", ")]
    for batch in batches:
        for node in batch.itertuples(index=False):
            parts = np.array([[p[n] for n in names] for p in node.parts], np.int64).reshape(-1, len(names))
            found = [(s, many, [dict(zip(names, x, strict=True)) for x in p.tolist()]) for s, many, p in _halves(int(node.shard), int(node.shards), parts, seed, levels)]
            yield pd.DataFrame(found, columns=["shard", "shards", "parts"])


def permuted(places: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Images of places under a pseudo-random permutation of ``range(n)``, another one for each key.

    Four rounds over two half words; what falls outside the range goes through again until it is inside.
    """
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = places.astype(np.uint64), np.arange(len(places))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for turn in range(4):
            left, right = right, left ^ (common.mixed(right + keys[todo] * np.uint64(8) + np.uint64(turn)) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _drawn(batches: Iterator[pd.DataFrame], seed: int, block: int) -> Iterator[pd.DataFrame]:
    """Blocks that each shard draws: a short last block of a source comes last in each round."""
    for batch in batches:
        for node in batch.itertuples(index=False):
            for p in node.parts:
                slots = np.arange(p["offset"], p["offset"] + p["quota"], dtype=np.int64)
                blocks, whole = -(-p["size"] // block), p["size"] // block
                turn, place = slots // blocks, slots % blocks
                keys = common.mixed(turn.astype(np.uint64) + np.uint64(seed * 1_000_003 + p["number"] * 1_009))
                inner = place < whole
                found = np.full(len(slots), whole)
                found[inner] = permuted(place[inner], int(whole), keys[inner]) if whole else 0
                words = np.minimum(block, p["size"] - found * block)
                if p["cut"]:
                    words = np.where(slots == p["slots"] - 1, p["cut"], words)
                yield pd.DataFrame({"shard": node.shard, "number": p["number"], "slot": slots, "block": found, "words": words})


def _cut_texts(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """The parts of each text that lie in the blocks of its source's stream."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            words, out = _WORD.findall(row.text), []
            for number in range(row.start // block, (row.start + row.size - 1) // block + 1):
                first, last = max(row.start, number * block), min(row.start + row.size, (number + 1) * block)
                out.append((row.number, number, row.start, first, last, "".join(words[first - row.start : last - row.start])))
            yield pd.DataFrame(out, columns=["number", "block", "start", "first", "last", "text"])


class _Mix:
    """The tables of one mix: sized documents, sources, documents at their places in the streams, draws."""

    def __init__(self, docs: DataFrame, seed: int, block_words: int, shard_blocks: int, run_docs: int, weights: tuple[int, ...], rounds: int, texts: bool) -> None:
        spark, self.texts = docs.sparkSession, texts
        text = F.col("text").cast("string")
        size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", text, F.lit(seed)).alias("key"), *([text.alias("text")] if texts else []))
        sized = common.stored(sized)
        total, many = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        self.block = block = max(block_words, -(-total // MOST_BLOCKS))
        per_source = sized.groupBy("source").agg(F.sum("size").alias("size")).repartition(1)
        quotas = per_source.mapInPandas(lambda it: _quotas(it, weights, rounds, block), "source string, number int, size long, target double, slots long, cut long")
        self.sources = common.stored(quotas)
        runs = max(1, -(-many // run_docs))
        named = self.sources.select(F.col("source").alias("named"), "number")
        run = sized.join(named, sized["source"].eqNullSafe(F.col("named"))).withColumn("run", F.pmod("key", F.lit(runs))).drop("named")
        sums = run.groupBy("number", "run").agg(F.sum("size").alias("words"))
        base = sums.select("number", "run", (F.sum("words").over(Window.partitionBy("number").orderBy("run")) - F.col("words")).alias("base"))
        inside = F.sum("size").over(Window.partitionBy("number", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
        self.placed = run.withColumn("inside", inside).join(base, ["number", "run"]).withColumn("start", F.col("base") + F.col("inside") - F.col("size")).drop("base", "inside", "run", "key")
        self.draws = self._draws(seed, shard_blocks)

    def _draws(self, seed: int, shard_blocks: int) -> DataFrame:
        slots = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        depth = max(0, (max(0, slots - 1) // shard_blocks).bit_length())
        part = F.struct("number", "size", "slots", "cut", F.lit(0).cast("long").alias("offset"), F.col("slots").alias("quota"))
        nodes = self.sources.where("slots > 0").agg(F.sort_array(F.collect_list(part)).alias("parts")).where("size(parts) > 0").select(F.lit(0).cast("long").alias("shard"), F.lit(1 << depth).cast("long").alias("shards"), "parts")
        for done in range(0, depth, LEVELS):
            levels = min(LEVELS, depth - done)
            nodes = nodes.mapInPandas(lambda it, levels=levels: _split(it, seed, levels), _NODE).repartition("shard")
        block = self.block
        return nodes.mapInPandas(lambda it: _drawn(it, seed, block), "shard long, number int, slot long, block long, words long")

    def pieces(self) -> DataFrame:
        """What each draw takes of each document: shard, number, slot, start (the document's place), first_word, n_words."""
        block = self.block
        there = self.placed.where("size > 0")
        if self.texts:
            cut = there.select("number", "start", "size", "text").mapInPandas(lambda it: _cut_texts(it, block), "number int, block long, start long, first long, last long, text string")
        else:
            cut = there.select("number", "start", "size", F.explode(F.sequence(F.expr(f"start DIV {block}"), F.expr(f"(start + size - 1) DIV {block}"))).alias("block"))
            cut = cut.select("number", "block", "start", F.greatest("start", F.col("block") * block).alias("first"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block).alias("last"))
        met = cut.join(self.draws, ["number", "block"])
        many = F.least("last", F.col("block") * block + F.col("words")) - F.col("first")
        return met.withColumn("n_words", many).where("n_words > 0").withColumn("first_word", F.col("first") - F.col("start"))


def mix(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, run_docs: int = RUN_DOCS, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """The mixed corpus: shard, place, source, doc_id, first_word, n_words and text of each piece, places from 1.

    Takes doc_id, text and source (null: a source of its own, last).  Sources in order of code points weigh ``weights``, repeating,
    and share the corpus's words; none goes over ``rounds`` times its size, the excess goes to the others by weight.  What is
    taken of a source is its target to the word: the last draw is cut.  Shards take equal numbers of draws (one more or
    less); within a shard pieces stand by a hash.  A piece is at most a block and keeps the white space behind its words.

    The result depends on rows, seed and parameters, not on how the rows are dealt.  Null and blank texts have no words and no
    piece; repeated rows are documents of their own; an empty table gives no rows.  Sources are components of a mixture: one
    row of some 50 bytes each, the only thing that one task holds of all of them; documents of one source spread over runs of
    ``run_docs`` and over blocks.
    """
    tables = _Mix(docs, seed, block_words, shard_blocks, run_docs, weights, rounds, True)
    ids = tables.placed.where("size > 0").select("number", "start", "doc_id", "source")
    order = F.xxhash64(F.lit(seed), "number", "slot", "start", "first_word"), F.col("number"), F.col("slot"), F.col("start")
    pieces = tables.pieces()
    # a cut draw may take less of a piece than its text holds
    kept = F.when(F.col("last") - F.col("first") == F.col("n_words"), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("n_words").cast("int")), ""))
    placed = pieces.withColumn("text", kept).join(ids, ["number", "start"])
    return placed.select("shard", F.row_number().over(Window.partitionBy("shard").orderBy(*order)).alias("place"), "source", "doc_id", "first_word", "n_words", "text")


def taken(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, run_docs: int = RUN_DOCS, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """What :func:`mix` takes of each document, without texts: doc_id, size, source_size, target (its source's) and taken.

    One row for each row of ``docs``; ``taken`` counts words as often as they are taken, 0 for texts without words.
    """
    tables = _Mix(docs, seed, block_words, shard_blocks, run_docs, weights, rounds, False)
    words = tables.pieces().groupBy("number", "start").agg(F.sum("n_words").alias("taken")).withColumnRenamed("number", "of")
    about = tables.sources.select(F.col("number").alias("about"), F.col("size").alias("source_size"), "target")
    # a document without words shares its place with the next one
    here = F.when(F.col("size") > 0, F.col("start")).alias("place")
    rows = tables.placed.select("doc_id", "number", "size", here).join(words, (F.col("number") == F.col("of")) & (F.col("place") == F.col("start")), "left").join(about, F.col("number") == F.col("about"))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
