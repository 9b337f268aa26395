"""Connected groups from shared keys, without listing all pairs of a key.

Ids that share a key are first compared with the key's least id.  Links that hold give components; only keys
whose ids still lie in several components are gone through pair by pair, across components, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Ids of a key compared at once; a key with more is dealt as pairs of blocks.
BLOCK = 256
#: Edges up to which components are found in one partition, without shuffles; more are dealt.
FEW_EDGES = 200_000
#: Ids from which a component is compared as a whole with the ids outside it that share a key.
LARGE, GUESTS = 16, 512
#: Parts into which the rows of each key are dealt where one key may hold a third of them.
SALTS = 16


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id, repeats and keys with one id dropped; hub is the key's least id."""
    last_key = hub = last_id = None
    waiting = False
    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if not len(keys):
            continue
        fresh = np.concatenate([[last_key is None or keys[0] != last_key or ids[0] != last_id], (np.diff(keys) != 0) | (np.diff(ids) != 0)])
        keys, ids = keys[fresh], ids[fresh]
        if not len(keys):
            continue
        opens = np.concatenate([[last_key is None or keys[0] != last_key], np.diff(keys) != 0])
        first = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), -1))
        hubs = np.where(first >= 0, ids[first], hub if hub is not None else 0)
        # an opening row waits for a second id of its key
        follows = np.concatenate([~opens[1:], [False]])
        out = ~opens | follows
        keep_key, keep_id, keep_hub = keys[out], ids[out], hubs[out]
        if waiting and not opens[0]:
            keep_key, keep_id, keep_hub = np.append(keep_key, keys[0]), np.append(keep_id, hub), np.append(keep_hub, hub)
        waiting = bool(opens[-1])
        last_key, last_id, hub = keys[-1], ids[-1], hubs[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keep_key), pa.array(keep_id), pa.array(keep_hub)], names=["key", "id", "hub"])


def shared_keys(buckets: DataFrame) -> DataFrame:
    """(key, id, hub) of the keys that two ids or more hold, stored; rows stream, so a key of any size fits."""
    dealt = buckets.select("key", "id").repartition("key").sortWithinPartitions("key", "id")
    return common.stored(dealt.mapInArrow(_shared, "key long, id long, hub long"))


def star_pairs(live: DataFrame) -> DataFrame:
    """(a, b): every id with the least id of each of its keys."""
    return live.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for the ids of ``links`` (a, b): the least id that links lead to, stored."""
    edges = common.stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    small = edges.count() <= FEW_EDGES
    if small:
        edges = edges.coalesce(1)
    labels = common.stored(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("comp")))
    while True:
        labels = labels.coalesce(1) if small else labels
        other = labels.select(F.col("id").alias("b"), F.col("comp").alias("seen"))
        near = edges.join(other, "b").groupBy("a").agg(F.min("seen").alias("seen")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "seen").alias("comp"))
        ahead = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        jumped = common.stored(hooked.join(ahead, "comp").select("id", "was", F.least("comp", "next").alias("comp")))
        labels = jumped.select("id", "comp")
        if jumped.where("was <> comp").isEmpty():
            return labels


def spread_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``id``) joined with the one fact of their key; the rows of a hot key are dealt by their id."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return dealt.join(facts.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})"))), [key, "salt"]).drop("salt")


def _across(batches: Iterator[pa.RecordBatch], judge: Callable) -> Iterator[pa.RecordBatch]:
    """Pairs of one group (key, i, j) in different components that ``judge`` (payloads, a, b, keys) lets pass."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        group = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        comp, block, ids = (table.column(c).to_numpy() for c in ("comp", "own", "id"))
        data = common.as_array(table.column("payload"))
        left, right = [], []
        for d in range(1, 2 * BLOCK + 400):
            same = np.logical_and.reduce([g[:-d] == g[d:] for g in group]) if len(ids) > d else np.empty(0, bool)
            if not same.any():
                break
            a = np.flatnonzero(same & (comp[:-d] != comp[d:]) & (ids[:-d] != ids[d:]) & ((group[1][:-d] == group[2][:-d]) | (block[:-d] != block[d:])))
            left.append(a)
            right.append(a + d)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        ok = judge(data, a, b, group[0][a]) if len(a) else np.empty(0, bool)
        a, b = ids[a[ok]], ids[b[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for table in _whole(batches, ("key", "i", "j")):
        yield pairs(table)


def placed_ids(live: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, id, comp, size) with the component of every id and its number of ids."""
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return live.select("key", "id").join(comps.join(sizes, "comp"), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))


def cross_pairs(placed: DataFrame, payload: DataFrame, judge: Callable) -> DataFrame:
    """(a, b) that share a key, lie in different components and pass ``judge``.

    ``payload`` holds (id, payload) for every id.  A key with many ids is dealt as pairs of blocks, so no
    task holds more than two blocks of it at once.
    """
    spread = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    members = placed.join(spread, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = members.select("key", "id", "comp", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    dealt = dealt.select("key", "id", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(payload, "id")
    sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.select("key", "i", "j", "own", "comp", "id", "payload").mapInArrow(lambda it: _across(it, judge), "a long, b long").distinct()


def large_links(placed: DataFrame, comps: DataFrame, payload: DataFrame, linked: Callable) -> DataFrame:
    """(a, b): links of ids with a large component that they share a key with, one for each of its parts at most.

    One link is enough, as the component is connected, so no pairs are listed.  Of two large components the
    smaller one's ids are compared.  A group holds ``BLOCK`` members and ``GUESTS`` others, dealt by hash;
    ``linked`` (member payloads, guest payloads) gives a linked member for each guest, or -1.
    """
    hosts = placed.where(F.col("size") >= LARGE).select("key", F.col("comp").alias("host"), F.col("size").alias("host_size")).distinct()
    smaller = (F.col("size") < F.col("host_size")) | ((F.col("size") == F.col("host_size")) & (F.col("comp") < F.col("host")))
    guests = common.stored(placed.join(hosts, "key").where(smaller).select("id", "host", "host_size").distinct())
    tables = guests.groupBy("host").agg(F.ceil(F.max("host_size") / BLOCK).cast("int").alias("parts"), F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("tables"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    members = comps.withColumnRenamed("comp", "host").join(tables, "host").select("host", "id", place("parts").alias("part"), F.explode(F.expr("sequence(0, tables - 1)")).alias("at"), F.lit(False).alias("guest"))
    others = guests.join(tables, "host").select("host", "id", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), place("tables").alias("at"), F.lit(True).alias("guest"))
    dealt = members.unionByName(others).join(payload, "id").repartition("host", "part", "at").sortWithinPartitions("host", "part", "at")
    return dealt.select("host", "part", "at", "guest", "id", "payload").mapInArrow(lambda it: _hosted(it, linked), "a long, b long").distinct()


def _hosted(batches: Iterator[pa.RecordBatch], linked: Callable) -> Iterator[pa.RecordBatch]:
    for table in _whole(batches, ("host", "part", "at")):
        data, guest, ids = common.as_array(table.column("payload")), table.column("guest").to_numpy(), table.column("id").to_numpy()
        edges = np.flatnonzero(_changes(table, ("host", "part", "at"))) + 1
        a, b = [], []
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
            inside, outside = low + np.flatnonzero(~guest[low:high]), low + np.flatnonzero(guest[low:high])
            if len(inside) and len(outside):
                found = linked(data.take(pa.array(inside)), data.take(pa.array(outside)))
                a.append(ids[inside[found[found >= 0]]])
                b.append(ids[outside[found >= 0]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _changes(table: pa.Table, names: tuple) -> np.ndarray:
    return np.logical_or.reduce([np.diff(table.column(c).to_numpy()) != 0 for c in names])


def _whole(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by group."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, 4 * BLOCK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            change = _changes(table, names)
            cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()
