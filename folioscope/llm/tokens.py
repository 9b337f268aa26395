"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a block with one list of distinct words.
BLOCK_WORDS = 8_000_000


def split_words(text: Column, pattern: str, special: str) -> Column:
    """Words that the vocabulary's merges never cross; the special token stands alone.

    ``pattern`` takes Java's syntax.  Texts around the special token are split by themselves, as the
    pattern looks ahead.
    """
    literal = "".join("\\" + c if not c.isalnum() else c for c in special)
    every = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    around = F.flatten(F.transform(F.split(text, literal, -1), lambda s, i: F.when(i > 0, F.concat(F.array(F.lit(special)), every(s))).otherwise(every(s))))
    return F.when(F.contains(text, F.lit(special)), around).otherwise(every(text))


#: Java's form of the vocabulary's published splitting pattern; white space is Unicode's.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
GPT_SPECIAL = "<|endoftext|>"

_NAMES = ["block", "bucket", "body", "doc_ids", "sizes"]
_TABLE = "block long, bucket int, body binary, doc_ids array<long>, sizes array<int>"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by their bytes' places and at a high level: small numbers leave planes of zeros."""
    raw = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def _from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_open(body), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _listed(words: list[bytes]) -> bytes:
    """Lengths of words, then the words, packed apart."""
    head, text = _planes(np.array([len(w) for w in words])), b"".join(words)
    return len(head).to_bytes(8, "little") + head + len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(text, asbytes=True)


def _unlisted(body: bytes) -> list[bytes]:
    cut = 8 + int.from_bytes(body[:8], "little")
    text, ends = _open(body[cut:]), np.cumsum(_from_planes(body[8:cut]), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _open(body: bytes) -> bytes:
    size = int.from_bytes(body[:8], "little")
    return pa.decompress(body[8:], size, codec="zstd", asbytes=True) if size else b""


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Words of some documents as places in the block's own list of distinct words; the list itself goes out
    by buckets of its words' hash, in the order of the places."""
    task = TaskContext.get().partitionId()
    for n, (doc_ids, sizes, coded) in enumerate(_gathered(batches)):
        block = (task << 32) + n
        vocab = coded.chunk(0).dictionary.cast(pa.binary())
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        del coded
        words = vocab.to_pylist()
        # frequent words get small numbers, which pack well
        slot = np.empty(len(words), np.uint32)
        slot[np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = pc.sort_indices(pa.table({"bucket": bucket, "word": vocab}), sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy().astype(np.int64)
        body, slots = _planes(slot[codes]), _planes(slot[order])
        del codes
        yield _table([(block, -1, len(body).to_bytes(8, "little") + body + slots, doc_ids, sizes)])
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                own = [words[i] for i in order[edges[b] : edges[b + 1]].tolist()]
                rows.append((block, b, _listed(own), None, None))
        if rows:
            yield _table(rows)
        del words, vocab, rows
        pa.default_memory_pool().release_unused()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, pa.ChunkedArray]]:
    """Ids, numbers of words and dictionary-coded words of blocks of documents."""
    ids, sizes, chunks, size = [], [], [], 0

    def block() -> tuple:
        return ids, sizes, pa.chunked_array(chunks).unify_dictionaries()

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lists = part.column("words")
            coded = lists.flatten().dictionary_encode()
            if size and size + len(coded) > BLOCK_WORDS:
                yield block()
                ids, sizes, chunks, size = [], [], [], 0
            ids += part.column("doc_id").to_pylist()
            sizes += pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            chunks.append(coded)
            size += len(coded)
    if ids:
        yield block()


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """The ids of each block's words.  Buckets arrive one after another; a distinct word is encoded once."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    current, known = None, {}
    for batch in batches:
        out = []
        for block, bucket, body in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "body")), strict=True):
            if bucket != current:
                current, known = bucket, {}
            words = _unlisted(body)
            fresh = [w for w in words if w not in known]
            for w, e in zip(fresh, tokenizer.encode_batch([w.decode() for w in fresh], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
            ids = [known[w] for w in words]
            out.append((block, bucket, _planes(np.concatenate([[len(ids)], [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4")])), None, None))
        if out:
            yield _table(out).select(_NAMES[:3])


def _assemble(batches: Iterator[pa.RecordBatch], pieces: list[bytes], full: bool) -> Iterator[pa.RecordBatch]:
    """Each document's ids by the places of its words, and their pieces joined again."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids, sizes = batch.column("doc_ids")[i].values, batch.column("sizes")[i].values.to_numpy()
            counts, flats = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
            for part in sorted(batch.column("coded")[i].as_py() or (), key=lambda p: p["bucket"]):
                raw = _from_planes(part["body"])
                counts.append(raw[1 : 1 + raw[0]].astype(np.int64))
                flats.append(raw[1 + raw[0] :])
            whole = batch.column("body")[i].as_py()
            cut = 8 + int.from_bytes(whole[:8], "little")
            codes, slots = _from_planes(whole[8:cut]), _from_planes(whole[cut:])
            flat, listed = np.concatenate(flats), np.concatenate(counts)
            count, first = np.empty_like(listed), np.empty_like(listed)
            count[slots], first[slots] = listed, np.cumsum(listed) - listed
            names, lookup = flat.tolist(), list(map(str, range(len(pieces))))
            spelled, shown = [], []
            for a, n in zip(first.tolist(), count.tolist(), strict=True):
                own = names[a : a + n]
                spelled.append(",".join([lookup[x] for x in own]))
                shown.append(b"".join([pieces[x] for x in own]))
            ends = np.cumsum(sizes, dtype=np.int64)
            n_ids = count[codes]
            before = np.concatenate([[0], np.cumsum(n_ids)])
            for low in range(0, len(sizes), 2000):  # documents of the block some at a time
                yield _documents(doc_ids, sizes, ends, before, codes, spelled, shown, flat if full else None, first, n_ids, low, min(low + 2000, len(sizes)))


def _documents(doc_ids, sizes, ends, before, codes, spelled, shown, flat, first, n_ids, low: int, high: int) -> pa.RecordBatch:
    ids_sha, text_sha, texts = [], [], []
    for a, b in zip((ends - sizes)[low:high].tolist(), ends[low:high].tolist(), strict=True):
        own = codes[a:b].tolist()
        text = b"".join([shown[c] for c in own]).decode("utf-8", "replace")
        ids_sha.append(hashlib.sha256(",".join([spelled[c] for c in own]).encode()).hexdigest())
        text_sha.append(hashlib.sha256(text.encode()).hexdigest())
        texts.append(text if flat is not None else None)
    lists = pa.nulls(high - low, pa.list_(pa.int32()))
    begin, past = int(ends[low] - sizes[low]), int(ends[high - 1])
    if flat is not None:
        n = n_ids[begin:past]
        at = np.repeat(first[codes[begin:past]] - (before[begin:past] - before[begin]), n) + np.arange(int(n.sum()))
        edges = np.concatenate([[before[begin]], before[ends[low:high]]]) - before[begin]
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat[at].astype(np.int32)))
    n_tokens = before[ends[low:high]] - before[(ends - sizes)[low:high]]
    return pa.RecordBatch.from_arrays([doc_ids[low:high], pa.array(n_tokens), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), lists, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])


def _piece_bytes(vocabulary: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; a piece spells bytes by printable characters."""
    import json

    table = json.loads(vocabulary)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    named = {i: piece for piece, i in table["model"]["vocab"].items()} | {t["id"]: t["content"] for t in table["added_tokens"]}
    joined = [b""] * (max(named) + 1)
    for i, piece in named.items():
        joined[i] = bytes(spelled[c] for c in piece) if all(c in spelled for c in piece) else piece.encode()
    return joined


def encode_decode(docs: DataFrame, vocabulary_file: str, pattern: str = GPT_PATTERN, special: str = GPT_SPECIAL, full: bool = True) -> DataFrame:
    """Encodes whole texts by a byte-level BPE vocabulary and decodes the ids again.

    Spark splits the words.  A block of documents keeps its distinct words once and its texts as places in
    that list.  The lists go to buckets by their words' hash, where every distinct word of the corpus is
    encoded once and its ids are joined back to the blocks' lists, and from there to the positions.  Ids become text through the vocabulary's id-to-piece table, which
    is as large as the vocabulary file and no larger.

    A null text counts as empty: no ids.  Returns a row for each input row: doc_id (null stays null),
    n_tokens, ids_sha256, decoded_sha256, ids and decoded (both null unless ``full``).
    """
    vocabulary = Path(vocabulary_file).read_text(encoding="utf-8")
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split_words(text, pattern, special).alias("words"))
    with common.batches_of(spark, 1000):
        table = common.stored(words.mapInArrow(lambda it: _blocks(it, buckets), _TABLE), "none")
    shared, pieces = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(_piece_bytes(vocabulary))
    listed = table.where("bucket >= 0").select("block", "bucket", "body").repartition("bucket").sortWithinPartitions("bucket")
    encoded = listed.mapInArrow(lambda it: _encode(it, shared.value), "block long, bucket int, body binary")
    coded = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("coded"))
    return (
        table.where("bucket < 0").join(coded, "block", "left")
        .mapInArrow(lambda it: _assemble(it, pieces.value, full), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    )
