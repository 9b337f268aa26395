"""Shared pieces: durable intermediate tables, byte-level word splitting, rolling hashes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes handled at once by the array code; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is named, a local one, but only without a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="folioscope-"))


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows that go to Python at once in what is executed inside; long rows need smaller batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written() -> list[tuple[SparkSession, str]]:
    """Intermediate tables of this process so far, oldest first."""
    return list(_WRITTEN)


def release(tables: list[tuple[SparkSession, str]]) -> None:
    """Drops intermediate tables once everything made from them has been written."""
    for spark, path in tables:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        _WRITTEN.remove((spark, path))


@atexit.register
def _forget() -> None:
    """At exit the rest goes, if its session still answers; otherwise the cluster's own cleaner has the folder."""
    with contextlib.suppress(Exception):
        release(written())


def rest_of(docs: DataFrame) -> Column:
    """All columns but the text, packed so that names cannot clash."""
    return F.struct(*(docs[f"`{c.replace('`', '``')}`"] for c in docs.columns if c != "text"), F.lit(1).alias("one_more")).alias("rest")


def unpacked(rows: DataFrame, docs: DataFrame, **fresh: Column) -> DataFrame:
    """The columns of ``docs`` out of ``rest``, with fresh values for some of them."""
    return rows.select(*(fresh[c].alias(c) if c in fresh else F.col("rest").getField(c).alias(c) for c in docs.columns))


def with_rest(columns: str, docs: DataFrame) -> StructType:
    """An output schema of some columns and ``rest``."""
    rest = docs.select(rest_of(docs)).schema["rest"].dataType
    return StructType([*StructType.fromDDL(columns).fields, StructField("rest", rest, True)])


# ---------------------------------------------------------------- words


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Maps a UTF-8 byte to itself, A-Z to a-z where asked, and separators to a space."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 32
    return table


WHITE = bytes([32, *range(9, 14)])
#: ``[^\x20\x09-\x0D]+``
BLANK_SPLIT = byte_table(WHITE, lower=False)
BLANK_SPLIT_LOWER = byte_table(WHITE, lower=True)
#: lower-cased A-Z, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM_SPLIT = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Words(NamedTuple):
    """Words of a slice of rows: word ``i`` of row ``r`` is ``vocab[codes[starts[r] + i]]``."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))
        return each[self.codes] if len(self.codes) else np.empty(0, np.uint64)


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def words_of(texts: pa.Array, table: np.ndarray) -> Words:
    """Words of each text, a null text having none."""
    texts = pc.fill_null(as_array(texts).cast(pa.string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    mapped = pa.BinaryArray.from_buffers(pa.string(), n, [None, pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(table[raw])])
    lists = pc.ascii_split_whitespace(mapped)
    pieces = lists.flatten()
    real = pc.greater(pc.binary_length(pieces), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    starts = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if n else np.zeros(1, np.int64)
    coded = pieces.filter(real).cast(pa.binary()).dictionary_encode()
    return Words(coded.indices.to_numpy(), starts, coded.dictionary)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of text; a longer text is one slice."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


# ---------------------------------------------------------------- hashes

_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their order looks random."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX1
    x ^= x >> _SHIFT
    x *= _MIX2
    x ^= x >> _SHIFT
    return x


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values; run ``p`` starts at value ``p``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= _STEP
        total += hashes[j : j + n]
    return mixed(total)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, by doubling."""
    n, span, low = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def rows_of(starts: np.ndarray) -> np.ndarray:
    """Row of each word."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def in_row(starts: np.ndarray, k: int) -> np.ndarray:
    """Whether the ``k`` words from each word on lie in its row, for every start a run of ``k`` can have."""
    n = max(0, int(starts[-1]) - k + 1)
    return (np.arange(n) + k) <= starts[1:][rows_of(starts)[:n]] if n else np.empty(0, bool)
