"""Blocks of documents: one compressed row for some megabytes of texts, so that joins deal blocks, not words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "block long, body binary"
_ARROW = pa.schema([("block", pa.int64()), ("body", pa.binary())])


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_next_batch()


def block_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for i, part in enumerate(parts):
        yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + i]), pa.array([pack(part)], pa.binary())], schema=_ARROW)


def build(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Documents as stored blocks, with their other columns as ``rest`` if ``whole``.

    The table is written, so block numbers stay as they are when tasks rerun.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([common.rest_of(docs)] if whole else []))
    return common.stored(picked.mapInArrow(lambda it: block_rows(common.slices(it)), SCHEMA), "none")


def bodies(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(block, documents, values of further columns) for each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield (batch.column("block")[i].as_py(), unpack(batch.column("body")[i].as_buffer()), *(batch.column(c)[i].as_py() for c in more))
