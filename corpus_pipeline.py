"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import common, decontaminate, lines, near, quality, queries, tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What stages made on their way, beside the result that reads it.
_made: list[tuple[weakref.ref, list]] = []


def _stage(function: Stage) -> Stage:
    """A stage's result is written before the next stage begins: the tables behind it go then, once nobody holds the result.

    The last stage is not one of these, so what :func:`run` returns stays readable whatever runs after it.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for entry in [x for x in _made if x[0]() is None]:
            _made.remove(entry)
            common.release([x for x in entry[1] if x in common.written()])
        known = common.written()
        result = function(spark, docs, sf_dir)
        _made.append((weakref.ref(result), [x for x in common.written() if x not in known]))
        return result

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, failing lines of the others go."""
    return quality.clean(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that had no other."""
    return lines.strip_lines(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digest of the text that they decode to."""
    return tokens.encode_decode(docs, queries.vocabulary_file()).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Edit distances, signatures and BPE merges are beyond SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each reading what its predecessor wrote."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        common.release(before)
        before = common.written()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
