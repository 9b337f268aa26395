"""Plans: one declarative query rendered for Spark and for its DuckDB counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.functions.dialect import Dialect
from folioscope.plans import derived, fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Survey entries that each query covers.
COVERS: dict[str, str] = {}
#: Functions of a dialect that give a query's SQL.
BUILDERS: dict[str, Callable[[Dialect], str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Texts that are read in fewer splits than there are cores, as one row group is, are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if "text" in df.columns and df.rdd.getNumPartitions() < cores else df


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Registers the tables that a query names."""
    for name in TABLES:
        if f" {name} " in f" {sql} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " "):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


#: A decimal number outside quotes: both engines shall take it as a double.
_DECIMAL = re.compile(r"('(?:[^'\\]|''|\\.)*')|(?<![\w.])(\d+\.\d+)(?![\w.])", re.DOTALL)


def doubles(sql: str) -> str:
    return _DECIMAL.sub(lambda m: m[1] or f"{m[2]}E0", sql)


def plan(covers: str) -> Callable:
    """Registers a function of a dialect that gives SQL."""

    def register(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        def made(spark: bool) -> str:
            """The plan over the driver's tables, directly or through relations made of them."""
            return doubles(build(Dialect(spark, derived.relations(Dialect(spark), build.__name__))))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            sql = made(True)
            views(spark, sf_dir, sql)
            return spark.sql(sql)

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        ORACLES[build.__name__] = made(False)
        COVERS[build.__name__] = covers
        BUILDERS[build.__name__] = build
        return build

    return register


def chapters(d: Dialect) -> str:
    return d.table("chapters", fixtures.CHAPTERS, "manuscript_id, chapter, ord, raw")
