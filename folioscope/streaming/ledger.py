"""Findings and the ledger of used material as chapters arrive as files; the findings stream is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions.dialect import SPARK
from folioscope.operators.lint import lint, over_frames
from folioscope.plans import contain


def findings_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: str = "") -> StreamingQuery:
    """Lints the manuscripts that a batch of new files touches, whole, and writes them under out/batch=N.

    Rewriting a batch after a lost driver overwrites the same folder, so each batch counts once.
    """
    arrived = spark.readStream.schema("value string").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("wholetext", "true").text(folder).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("manuscript_id"))

    def check(batch: DataFrame, number: int) -> None:
        from folioscope.sources.files import chapters

        touched = batch.select("manuscript_id").distinct()
        lint(chapters(batch.sparkSession, folder).join(touched, "manuscript_id", "left_semi"), profile).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrived.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Similes, openings and tags of each new file under ``out/batch=N``: a batch reads its own files and no others.

    Files lie at ``.../manuscript/chapter.md`` anywhere under ``folder``.  A file that is rewritten in place is not read again; a
    new version of a chapter comes as another file of its manuscript's and its own name, under another folder.  A batch that is run again after a lost driver overwrites its own folder.
    """
    text = spark.readStream.schema("value string").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("wholetext", "true").text(folder)
    arrived = text.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("manuscript_id"), F.col("_metadata.file_name").alias("chapter"), F.col("value").alias("raw"))

    def count(batch: DataFrame, number: int) -> None:
        over_frames(f"SELECT * FROM {contain.uses(SPARK, 'chapters_to_check')} x", chapters=batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrived.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """manuscript_id, kind, item and n over all batches; of a chapter that came again its last coming counts."""
    counts = spark.read.option("basePath", out).parquet(out)
    last = counts.groupBy("manuscript_id", "chapter").agg(F.max("batch").alias("batch"))
    now = counts.join(last, ["manuscript_id", "chapter", "batch"]).where("kind <> 'seen'")
    return now.groupBy("manuscript_id", "kind", "item").agg(F.sum("n").alias("n"))
