"""Lint of any chapters relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from folioscope.functions.dialect import SPARK
from folioscope.operators.clusters import capitalised, greedy_variants
from folioscope.plans import lint as plans
from folioscope.plans import phrases
from folioscope.plans.registry import doubles


def over_frames(sql: str, **frames: DataFrame) -> DataFrame:
    """Runs a plan over DataFrames, each named NAME_to_check in it."""
    sql = doubles(sql).replace("{", "{{").replace("}", "}}")
    for name in frames:
        sql = sql.replace(f"{name}_to_check", "{" + name + "}")
    return next(iter(frames.values())).sparkSession.sql(sql, **frames)


def lint(chapters: DataFrame, profile: str = "", overrides: dict[str, float] | None = None) -> DataFrame:
    """Findings of chapters (manuscript_id, chapter, ord, raw), among them repeats that no watched
    phrase covers, repeats whose use grows through the manuscript and names spelled in several ways.

    Rows with a null text are left out. An empty relation has no findings.
    """
    th = plans.thresholds(profile, overrides)
    chapters = chapters.filter("raw IS NOT NULL").select("manuscript_id", "chapter", "ord", "raw")
    found = over_frames(plans.findings(SPARK, "chapters_to_check", th), chapters=chapters)
    spans = repeats(chapters, profile, overrides)
    placed = chapters
    if not isinstance(chapters.schema["ord"].dataType, NumericType):
        # chapters that are ordered by a name: it stands in front of the chapter's own, and nothing numbers them
        placed = chapters.select("manuscript_id", F.concat_ws("\x01", F.col("ord").cast("string"), "chapter").alias("chapter"), F.lit(None).cast("long").alias("ord"), "raw")
    growing = over_frames(phrases.escalation_findings(SPARK, "chapters_to_check", "spans_to_check", th), chapters=placed, spans=spans)
    known = found.filter("check_name = 'phrase_repetition'").groupBy("manuscript_id").agg(F.collect_set(F.lower("item")).alias("watched"))
    spans = spans.join(known, "manuscript_id", "left").filter(F.col("watched").isNull() | ~F.exists("watched", lambda w: F.contains(w, F.col("phrase"))))
    text, number = (lambda x: F.lit(x).cast("string")), (lambda x: F.lit(x).cast("double"))
    extra = spans.select("manuscript_id", text(None).alias("chapter"), text("discovered_repetition").alias("check_name"), text("warn").alias("severity"), F.col("phrase").alias("item"), "n", F.col("n").cast("double").alias("measured"), number(None).alias("low"), number(th["ngram_min_count"]).alias("high"))
    spellings = F.size(F.split("variants", ",")).cast("long")
    names = greedy_variants(capitalised(chapters)).select("manuscript_id", text(None).alias("chapter"), text("entity_variant").alias("check_name"), text("warn").alias("severity"), F.col("variants").alias("item"), spellings.alias("n"), spellings.cast("double").alias("measured"), number(None).alias("low"), number(1).alias("high"))
    return found.unionByName(growing).unionByName(extra).unionByName(names)


def repeats(chapters: DataFrame, profile: str = "", overrides: dict[str, float] | None = None) -> DataFrame:
    """Maximal repeats: manuscript_id, phrase, len, n, chs."""
    return over_frames(plans.repeats(SPARK, "chapters_to_check", plans.thresholds(profile, overrides)), chapters=chapters.filter("raw IS NOT NULL"))
