"""Reports of findings as Markdown, gate verdicts as JSON, style profiles as YAML, archives before an overwrite.

Texts are put together by aggregates, one per manuscript, and written by Spark; nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of severities in a report.
SEVERITIES = ["fail", "warn", "info"]


def markdown(findings: DataFrame, title: str = "Lint Report") -> DataFrame:
    """manuscript_id, passed (no finding fails), report: one section per severity, findings by check, chapter and item."""
    limit = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.format_string("%s to %s", F.col("low").cast("string"), F.col("high").cast("string")))
    limit = limit.when(F.col("high").isNotNull(), F.concat(F.lit("at most "), F.col("high").cast("string"))).when(F.col("low").isNotNull(), F.concat(F.lit("at least "), F.col("low").cast("string"))).otherwise(F.lit("none"))
    row = F.concat(F.lit("- **"), "check_name", F.lit("**"), *[F.coalesce(F.concat(F.lit(sep), c), F.lit("")) for sep, c in ((" in ", F.col("chapter")), (": ", F.col("item")))], F.lit(" measured "), F.coalesce(F.col("measured").cast("string"), F.lit("-")), F.lit(", limit "), limit)
    sorted_rows = F.array_sort(F.collect_list(F.struct("severity", "check_name", F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("item", F.lit("")).alias("item"), row.alias("line"))))
    per = findings.groupBy("manuscript_id").agg(sorted_rows.alias("rows"))
    section = lambda s: F.when(F.exists("rows", lambda r: r.severity == s), F.concat(F.lit(f"\n\n## {s}\n\n"), F.array_join(F.transform(F.filter("rows", lambda r: r.severity == s), lambda r: r.line), "\n"))).otherwise(F.lit(""))
    passed = ~F.exists("rows", lambda r: r.severity == "fail")
    return per.select("manuscript_id", passed.alias("passed"), F.concat(F.lit(f"# {title}\n\nVerdict: "), F.when(passed, "PASS").otherwise("FAIL"), *[section(s) for s in SEVERITIES]).alias("report"))


def write_texts(texts: DataFrame, path: str, column: str = "report") -> None:
    """One text per manuscript under path/manuscript_id=.../"""
    texts.select("manuscript_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("manuscript_id").text(path)


def verdicts_json(verdicts: DataFrame) -> DataFrame:
    """Each row as a JSON object, fields in column order."""
    return verdicts.select(F.to_json(F.struct(*verdicts.columns), {"ignoreNullFields": "false"}).alias("value"))


def profile_yaml(overrides: DataFrame) -> DataFrame:
    """Suggested overrides (manuscript_id, k, v) as a style profile of each manuscript."""
    pairs = F.array_sort(F.collect_list(F.struct("k", "v")))
    return overrides.groupBy("manuscript_id").agg(F.concat(F.lit("thresholds:\n"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("  "), p.k, F.lit(": "), p.v.cast("string"))), "\n"), F.lit("\n")).alias("report"))


def profiles_json(profiles: DataFrame, path: str) -> None:
    """Word profiles (profile, total_words, word, rate) as JSON objects that the profile source reads."""
    whole = profiles.groupBy(F.col("profile").alias("name"), "total_words").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "rate")))).alias("frequencies"))
    whole.write.mode("overwrite").json(path)


def archived(chapters: DataFrame, path: str, version: str) -> None:
    """Keeps the present texts under path/version=... before they are overwritten; an existing version is an error."""
    chapters.write.mode("errorifexists").parquet(f"{path}/version={version}")
