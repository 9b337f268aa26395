"""Queries of the operators that SQL cannot express; tests hold them against brute force and round trips."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.functions.dialect import SPARK
from folioscope.operators import clusters, gates, human_pass, markup
from folioscope.operators.lint import lint, over_frames
from folioscope.plans import derived, fixtures
from folioscope.plans.registry import COVERS, QUERIES, table
from folioscope.sinks import epub, reports

NAMES: list[str] = []


def _query(covers: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__], COVERS[run.__name__] = run, covers
        NAMES.append(run.__name__)
        return run

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("source AS manuscript_id", "CAST(doc_id AS STRING) AS chapter", "doc_id AS ord", "text AS raw")


def _chapters(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {SPARK.values(fixtures.CHAPTERS, 'manuscript_id, chapter, ord, raw')}")


@_query("P8 P9 P3 W18 K12")
def human_pass_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to rewrite by hand in every document."""
    return human_pass.select_lines(_documents(spark, sf_dir))


@_query("S9 J17 W19")
def human_pass_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheets written, read back with each opening rewritten, and spliced in."""
    chapters = _chapters(spark)
    entries, _ = human_pass.parse_worksheets(human_pass.worksheet(human_pass.select_lines(chapters)))
    return human_pass.splice(chapters, entries.selectExpr("* EXCEPT (rewrite)", "CASE WHEN kind = 'opening' THEN concat('So: ', original) ELSE rewrite END AS rewrite"))


@_query("P17 C7")
def markdown_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.compile_chapters(_documents(spark, sf_dir))


@_query("K9 C5 C7")
def epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.books(_chapters(spark)).selectExpr("manuscript_id", "sha2(epub, 256) AS digest", "length(epub) AS n_bytes", "size(errors) AS n_errors")


@_query("J10 A19 O7")
def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the capitalised words of every source, three times or more."""
    return clusters.greedy_variants(clusters.capitalised(_documents(spark, sf_dir).where("raw IS NOT NULL")))


@_query("K1 K2 O1 O2")
def lint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the fixture's manuscripts, all checks."""
    return reports.markdown(lint(_chapters(spark)))


def _gate_relations(spark: SparkSession, sf_dir: str) -> gates.Relations:
    """What the checks read of the documents, each source a book: its settings, chronology and reports are told by their columns."""
    docs, labels, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    of, books = derived.relations(SPARK, ""), docs.selectExpr("source AS manuscript_id", "CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS no").distinct()
    told = lambda key, value: books.selectExpr("manuscript_id", f"'{key}' AS key", f"{value} AS value")
    settings = told("project.language", "CASE WHEN no % 4 = 1 THEN 'de' ELSE 'en' END").unionByName(told("project.word_count_target", "CAST(8000 + no * 3000 AS STRING)")).unionByName(told("project.skip_human_pass", "CASE WHEN no % 5 = 0 THEN 'true' END")).unionByName(told("project.lint_profile", "CASE WHEN no % 3 = 0 THEN 'historical' END"))
    records = docs.selectExpr("source AS manuscript_id", "doc_id AS lineno", "CASE WHEN doc_id % 7 = 0 THEN concat('once id=x', n_chars % 50, ' at=d', doc_id + 1) ELSE concat('event id=d', doc_id, ' day=', n_chars) END AS line").where("manuscript_id NOT LIKE '%2'")
    lexicon = books.selectExpr("manuscript_id", "explode(array('the', 'and')) AS never_say", "'?' AS who").where("no % 2 = 0")
    floors = docs.join(labels, "doc_id").selectExpr("source AS manuscript_id", "concat('eval-chapter-', doc_id, '.md') AS name", "concat('**Overall Floor:** ', CAST(8 + quality AS STRING), '.', CAST(toxic AS STRING)) AS raw")
    metas = books.selectExpr("manuscript_id", "manuscript_id AS title", "CASE WHEN no % 6 <> 0 THEN 'A. Writer' END AS author", "'en' AS language")
    given = lambda name, **frames: over_frames("SELECT * FROM " + re.sub(r"FROM (documents|benchmark)\b", r"FROM \1_to_check", of[name]), **frames)
    chapters, reports = given("chapters", documents=docs), given("reports", documents=docs)
    return gates.Relations(chapters, settings, records, given("bank", documents=docs, benchmark=items), reports, lexicon, floors, metas, books.where("no % 2 = 1"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = [*gates.CHECKS, "timeline:required", "wordcount:0.5:2", "dynamic_range:0.3", "human_pass:1", "bogus"]
    return table(spark, sf_dir, "documents").select("source").distinct().selectExpr("source AS gate", "source AS manuscript_id", "explode(array(" + ", ".join(f"'{t}'" for t in tokens) + ")) AS token")


@_query("J18 FL12 A37 C18")
def gate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all checks over the documents, each source a book with a gate of its own."""
    return gates.run(_manifest(spark, sf_dir), _gate_relations(spark, sf_dir))


@_query("J18 FL12 A37 U6")
def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's gate says, those with an empty document having an output pending."""
    pending = table(spark, sf_dir, "documents").where("trim(coalesce(text, '')) = ''").selectExpr("source AS gate", "CAST(doc_id AS STRING) AS path")
    return gates.verdicts(gate_runs(spark, sf_dir), pending)
