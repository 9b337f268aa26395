"""Proof, macro, chronology and texture findings of any relations, and all of a manuscript's findings in one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioscope.functions.dialect import SPARK
from folioscope.operators.lint import lint, over_frames
from folioscope.plans import audits as plans
from folioscope.plans import places as spans


def proof(chapters: DataFrame) -> DataFrame:
    """Typographic findings of chapters (manuscript_id, chapter, ord, raw); null texts are left out."""
    return over_frames(plans.proof(SPARK, "chapters_to_check"), chapters=chapters)


def places(chapters: DataFrame) -> DataFrame:
    """Places of all typographic flaws with severity, line and excerpt; null texts are left out."""
    return over_frames(f"SELECT * FROM {spans.places(SPARK, 'chapters_to_check')} x", chapters=chapters)


def macro(chapters: DataFrame) -> DataFrame:
    """Shapes that too many chapters share; manuscripts under six chapters have none."""
    return over_frames(plans.macro(SPARK, "chapters_to_check"), chapters=chapters)


def timeline(records: DataFrame) -> DataFrame:
    """Contradictions of chronology records (manuscript_id, lineno, line)."""
    return over_frames(plans.timeline(SPARK, "records_to_check"), records=records)


def texture(bank: DataFrame, chapters: DataFrame) -> DataFrame:
    """Findings of a texture bank (manuscript_id, lineno, line) over the chapters."""
    return over_frames(plans.texture(SPARK, "bank_to_check", "chapters_to_check"), bank=bank, chapters=chapters)


def audit(chapters: DataFrame, records: DataFrame | None = None, bank: DataFrame | None = None, profile: str = "") -> DataFrame:
    """Lint, proof and macro findings, with chronology and texture where there are such records."""
    found = lint(chapters, profile).unionByName(proof(chapters)).unionByName(macro(chapters))
    found = found.unionByName(timeline(records)) if records is not None else found
    return found.unionByName(texture(bank, chapters)) if bank is not None else found
