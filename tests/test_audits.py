"""Proof, macro, chronology and texture findings: what each rule must flag and must leave alone."""

import re

import pytest

from folioscope.operators import audits, relations
from folioscope.sinks import reports

CHAPTERS = "manuscript_id string, chapter string, ord long, raw string"
LINES = "manuscript_id string, lineno long, line string"


def chapters(spark, *raw, name="chapter-{:02d}.md"):
    return spark.createDataFrame([("m", name.format(i), i, r) for i, r in enumerate(raw, 1)], CHAPTERS)


def checks(found):
    return {(r.check_name, r.item, r.n) for r in found.collect()}


PROOF = [
    ("She she went home. The the the end.", ("doubled_words", None, 2)),
    ("He walked  slowly on.", ("doubled_spaces", None, 1)),
    ("“Who is there?\n\nNobody.", ("unbalanced_quotes", None, 1)),
    ("It was (late.", ("unbalanced_delims", None, 1)),
    ("Cold — cold -- very.", ("dash_consistency", None, 2)),
    ("“So.” And \"then\" and 'tis.", ("quote_style_mixing", None, 2)),
    ("Well… and... then....", ("ellipsis_consistency", None, 2)),
    ("# One\n\nText.\n\n# Two\n\nText.", ("heading_levels", None, 2)),
    ("# One\n\n## Two\n\nText.\n\n## Three", ("empty_sections", None, 2)),
    ("It was â€™ and \x07.", ("mojibake", None, 2)),
    ("# Chapter 6\n\nText.", ("chapter_numbering", "heading differs", 1)),
]


@pytest.mark.parametrize("raw,wanted", PROOF)
def test_proof_flags(spark, raw, wanted):
    assert checks(audits.proof(chapters(spark, raw))) == {wanted}


@pytest.mark.parametrize("raw", ["“One.\n\n“Two.”", "He had had_it, it; it's so.", "<!-- a -- b — c -->\n\nPlain text.", "", None, "# Title\n\nBody (with) text."])
def test_proof_leaves_alone(spark, raw):
    assert not checks(audits.proof(chapters(spark, raw)))


def test_proof_over_chapters(spark):
    rows = spark.createDataFrame([("m", "chapter-01.md", 1, "One.\n\n***\n\nTwo."), ("m", "chapter-03.md", 2, "One.\n\n---\n\nTwo."), ("m", "notes.md", 3, "One.")], CHAPTERS)
    assert checks(audits.proof(rows)) == {("chapter_numbering", "gap", 1), ("chapter_numbering", "no number in the name", 1), ("scene_break_consistency", None, 2)}
    assert audits.proof(rows.limit(0)).count() == 0


def test_doubled_words_against_pattern(spark):
    texts = ["a a a a b", "don't t", "x. x x", "é É e", "one\n one", "two two, two two two", "a1 A1 a_1 a_1", "- - a a-a a"]
    found = {r.chapter: r.n for r in audits.proof(chapters(spark, *texts)).filter("check_name = 'doubled_words'").collect()}
    wanted = {f"chapter-{i:02d}.md": len(re.findall(r"\b(\w+)\s+\1\b", t, re.I)) for i, t in enumerate(texts, 1)}
    assert found == {k: v for k, v in wanted.items() if v}


def test_macro(spark):
    same = "# Chapter {}: The Jar\n\n“Go,” she said. The door was open and the road lay dark.\n\n***\n\nHe carried the lamp over to the wall."
    six = chapters(spark, *[same.format(i) for i in range(6)])
    assert checks(audits.macro(six)) == {("opening_mode_share", "dialogue", 6), ("closing_mode_share", "image-action", 6), ("title_parallelism", "the", 6), ("scene_break_uniformity", "1", 6)}
    assert not checks(audits.macro(chapters(spark, *[same.format(i) for i in range(5)])))


def test_timeline(spark):
    text = """event id=birth day=-3287
event id=feast day=0
event id=trip day=2w
event id=trip day=3
age person=Mary at=birth years=9
age person=Mary at=feast years=19
age person=John at=nowhere years=3
span from=feast to=trip stated=14d
span from=feast to=trip stated=3d
span from=trip to=feast stated=-14
once id=wed at=feast
once id=wed at=trip
once id=fair at=trip
event id=x day=soon
age person=Paul
bogus a=b"""
    rows = spark.createDataFrame([("m", i, x) for i, x in enumerate(text.split("\n"), 1)] + [("m", 90, "# no"), ("m", 91, ""), ("m", 92, None)], LINES)
    found = {(r.check_name, r.item) for r in audits.timeline(rows).collect()}
    assert found == {
        ("parse", "line 4: id stands before"), ("parse", "line 14: no number"), ("parse", "line 15: field missing"), ("parse", "line 16: unknown record"),
        ("unknown_event", "nowhere"), ("span_contradiction", "feast to trip"), ("reversed_span", "trip to feast"), ("duplicate_occurrence", "wed"), ("age_contradiction", "Mary"),
    }


def test_texture(spark):
    lines = ['texture id=t1 term="Bread" kind=object src=a', 'texture id=t2 term="lamp" kind=food', 'texture id=t1 term="x"', "texture id=t3", 'texture id=t4 term="rain (heavy" kind=weather src=b']
    bank = spark.createDataFrame([("m", i, x) for i, x in enumerate(lines, 1)], LINES)
    found = {(r.check_name, r.item) for r in audits.texture(bank, chapters(spark, "The bread. rain (heavy) fell.", None)).collect()}
    assert found == {("parse", "line 3: id stands before"), ("parse", "line 4: field missing"), ("missing_src", "t2"), ("unknown_kind", "t2: food"), ("unused_texture", "t2")}


def test_audit_report(spark):
    bank, records = (spark.createDataFrame([("m", 1, x)], LINES) for x in ("texture id=t1 term=sea", "bogus x"))
    found = audits.audit(chapters(spark, "She she went."), records, bank)
    (row,) = reports.markdown(found, "Audit").collect()
    assert not row.passed and all(x in row.report for x in ("doubled_words", "unused_texture", "unknown record", "short_chapter"))


def test_the_timeline_reads_the_fields_of_a_kind_from_its_lines_alone(spark):
    """Each use of the records reads lines anew; only the one that looks for faults reads all fields of all lines."""
    lines = ["event id=a day=1", "  EVENT id=b day=3w", "event id=a day=5", "age person=p at=a years=20", "age person=p at=b years=25", "span from=b to=a stated=2d", "once id=x at=a", "once id=x at=b", "# once id=y at=q", "once id=event at=age", "", "mage person=p"]
    frame = relations.run("timeline_issues", records=spark.createDataFrame([("m", i, x) for i, x in enumerate(lines, 1)], "manuscript_id string, lineno long, line string"))
    found = sorted((r.check_name, r["item"]) for r in frame.collect())
    assert found == [("age_contradiction", "p"), ("duplicate_occurrence", "x"), ("parse", "line 12: unknown record"), ("parse", "line 3: id stands before"), ("reversed_span", "b to a"), ("span_contradiction", "b to a"), ("unknown_event", "age")]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("person=") <= 2 * (1 + 3), "person is read by the faults and the three uses of ages at most"
