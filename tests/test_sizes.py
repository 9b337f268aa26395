"""What keeps plans small on large tables, with the results that they must not change."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.dialect import SPARK
from folioscope.operators import audits, human_pass
from folioscope.operators.lint import over_frames
from folioscope.plans import derived, lint
from folioscope.plans.audits import proof_places
from folioscope.plans.contain import coverage

CHAPTERS = "manuscript_id string, chapter string, ord long, raw string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_failures_are_the_findings_that_fail(spark):
    """Only what can fail is reckoned: no syllables, adverbs, modern words or echoes."""
    dashes = "It was late — not cold but wet — and exactly so -- my own particular truth. I understood, exactly."
    plain = "He walked, quietly and slowly, to the governance office.\n\n" * 8
    rows = [("a", f"chapter-{i}.md", i, f"# Chapter {i}\n\n{dashes}\n\n{plain}" + "It was the truth." * (i % 2)) for i in range(7)] + [("b", "chapter-1.md", 1, "<!-- nothing -->"), ("c", "x", 1, plain)]
    chapters = spark.createDataFrame(rows, CHAPTERS)
    th = lint.thresholds()
    all_found = over_frames(lint.findings(SPARK, "chapters_to_check", th), chapters=chapters).where("severity = 'fail'")
    failing = over_frames(lint.failures(SPARK, "chapters_to_check", th), chapters=chapters)
    found = sorted(map(str, failing.collect()))
    assert found == sorted(map(str, all_found.collect()))
    assert {r.check_name for r in failing.collect()} >= {"em_dash_density", "phrase_repetition", "manuscript", "opener_monotony"}
    assert "aeiouy" not in _plan(failing) and "governance" not in _plan(failing)


def test_doubled_words_are_counted_without_an_array_of_words(spark):
    """Three words are one place, four are two; case is that of each word, also where it looks at its neighbours."""
    texts = ["the the", "The the THE", "a a a a", "a-a a", "bathe the the", "a. a", "a\n\n a", "ΟΔΟΣ οδος", "οδοσ ΟΔΟΣ x x", "été Été", "a_a a_a", "a b a b", "x1 x1 x1y x1y"]
    wanted = [1, 1, 2, 1, 1, None, 1, 1, 1, 1, 1, None, 2]
    chapters = spark.createDataFrame([("m", f"{i:02}", i, t) for i, t in enumerate(texts)], CHAPTERS)
    found = audits.proof(chapters).where("check_name = 'doubled_words'")
    by = {r.chapter: r.n for r in found.collect()}
    assert [by.get(f"{i:02}") for i in range(len(texts))] == wanted
    assert r"\s+\1" in _plan(found)


def test_gate_texts_stay_where_they_are_read(spark):
    """A bank's terms travel to the texts; a text is put into lower case once for all terms."""
    chapters = spark.createDataFrame([("m", "c1", 1, "BREAD and gold"), ("m", "c2", 2, None), ("n", "c1", 1, "salt")], CHAPTERS)
    bank = spark.createDataFrame([("m", 1, 'texture id=a term="bread" kind=object src=x'), ("m", 2, 'texture id=b term="silver" kind=object src=x'), ("n", 1, 'texture id=c term="SALT" kind=object src=x')], "manuscript_id string, lineno long, line string")
    found = audits.texture(bank, chapters).where("check_name = 'unused_texture'")
    assert [(r.manuscript_id, r.item) for r in found.collect()] == [("m", "b")]
    assert "strategy=broadcast" in _plan(audits.texture(bank, chapters).select(F.lit(1)))


def test_flaws_not_words_are_rows(spark):
    """Places of doubled words by hand: three in a row are two, blanks of any kind between, case by each word; no word is a row."""
    texts = ["The the THE end", "x\nsee\n\n see  it", "ΟΔΟΣ οδος s ſ", "bathe the\x1fthe", "so  so � \x07", "a-a a"]
    chapters = spark.createDataFrame([("m", f"{i}", i, t) for i, t in enumerate(texts)], CHAPTERS)
    found = over_frames(proof_places(SPARK, "chapters_to_check"), chapters=chapters)
    wanted = {
        ("0", "doubled_words", 0, 1, "The the THE end"), ("0", "doubled_words", 4, 1, "The the THE end"), ("1", "doubled_words", 2, 2, "x see   see  it"), ("1", "doubled_spaces", 10, 4, "x see   see  it"),
        ("2", "doubled_words", 0, 1, "ΟΔΟΣ οδος s ſ"), ("3", "doubled_words", 6, 1, "bathe the\x1fthe"), ("4", "doubled_words", 0, 1, "so  so � \x07"), ("4", "doubled_spaces", 1, 1, "so  so � \x07"),
        ("4", "mojibake", 7, 1, "so  so � \x07"), ("4", "control_character", 9, 1, "so  so � \x07"), ("5", "doubled_words", 2, 1, "a-a a"),
    }
    assert {(r.chapter, r.check_name, r.start, r.line, r.excerpt) for r in found.collect()} == wanted
    assert _plan(found).count("Generate ") == 2


def test_lines_leave_a_batch_in_parts(spark):
    """More lines than leave together, rows without any between; texts reach Python as Arrow, not all as strings at once."""
    text = "It was late. “Go,” she said. He ran like a dog through the rain all night. Truth is a debt. The end came."
    rows = [("m", f"c{i}", i, None if i % 5 == 0 else text) for i in range(600)]
    chapters = spark.createDataFrame(rows, CHAPTERS).coalesce(1)
    lines = human_pass.select_lines(chapters)
    wanted = [(k, x["kind"], x["start"], x["end"], x["text"]) for k, x in enumerate(human_pass.choose(text), 1)]
    found = {}
    for r in lines.collect():
        found.setdefault(r.chapter, []).append((r["index"], r.kind, r.start, r.end, r.text))
    assert len(found) == 480 and 480 * len(wanted) > 2 * 1024 and all(sorted(v) == wanted for v in found.values())
    assert "MapInArrow" in _plan(lines)


def test_runs_are_joined_where_a_text_has_a_long_one(spark):
    """A term over the border of two parts of a long run is found; the plan asks for such a run first."""
    long_run = "x" * 40 + "needleinthehaystack" + "y" * 60
    chapters = spark.createDataFrame([("m", "a", 1, f"see {long_run} here"), ("m", "b", 2, "no needle here")], CHAPTERS)
    terms = spark.createDataFrame([(1, "NeedleInTheHaystack"), (2, "needle"), (3, "absent")], "id long, term string")
    found = over_frames(f"SELECT id, chapters, total FROM {coverage(SPARK, 'terms_to_check', 'chapters_to_check')} x", chapters=chapters, terms=terms)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (2, 2, 2), (3, 0, 0)]
    assert "exists(" in _plan(found)


def test_scores_read_lines_once():
    """Three dimensions of a line are told from one grouping of the lines on Spark."""
    assert derived.relations(SPARK, "score_board")["scores"].count("FROM lineitem") == 1
