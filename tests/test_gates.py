"""Checks of a gate over small books with known results; a check that raises harms no other."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import gates

CLEAN = "# Chapter {0}\n\nThe door was open and the lamp burned low while rain fell on the stone steps.\n\nShe carried bread number {0} to the table near the window."


@pytest.fixture(scope="module")
def relations(spark):
    rows = [("good", f"chapter-{i:02}.md", i, CLEAN.format(i) + (" <!-- hp:start -->Kept.<!-- hp:end -->" if i == 1 else "")) for i in range(1, 4)]
    rows += [("bad", "chapter-01.md", 1, "# Chapter 2\n\nShe she left. “Fine,” said Ann."), ("bad", "chapter-01b.md", 2, "| a | b |"), ("bad", "chapter-02.md", 3, None)]
    rows += [("odd", "afterword.md", 1, "Ende gut.")]
    make = lambda data, schema: spark.createDataFrame(data, schema)
    lines = "manuscript_id string, lineno long, line string"
    return gates.Relations(
        make(rows, "manuscript_id string, chapter string, ord long, raw string"),
        make([("good", "project.word_count_target", "80"), ("bad", "project.word_count_target", "1000"), ("odd", "project.language", "de"), ("odd", "project.skip_human_pass", "Yes")], "manuscript_id string, key string, value string"),
        make([("good", 1, "event id=a day=1"), ("bad", 1, "once id=x at=nowhere")], lines),
        make([("good", 1, 'texture id=t term="bread" kind=object src=x'), ("bad", 1, 'texture id=t term="gold" kind=food src=x')], lines),
        make([("good", i, f"meta  chapter={i}  structure={s}") for i, s in ((1, "frame"), (2, "frame"), (3, "letter"))] + [("bad", 1, "meta chapter=1 structure=frame")], "manuscript_id string, chapter_no long, line string"),
        make([("good", "Ann", "gold"), ("bad", "ANN", "Fine")], "manuscript_id string, who string, never_say string"),
        make([("good", f"eval-chapter-{i}.md", f"**Overall Floor:** {8 + i % 2}.0") for i in range(6)] + [("bad", f"eval-chapter-{i}.md", "**Overall Floor:** 8.5") for i in range(6)] + [("odd", "eval-chapter-1.md", "**Floor:** 9.0")], "manuscript_id string, name string, raw string"),
        make([("good", "Title", "Author", "en"), ("bad", "Title", " ", "en")], "manuscript_id string, title string, author string, language string"),
        make([("good",), ("bad",)], "manuscript_id string"),
    )


WANTED = {
    "timeline": ("pass", "fail", "skip"), "timeline:required": ("pass", "fail", "fail"), "chapter_order": ("pass", "fail", "fail"), "wordcount": ("pass", "fail", "skip"), "wordcount:0.5:0.6": ("fail", "fail", "skip"), "proof": ("pass", "fail", "fail"),
    "book_meta": ("pass", "fail", "fail"), "epub": ("pass", "fail", "fail"), "macro": ("skip", "skip", "skip"), "texture": ("pass", "fail", "skip"), "human_pass": ("pass", "fail", "pass"), "human_pass:2": ("fail", "fail", "pass"), "voice_lexicon": ("pass", "fail", "skip"),
    "structure_variety": ("fail", "skip", "skip"), "dynamic_range": ("pass", "fail", "skip"), "dynamic_range:0.5": ("fail", "fail", "skip"), "lint": ("pass", None, "skip"), "": ("error", "error", "error"), "wordcounts": ("error", "error", "error"),
}


def test_statuses_are_results(spark, relations):
    manifest = spark.createDataFrame([("g", m, t) for t in WANTED for m in ("good", "bad", "odd")] + [("g", "gone", "proof"), ("g", "gone", "epub")], "gate string, manuscript_id string, token string")
    found = {(r.manuscript_id, r.token): r for r in gates.run(manifest, relations).collect()}
    for token, wanted in WANTED.items():
        for book, status in zip(("good", "bad", "odd"), wanted, strict=True):
            assert status in (None, found[book, token].status), (book, token, found[book, token])
    assert len(found) == 3 * len(WANTED) + 2 and found["gone", "proof"].status == "skip" and found["gone", "epub"].status == "fail"
    assert {r.name for r in found.values() if r.advisory} == {"macro", "texture", "voice_lexicon", "dynamic_range"}
    assert found["good", "structure_variety"].summary == "1 violations"


def test_a_raising_check_is_an_error_row(spark, relations):
    def breaks(r, asked):
        return asked.select("manuscript_id", "args", F.lit("pass").alias("status"), F.raise_error(F.lit("torn page")).cast("string").alias("summary"))

    def refuses(r, asked):
        raise RuntimeError("no such shelf")

    manifest = spark.createDataFrame([("g1", "good", "epub"), ("g1", "good", "macro"), ("g1", "good", "proof"), ("g2", "good", "macro"), ("g3", "good", "proof"), ("g4", "good", "epub")], "gate string, manuscript_id string, token string")
    results = gates.run(manifest, relations, gates.CHECKS | {"epub": breaks, "macro": refuses})
    found = {(r.gate, r.name): (r.status, r.summary) for r in results.collect()}
    assert found["g1", "proof"][0] == "pass" and found["g1", "epub"][0] == found["g1", "macro"][0] == "error"
    assert "no such shelf" in found["g1", "macro"][1]
    pending = spark.createDataFrame([("g4", "OUTLINE.md")], "gate string, path string")
    told = {r.gate: (r.ok, r.pending, r.blocking, r.advised) for r in gates.verdicts(results, pending).collect()}
    assert told == {"g1": (False, 0, "epub", "macro"), "g2": (True, 0, "", "macro"), "g3": (True, 0, "", ""), "g4": (False, 1, "", "")}


def test_every_check_runs_over_the_tables(spark):
    from folioscope.plans import library

    rows = library.gate_runs(spark, "/root/testdata/sf0.001").collect()
    assert {r.name for r in rows} == {*gates.CHECKS, "bogus"} and not [r for r in rows if r.status == "error" and r.name != "bogus"]
    assert len({r.status for r in rows}) == 4 and len({(r.gate, r.token) for r in rows}) == len(rows)
