"""What the rules must yield, stated by hand, over inline rows and over relations of the caller's own."""

import pytest

from folioscope.operators import lint, relations
from folioscope.functions.dialect import SPARK
from folioscope.plans import catalogue, registry

DATA = "/root/testdata/sf0.001"


def rows(frame, *columns):
    return {tuple(r[c] for c in columns) for r in frame.collect()}


def inline(spark, name, *columns):
    """The plan over its inline rows."""
    return rows(spark.sql(registry.doubles(catalogue.BUILDERS[name](SPARK))), *columns)


def chapters(spark, *raws, name="m"):
    return spark.createDataFrame([(name, f"chapter-{i:02}.md", i, raw) for i, raw in enumerate(raws, 1)], "manuscript_id string, chapter string, ord long, raw string")


def test_every_plan_tells_its_relations():
    for name in catalogue.BUILDERS:
        assert relations.asked(name), name


def test_unknown_relations_are_refused(spark):
    with pytest.raises(KeyError):
        relations.run("score_board", boards=chapters(spark))
    with pytest.raises(KeyError):
        relations.run("stratified_sample", labels=chapters(spark))


def test_published_boards(spark):
    boards = {(b, i): round(a, 2) for b, i, a in inline(spark, "score_board", "book", "iteration", "average")}
    assert boards["aquarius", 4] == 9.16 and boards["protocol", 3] == 9.04 and boards["protocol", 2] == 8.95
    told = {(b, i): (ok, far, gap) for b, i, ok, far, gap in inline(spark, "score_board", "book", "iteration", "approved", "diverges", "bottleneck")}
    assert told["aquarius", 4] == (True, False, False) and told["b1", 2] == (True, False, False) and told["b1", 1] == (False, False, False)
    assert told["protocol", 3] == (False, True, False) and told["protocol", 2] == (False, None, False) and told["b2", 1][:2] == (False, True)


def test_a_board_of_the_callers(spark):
    scores = spark.createDataFrame([("x", 1, f"d{i}", 1.0, 9.2) for i in range(10)], "book string, iteration long, dimension string, weight double, score double")
    full = spark.createDataFrame([("x", 1, 10, "", 9.0)], "book string, iteration long, evidenced long, audit string, viability double")
    assert rows(relations.run("score_board", scores=scores, dossiers=full), "lowest", "average", "approved") == {(9.2, 9.2, True)}
    assert rows(relations.run("score_board", scores=scores, dossiers=full.limit(0)), "approved", "diverges") == {(False, None)}
    assert relations.run("score_board", scores=scores.limit(0)).count() == 0


def test_indices(spark):
    launch = {b: (s, x, band) for b, s, x, band in inline(spark, "launch_index", "book", "shareability", "launch", "band")}
    assert launch["parable"][0] == pytest.approx(0.6 * 10 + 0.4 * 16 / 3, abs=1e-6)
    assert launch["parable"][1] == pytest.approx(0.2 * (8 + 9 + 8 + launch["parable"][0]) + 1.0 + 0.5 + 0.5, abs=1e-5)
    assert launch["essay"][2] == "risk" and launch["thriller"][2] == "breakout"
    legacy = {b: x for b, x in inline(spark, "legacy_index", "book", "legacy")}
    assert legacy["parable"] == pytest.approx(0.2 * 7 + 0.2 * 7.5 + 0.2 * 5 + 0.15 * 4 + 0.25 * 10) and legacy["habits"] == pytest.approx(0.15 * 14 + 0.2 * 7 + 0.15 * 4 + 0.1 * 5 + 0.25 * 10)
    assert inline(spark, "swarm_readiness", "book", "readiness") == {("b1", 8.3), ("b2", 7.2), ("b3", 6.7)}


def test_verdicts(spark):
    found = {(b, c): v for b, c, v in inline(spark, "chapter_verdicts", "book", "chapter", "verdict")}
    assert found == {("b1", 1): "PASS", ("b1", 2): "POLISH", ("b1", 3): "POLISH", ("b1", 4): "FAIL", ("b2", 1): "POLISH", ("b2", 2): "FAIL", ("b3", 1): None}
    missed = {(b, c): m for b, c, m in inline(spark, "gate_limits", "book", "chapter", "missed")}
    assert missed == {("b1", 1): "", ("b1", 2): "dashes,extensions,floor,patterns,reader", ("b2", 1): "dashes", ("b3", 1): ""}
    assert {(b, c): p for b, c, p in inline(spark, "pattern_penalty", "book", "chapter", "penalty")} == {("b1", 1): -0.125 - 0.25 - 0.5, ("b2", 1): -0.25 - 0.5}
    assert inline(spark, "pattern_bands", "book", "band", "overcorrected") == {("b1", "clean", False), ("b2", "watch", False), ("b3", "clean", True), ("b4", "fingerprint", False), ("b5", "clean", False), ("b6", "watch", False), ("b7", "clean", False)}
    assert inline(spark, "prose_caps", "book", "chapter", "capped") == {("b1", 1, 8.8), ("b1", 2, 7.5), ("b1", 3, 7.0), ("b2", 1, 8.1), ("b3", 1, 7.5)}
    assert inline(spark, "supplement_bands", "book", "band") == {("b1", "clean"), ("b2", "watch"), ("b3", "fidelity failure")}
    severity = {i: (s, v) for i, s, v in inline(spark, "issue_spread", "issue", "spread", "severity")}
    assert severity == {"dash": ("SYSTEMIC", "CRITICAL"), "echo": ("LOCAL", "IMPORTANT"), "pace": ("WATCH", "INVESTIGATE"), "lore": ("LOCAL", "NOTED"), "voice": ("LOCAL", "SHOULD FIX"), "end": ("LOCAL", "IMPORTANT")}


def test_continuity(spark):
    assert inline(spark, "knowledge_gaps", "who", "fact") == {("John", "letter"), ("Anna", "key")}
    merged = {(e, f): (v, a) for e, f, v, a in inline(spark, "entity_merge", "entity", "field", "val", "action")}
    assert merged == {("Mary", "eyes"): ("grey", "skip"), ("Mary", "age"): ("20", "resolved"), ("Mary", "hair"): ("dark", "conflict"), ("John", "eyes"): ("blue", "keep"), ("John", "scar"): ("left", "resolved"), ("Anna", "eyes"): ("green", "insert")}
    patched = {(e, f): (v, o) for e, f, v, o in inline(spark, "entity_patches", "entity", "field", "val", "outcome")}
    assert patched[("Mary", "age")] == ("20", "applied") and patched[("Mary", "fire")] == ("knows", "applied") and patched[("John", "eyes")] == ("blue", "exists") and patched[("Paul", "age")] == (None, "missing") and patched[("John", "scar")] == ("left", "unknown action")
    assert inline(spark, "teleports", "entity", "ord") == {("Mary", 3), ("John", 5)}
    assert inline(spark, "open_objects", "thing", "level") == {("key", "warning"), ("map", "minor")}
    assert inline(spark, "coverage_gaps", "entity", "gap", "level") == {("Paul", "untracked entity", "warning"), ("Guard", "untracked entity", "warning"), ("Dog", "untracked entity", "minor"), ("Mary", "stale state", "warning")}
    assert inline(spark, "revision_neighbours", "book", "ord") == {("b1", 1), ("b1", 2), ("b1", 4), ("b1", 5), ("b1", 6), ("b2", 1), ("b2", 2)}
    assert inline(spark, "voice_bank", "book", "kind", "has") == {("b2", "any", 2), ("b2", "voice-breaking", 0), ("b2", "irrelevant-thought", 0)}
    assert inline(spark, "premise_winner", "winner", "lowest", "passes") == {("sea", 8.2, True)}
    assert inline(spark, "hook_targets", "book", "chapter", "weak_hook") >= {("b1", 1, True), ("b1", 2, False), ("b1", 3, True), ("b2", 1, False)}


def test_mechanical_rules(spark):
    text = "It was the kind of day that ends. He chose to utilize the plethora, upon reflection.  Not because of grief and loss but because he left — She stayed."
    frame = chapters(spark, text)
    (found,) = relations.run("mechanical_scan", chapters=frame).collect()
    assert (found.the_kind_of, found.not_because, found.it_was_the_sort, found.doubled_abstracts, found.forbidden) == (1, 1, 1, 1, 2)
    (revised,) = relations.run("safe_replacements", chapters=frame).collect()
    assert "use the plethora, on reflection. Not because" in revised.revised and "he left. She stayed" in revised.revised


def test_attribution(spark):
    spoken = inline(spark, "dialogue_orders", "chapter", "speaker", "line")
    first = {("Mary", "We go now,"), ("Mary", "The house is mine."), ("John", "I see,"), ("John", "So be it."), ("Mary", "Leave it."), ("John", "Why?")}
    second = {("McKay", "Not yet,"), ("O’Brien", "Soon,"), ("Jean-Luc", "Never,"), ("Jean-Luc", "never again."), ("Zoë", "Perhaps,"), ("?", "Hm."), ("Anna", "Yes!")}
    assert spoken == {("chapter-01.md", *x) for x in first} | {("chapter-02.md", *x) for x in second}


def test_signatures(spark):
    frame = chapters(spark, *["“Is it requited, or is it not? I think so.” said Mary.\n\n“It isn’t rather the dogs' day?” said John."] * 5)
    found = {r.speaker: r for r in relations.run("speaker_stats", chapters=frame).collect()}
    assert (found["Mary"].questions, found["Mary"].contractions, found["Mary"].qualifiers) == (0.0, 0.0, round(1 / 10, 6))
    assert found["John"].questions == 1.0 and found["John"].contractions == round(1 / 6, 6) and found["John"].qualifiers == round(1 / 6, 6)


def test_drift(spark):
    assert inline(spark, "voice_drift", "manuscript_id", "kind", "who") == {("m5", "drift", "John / Mary"), ("m5", "insufficient", "Devon")}
    assert inline(spark, "voice_collision", "manuscript_id", "pair") == {("m6", "John / Mary")}
    from folioscope.plans import fixtures

    frame = spark.createDataFrame(fixtures.VOICES, "manuscript_id string, chapter string, ord long, raw string")
    found = rows(lint.lint(frame).where("check_name LIKE 'voice%'"), "manuscript_id", "check_name", "item")
    assert found == {("m5", "voice_drift", "John / Mary"), ("m5", "voice_drift_insufficient_data", "Devon"), ("m6", "voice_collision", "John / Mary")}


def test_evidence_tiers(spark):
    def tier(*responses):
        table = spark.createDataFrame([(i, f"r{i}", str(c), str(r), "", "") for i, (c, r) in enumerate(responses)], "row_no long, reader_id string, chapter string, rating string, comment string, delayed string")
        return next(r.tier for r in relations.run("evidence_summary", evidence=table).collect() if r.chapter_no is None)

    assert tier((1, 5)) == "weak" and tier((1, 5), (1, 4), (1, 3)) == "weak" and tier((1, 5), (2, 4), (2, 3)) == "moderate"
    assert tier(*((i % 3, 4) for i in range(6))) == "moderate" and tier(*((i % 3, 4) for i in range(5)), (2, 2)) == "strong"


def test_gates(spark):
    assert inline(spark, "gate_verdict", "gate", "ok", "pending", "blocking", "advised") == {
        ("g1", True, 0, "", "macro"), ("g2", False, 0, "lint", ""), ("g3", False, 0, "bogus", ""), ("g4", True, 0, "", "dynamic_range"), ("g5", False, 0, "epub", ""), ("g6", False, 2, "", ""),
    }
    assert inline(spark, "headline_range", "book", "n", "status") == {("flat", 6, "fail"), ("lively", 6, "pass"), ("short", 2, "skip")}


def test_state(spark):
    codes = {(p, s): (c, after) for p, s, c, after in inline(spark, "state_events", "project", "seq", "code", "phase_after")}
    wanted = ["ok", "human-gate-required", "ok", "stale-phase", "schema-validation", "allowlist-violation", "schema-validation", "ok", "stale-phase", "ok"]
    assert [codes["p1", i][0] for i in range(1, 11)] == wanted
    assert [codes["p1", i][1] for i in (1, 2, 3, 4, 10)] == ["draft", "draft", "review", "review", "review"]
    assert [codes["p2", i][0] for i in (1, 2, 3)] == ["ok", "ok", "allowlist-violation"]
    assert inline(spark, "state_lookup", "key", "val") == {("title", "The Jar"), ("book.title", "Other"), ("completed", "7"), ("chapters.meta.completed", "6"), ("current", "draft"), ("nothing", None)}
    assert ("p1", "project.title", "Old") in inline(spark, "state_fold", "project", "path", "val")


def test_overrides(spark):
    found = {k: (v, w) for k, v, w in inline(spark, "style_overrides", "k", "resolved", "warning")}
    assert found["em_dash_per_1k"] == (3.5, None) and found["adverb_per_1k"] == (10.5, "bad value") and found["colour"] == (None, "unknown key")
    assert found["min_chapter_words"] == (150.0, None) and found["echo_window_words"] == (50.0, "bad value") and found["fk_grade_max"] == (10.0, None)
    derived = {(p, k): (c, a) for p, k, c, a in inline(spark, "derived_overrides", "profile", "k", "candidate", "applies")}
    assert derived["", "em_dash_per_1k"] == (2.5, True) and derived["", "adverb_per_1k"] == (62.5, False) and not any(a for (p, _), (_, a) in derived.items() if p == "commercial")


def test_agents(spark):
    assert inline(spark, "agent_lookup", "name", "key", "family") == {("book_writer", "book_writer", "claude"), ("Book Writer", "book_writer", "claude"), ("Story Bible", "editor", "openai"), ("nobody", None, None)}


def test_archives_and_files(spark):
    assert inline(spark, "archive_links", "problem", "name") == {("missing file", "chapter-02.xhtml"), ("unknown item", "c3")}
    assert inline(spark, "pending_outputs", "path", "reason") == {("OUTLINE.md", "template"), ("chapter-01.md", "missing"), ("STYLE.md", "empty"), ("PLAN.md", "template")}
    assert inline(spark, "phase_transition", "project", "phase_after", "bypassed") == {("p1", "review", False), ("p2", "draft", False), ("p3", "completed", False), ("p4", "draft", True)}


def test_proof_places(spark):
    found = inline(spark, "proof_excerpts", "chapter", "check_name", "line")
    assert found == {
        ("chapter-01.md", "doubled_words", 3), ("chapter-01.md", "doubled_words", 5), ("chapter-01.md", "doubled_spaces", 3),
        ("chapter-02.md", "mojibake", 1), ("chapter-02.md", "control_character", 1), ("chapter-02.md", "doubled_spaces", 2),
    }
    excerpts = {c: e for c, k, e in inline(spark, "proof_excerpts", "chapter", "check_name", "excerpt") if k == "mojibake"}
    assert "cafÃ© was" in excerpts["chapter-02.md"]
