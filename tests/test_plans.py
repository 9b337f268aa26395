"""Every plan on the smallest tables against DuckDB, and what fixtures must yield."""

import math

import duckdb
import pytest

from folioscope.functions.dialect import SPARK
from folioscope.plans import catalogue, registry
from folioscope.plans.registry import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_plan_equals_oracle(spark, oracle, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = oracle.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert found == wanted


def found(spark, name, *columns):
    """Rows of the plan over its inline relations."""
    return {tuple(r[c] for c in columns) for r in spark.sql(registry.doubles(catalogue.BUILDERS[name](SPARK))).collect()}


def test_chronology(spark):
    assert found(spark, "timeline_unknown_events", "ref") == {("nowhere",), ("lost",)}
    assert (10, "span_contradiction") in found(spark, "timeline_spans", "lineno", "verdict") and (9, "ok") in found(spark, "timeline_spans", "lineno", "verdict")
    assert found(spark, "timeline_once", "id") == {("wedding",)}


def test_dialogue(spark):
    spoken = found(spark, "dialogue_attribution", "chapter", "speaker", "line")
    assert ("chapter-01.md", "John", "Only me,") in spoken and ("chapter-01.md", "John", "Come in, then.") in spoken
    assert ("chapter-02.md", "John", "Very well.") in spoken


def test_evidence(spark):
    assert found(spark, "evidence_rows", "row_no", "fate") >= {(1, "kept"), (2, "duplicate"), (4, "rejected"), (6, "rejected"), (7, "rejected")}


def test_scores(spark):
    assert ("b1", 2, True) in found(spark, "score_board", "book", "iteration", "approved")


def test_variants(spark):
    assert ("Mariam", "Miryam") in found(spark, "name_variants", "name_a", "name_b")
    assert found(spark, "compound_variants", "variants") == {("store-room,storeroom",)}


def over(spark, folder, name, rows):
    """A plan over a documents table of its own."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return {tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()}


def by_sql(folder, name):
    """Rows of a plan's DuckDB counterpart over the same table."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return set(db.execute(catalogue.ORACLES[name]).fetchall())


def test_dashes_of_texts_without_words(spark, tmp_path):
    texts = {"a": ["", "— —"], "b": ["# Title", "one two"], "c": ["> quoted", "one — two"]}
    rows = [(10 * i + j, t, "en", s) for i, (s, ts) in enumerate(texts.items()) for j, t in enumerate(ts)]
    found = over(spark, tmp_path, "em_dash_density", rows)
    assert {("a", None, 2, 0, True), ("a", "chapter-0.md", 0, 0, True), ("a", "chapter-1.md", 2, 0, True), ("b", None, 0, 2, False), ("b", "chapter-10.md", 0, 0, True)} <= found
    assert found == by_sql(tmp_path, "em_dash_density")


def test_absence_gaps_of_words_of_any_length(spark, tmp_path):
    texts = ["Mary saw an extraordinary fox, a fox.", "fox", "fox hut", None, "hut", "fox lanterns", "Mary extraordinary hut lanterns"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(10 + i, t, "en", "b") for i, t in enumerate(["ox", "", "-", "x", "ox"])]
    held = {}
    for source in "ab":
        for at, text in enumerate((t for _, t, _, s in rows if s == source and t is not None), 1):
            for word in set((text or "").lower().replace(",", "").replace(".", "").replace("-", "").split()):
                held.setdefault((source, word), []).append(at)
    wanted = {(*k, a, b, b - a - 1) for k, at in held.items() for a, b in zip(at, at[1:]) if b - a > 3}
    assert {w[1] for w in wanted} == {"mary", "extraordinary", "ox"}
    assert over(spark, tmp_path, "absence_gaps", rows) == wanted


def test_ngrams_from_five_times_on(spark, tmp_path):
    rows = [(i, "red fox" if i < 5 else "old owl", "en", "a") for i in range(9)]
    assert over(spark, tmp_path, "ngram_containment", rows) == {("a", "red fox", 2, 5)}


def test_triples_of_texts_of_one_word(spark, tmp_path):
    texts = [("Erö.", "a")] * 5 + [("This.", "a")] * 4 + [("", "a"), ("—", "a")] * 5 + [("Old owl.", "b")] * 5 + [("Erö owl this.", "c")] * 5
    rows = [(i, t, "en", s) for i, (t, s) in enumerate(texts)]
    found = over(spark, tmp_path, "ngram_containment", rows)
    assert found == {("a", "erö  ", 3, 5), ("b", "old owl", 2, 5), ("c", "erö owl this", 3, 5)}
    assert found == by_sql(tmp_path, "ngram_containment")


def test_fingerprints_of_every_source_from_every_other(spark, tmp_path):
    rows = [(1, "sun sun moon", "en", "a"), (2, "sun moon moon", "en", "b"), (3, "sun sun sun moon", "en", "c")]
    rates = {"a": (2000 / 3, 1000 / 3), "b": (1000 / 3, 2000 / 3), "c": (750.0, 250.0)}
    wanted = {}
    for t in rates:
        others = [r for r in rates if r != t]
        sd = [abs(rates[others[0]][i] - rates[others[1]][i]) / 2 for i in (0, 1)]
        wanted |= {(t, r): sum(abs(rates[t][i] - rates[r][i]) / sd[i] for i in (0, 1)) / 2 for r in others}
    assert {(t, r): d for t, r, d in over(spark, tmp_path, "fingerprint_delta", rows)} == pytest.approx(wanted, abs=1e-5)


def test_winner_needs_six_references(spark, tmp_path):
    def docs(many):
        return [(i, " ".join(["sun"] * (i + 1) + ["moon"] * (many - i) + ["sea"] * (i % 3 + 1)), "en", f"s{i}") for i in range(many)]

    assert {(t, r, w) for t, r, w in over(spark, tmp_path / "few", "fingerprint_winner", docs(4))} == {(f"s{i}", 3, None) for i in range(4)}
    found = {t: (w, refs) for t, refs, w in over(spark, tmp_path / "many", "fingerprint_winner", docs(8))}
    deltas = {}
    for target, reference, delta in over(spark, tmp_path / "again", "fingerprint_delta", docs(8)):
        deltas.setdefault(target, []).append((delta, reference))
    assert found == {t: (min(x)[1], 7) for t, x in deltas.items()}


def test_texts_are_cut_into_words_once(spark):
    """No inferred test of an array's size is pushed to the scan, where it would cut the text again for each use."""
    spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
    for name, most in (("ngram_seeds", 1), ("ngram_containment", 4), ("word_echo", 1)):
        plan = spark.sql(registry.doubles(catalogue.BUILDERS[name](SPARK)))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= most, name
