"""Terms in texts against Python's own search, and the plans that rest on it."""

import random

import pytest

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import SPARK
from folioscope.operators import relations
from folioscope.operators.lint import over_frames
from folioscope.plans import catalogue, contain, registry


def run(spark, texts, terms):
    frames = {"texts": spark.createDataFrame(texts, "id string, low string"), "terms": spark.createDataFrame([(t,) for t in terms], "term string")}
    return over_frames(contain.containing(SPARK, "texts_to_check", "id", "terms_to_check"), **frames)


def test_places_are_those_of_a_plain_search(spark):
    dice = random.Random(2)
    letters = "aaabbc  --.é_"
    text = lambda longest: "".join(dice.choices(letters, k=dice.randint(0, longest)))
    long_run = "".join(dice.choices("abcdefgh", k=400))
    texts = [(str(i), text(60)) for i in range(300)] + [("long", long_run), ("marks", "-=+" * 60 + " tail"), ("none", None), ("empty", "")]
    terms = {text(7).strip() for _ in range(200)} | {long_run[30:60], long_run[40:56], long_run[44:60], long_run[47:50], long_run[100:300], "=+-", "-=+-=", "tail", "  ", None, "a b", "no such term"}
    terms |= {long_run[i : i + 16] for i in range(0, 380, 7)}
    found = [tuple(r) for r in run(spark, texts, terms).select("id", "term", "hits").collect()]
    wanted = {(i, t, x.count(t)) for i, x in texts for t in terms if x and t and t.strip() and t in x}
    assert set(found) == wanted and len(found) == len(wanted) > 1000


@pytest.mark.parametrize("name", ["term_coverage", "texture_coverage", "simile_ledger", "watch_union", "used_ledger_chapters"])
def test_no_text_meets_every_term(spark, name):
    sql = relations.catalogue.BUILDERS[name](SPARK)
    assert "CROSS JOIN" not in sql
    if name == "term_coverage":
        spark.createDataFrame([(1, "x", "s", "en")], "doc_id long, text string, source string, lang string").createOrReplaceTempView("documents")
        spark.createDataFrame([(1, "x")], "item_id long, text string").createOrReplaceTempView("benchmark")
    plan = spark.sql(registry.doubles(sql))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ledger_exempts_phrases_similes_and_openings(spark):
    body = "Lantern light fell on the quiet harbor wall like a wounded bird. “Go,” muttered Ann. “Why?” asked Bob. The copper bell rang twice over. "
    rows = [("m", f"c{i}", i, ("Harbor" if i % 2 else "Morning") + f" came number {i}. " + body) for i in range(6)]
    chapters = spark.createDataFrame(rows, "manuscript_id string, chapter string, ord long, raw string")
    motifs = spark.createDataFrame([(1, 'motif id=h term="Harbor"'), (2, 'motif id=w term="wounded"')], "lineno long, line string")
    found = {(r.kind, r.item): (r.n, r.exempt) for r in relations.run("used_ledger_chapters", chapters=chapters, motifs=motifs).collect()}
    assert found["opening", "harbor"] == (3, True) and found["opening", "morning"] == (3, False)
    assert {k[1]: v for k, v in found.items() if k[0] == "tag"} == {"muttered": (6, False)} and "muttered" in lx.TAG_VERBS
    similes = {k[1]: v for k, v in found.items() if k[0] == "simile"}
    assert similes and all(exempt == ("wounded" in item) for item, (_, exempt) in similes.items())
    phrases = {k[1]: v[1] for k, v in found.items() if k[0] == "phrase"}
    assert phrases and all(exempt == ("harbor" in p or "wounded" in p) for p, exempt in phrases.items())


def test_coverage_over_documents(spark, tmp_path):
    docs = [(1, "The Red fox ran. the red FOX", "en", "a"), (2, "a predfoxy", "en", "b"), (3, None, "en", "a"), (4, "the red fox", "en", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the red fox sleeps"), (2, None), (3, "…"), (4, "red"), (5, "Not held at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {tuple(r) for r in relations.catalogue.QUERIES["term_coverage"](spark, str(tmp_path)).collect()}
    assert found == {(1, "the red fox", 2, "a,b", 3), (4, "red", 3, "a,b", 4), (5, "Not held at", 0, "", 0)}


@pytest.mark.parametrize("name", ["used_ledger", "used_ledger_chapters"])
def test_ledger_reads_texts_twice_at_most(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    # once for the repeats, once for what adds up over chapters
    assert len([line for line in final.splitlines() if "Scan parquet" in line and "/documents.parquet" in line]) <= 2, final
