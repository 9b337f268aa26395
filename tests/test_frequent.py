"""Repeats of a manuscript are counted without moving the runs that are rare in it."""

import random

import pytest

from folioscope.functions.dialect import SPARK
from folioscope.plans import catalogue, frequent, lint
from folioscope.plans.registry import doubles

PLANTED = "silver lantern swung above harbour"


def _shuffled(spark) -> int:
    store, of = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, of, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _found(spark, chapters: int, words: int) -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for ch in range(chapters):
        toks = [f"w{rng.randrange(10**9)}" for _ in range(words)]
        for at in (words // 3, words // 2):
            toks[at:at] = PLANTED.split()
        rows.append(("book", str(ch), ch, " ".join(toks)))
    rows += [("empty", "0", 0, ""), ("empty", "1", 1, None), (None, "0", 0, f"{PLANTED}. " * 9)]
    spark.createDataFrame(rows, "manuscript_id STRING, chapter STRING, ord BIGINT, raw STRING").createOrReplaceTempView("frequent_chapters")
    sql = lint.repeats(SPARK, "(SELECT * FROM frequent_chapters)", lint.thresholds() | {"ngram_per_10k": 0.5})
    return [tuple(r) for r in spark.sql(doubles(sql)).collect()]


def test_rare_runs_do_not_move(spark):
    before = _shuffled(spark)
    found = _found(spark, 4, 30000)
    assert found == [("book", PLANTED, 5, 8, 4)], found
    # a slot for each run moves once, as one number; the runs themselves moved before, twice and in two forms
    moved = _shuffled(spark) - before
    assert moved < 150000, moved


@pytest.mark.parametrize("slot_bits", [6, 9, 20])
def test_full_slots_decide_nothing(spark, monkeypatch, slot_bits):
    monkeypatch.setattr(frequent, "SLOT_BITS", slot_bits)
    assert _found(spark, 3, 400) == [("book", PLANTED, 5, 6, 3)]


def test_seeds_are_dealt_once(spark):
    plan = catalogue.QUERIES["ngram_seeds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_are_cut_once(spark):
    df = catalogue.QUERIES["maximal_repeats"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    dealt = [line for line in final.splitlines() if "Exchange hashpartitioning(line" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1, final


def test_capitals_that_lower_by_their_neighbours(spark):
    texts = ["ΑΣ.Α ΟΔΟΣ Σ", "İstanbul Ünal's", "PLAIN Words-Here ⅣⅤ", "", None]
    spark.createDataFrame([(t,) for t in texts], "x STRING").createOrReplaceTempView("cased")
    word_by_word = SPARK.map(SPARK.all_of("x", r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'’-]*[\p{L}\p{N}_])?"), "w", "lower(w)")
    for row in spark.sql(f"SELECT {SPARK.tokens('x')} AS a, {word_by_word} AS b, {SPARK.n_tokens('x')} AS n FROM cased").collect():
        assert row.a == row.b and row.n == (None if row.b is None else len(row.b))


def test_lines_count_as_words_do(spark):
    lines = ["the queue e le ee rhythm tree, ß née i'e -", "be", "", "rhythm", "eye aye toe see'e ae"]
    words = [[w for w in line.split(" ") if w] for line in lines]
    spark.createDataFrame([(ws,) for ws in words], "ws ARRAY<STRING>").createOrReplaceTempView("worded")
    line = "concat(' ', array_join(ws, ' '), ' ')"
    each = f"aggregate(transform(ws, w -> {SPARK.syllables('w')}), 0L, (a, x) -> a + x)"
    for row in spark.sql(doubles(f"SELECT ws, {SPARK.line_syllables(line)} AS a, {each} AS b FROM worded")).collect():
        assert row.a == row.b, row
