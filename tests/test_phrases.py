"""Phrases found at run time: counts against a regular expression for each phrase, thirds against a sorted list."""

import random
import re
from collections import Counter

from folioscope.functions.dialect import SPARK
from folioscope.operators.lint import lint, over_frames, repeats
from folioscope.plans import phrases, ranks
from folioscope.plans.lint import thresholds

SCHEMA = "manuscript_id string, chapter string, ord long, raw string"


def test_places_of_phrases_are_those_of_a_regular_expression(spark):
    dice = random.Random(3)
    words = ["the", "old", "man", "man's", "sea-side", "côte", "a", "b", "old"]
    gaps = [" ", " ", " ", " ", ", ", "  ", "\n", "-", "'", "\x01", "\x02 "]
    texts = [("m", str(i), "".join(w + dice.choice(gaps) for w in dice.choices(words, k=dice.randint(0, 90)))) for i in range(400)] + [("n", "0", "the old man"), ("n", "1", ""), ("m", "x", None)]
    wanted_phrases = [("m", p) for p in ("the old man", "old man's sea-side", "a b a", "a b a b", "b a b", "old man's", "côte a b", "old old old", "man s sea", "the old man")] + [("n", "the old man"), ("o", "the old man")]
    wanted_phrases = [x for x in wanted_phrases if len(re.findall(r"\w+", x[1])) >= 3]
    found = over_frames(phrases.counted(SPARK, "texts_to_check", "phrases_to_check"), texts=spark.createDataFrame(texts, "manuscript_id string, chapter string, low string"), phrases=spark.createDataFrame(wanted_phrases, "manuscript_id string, phrase string"))
    wanted = {(m, c, p, n) for m, c, t in texts for o, p in wanted_phrases if o == m and t and (n := len(re.findall(rf"\b{re.escape(p)}\b", t)))}
    rows = found.collect()
    assert {tuple(r) for r in rows} == wanted and len(rows) == len(wanted) > 50


def test_thirds_of_manuscripts_of_any_numbering(spark):
    dice = random.Random(4)
    rows = [(m, f"c{i}", n, "x") for m, many in (("a", 6), ("b", 5), ("c", 700), ("d", 8), (None, 9)) for i, n in enumerate(dice.sample(range(-(10**6), 10**9), many - 1) + [None])]
    rows += [("e", f"c{i}", 7, "x") for i in range(10)]
    places = {(r.manuscript_id, r.chapter): (r.place, r.n) for r in over_frames(ranks.ranked(SPARK, "rows_to_check", "manuscript_id", "ord", "chapter"), rows=spark.createDataFrame(rows, SCHEMA)).collect()}
    wanted = {}
    for m in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == m), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        wanted |= {(m, r[1]): (i, len(mine)) for i, r in enumerate(mine, 1)}
    assert places == wanted
    third = {(r.t_of, r.t_at): r.third for r in over_frames(phrases.thirds(SPARK, "rows_to_check"), rows=spark.createDataFrame(rows, SCHEMA)).collect()}
    assert third == {k: "early" if place <= n // 3 else "late" for k, (place, n) in wanted.items() if n >= 6 and (place <= n // 3 or place > n - n // 3)}
    assert all((m, c) not in third for m, c in third if m == "b")


def escalation(rows, spans, th):
    """The rule for one manuscript, each phrase by its own expression over each chapter."""
    chapters = sorted(rows, key=lambda r: r[2])
    k = len(chapters) // 3
    early, late = chapters[:k], chapters[-k:]
    words = lambda part: max(sum(len(re.findall(r"\w(?:[\w'-]*\w)?", t)) for _, _, _, t in part) / 1000, 0.001)
    out = {}
    for p in spans:
        a, b = (sum(len(re.findall(rf"\b{re.escape(p)}\b", t.lower())) for _, _, _, t in part) for part in (early, late))
        da, db = a / words(early), b / words(late)
        if db >= th["escalation_min_last_per_1k"] and (db / da >= th["escalation_ratio"] if a else b >= 2):
            out[p] = (a, b)
    return out


def test_discovered_phrases_escalate_in_the_lint(spark):
    dice = random.Random(5)
    filler = lambda: " ".join("".join(dice.choices("abdeglmnorstu", k=7)) for _ in range(30))
    tic, steady, loose = "Broken glass glittered again", "amber light fell slowly", "silver spoon clattered"
    rows = []
    for i in range(12):
        grown = [tic] * (0 if i < 6 else i - 4)
        parted = [loose.replace(" ", ", " if j % 2 else " ", 1) for j in range(i)]
        rows.append(("m", f"c{i:02}", i, ". ".join(x for y in zip([filler() for _ in range(20)], grown + [steady] * 2 + parted + [""] * 20) for x in y if x)))
    frame = spark.createDataFrame(rows, SCHEMA)
    th = thresholds()
    spans = [r.phrase for r in repeats(frame).collect()]
    wanted = escalation(rows, spans, th)
    assert tic.lower() in wanted and steady not in wanted and loose in wanted
    found = {r.item: r.n for r in lint(frame).where("check_name = 'phrase_escalation'").collect()}
    assert found == {p: b for p, (_, b) in wanted.items()}
    assert Counter(found)[loose] < sum(len(re.findall("spoon", r[3])) for r in rows[8:])  # those with a comma are none
