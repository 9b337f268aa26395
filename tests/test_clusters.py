"""Greedy clusters against the loop over a manuscript's spellings that the rule states."""

import random
from itertools import combinations

import pytest

from folioscope.operators import clusters, relations
from folioscope.plans import catalogue, library, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def loop(counts, most=3):
    out = set()
    for m in {r[0] for r in counts}:
        words = sorted(((w, n) for k, w, n in counts if k == m and w is not None), key=lambda x: (-x[1], x[0]))
        taken = set()
        for at, (word, n) in enumerate(words):
            if word in taken:
                continue
            mine = {w: k for w, k in words[at + 1 :] if w not in taken and 0 < distance(word.lower(), w.lower()) <= most}
            if mine:
                taken |= set(mine)
                out.add((m, word, ",".join(f"{w}:{k}" for w, k in sorted((mine | {word: n}).items()))))
    return out


def rows(frame):
    found = [tuple(r) for r in frame.select("manuscript_id", "canonical", "variants").collect()]
    assert len(found) == len(set(found))
    return set(found)


def vocabulary(seed, many, letters, longest):
    dice = random.Random(seed)
    return list({(m, "".join(dice.choices(letters, k=dice.randint(1, longest))).capitalize() if dice.random() < 0.9 else "AB"): 0 for m in ("a", "b") for _ in range(many)})


@pytest.mark.parametrize(("prefixes", "letters", "longest"), [((), "ab", 6), ((2, 8, 16), "abcdefgh", 12)])
def test_against_the_loop(spark, prefixes, letters, longest):
    dice = random.Random(longest)
    counts = [(m, w, dice.randint(1, 9)) for m, w in vocabulary(longest, 90, letters, longest)] + [("c", "Lone", 3), ("d", None, 2), ("e", "É", 4), ("e", "Ée", 4), ("e", "ée", 5)]
    frame = spark.createDataFrame(counts, "manuscript_id string, word string, n long")
    assert rows(clusters.greedy_variants(frame, prefixes=prefixes)) == loop(counts)


def test_chains_are_settled_in_order(spark):
    counts = [("m", "x" * 3 + "abcdefgh"[i] * 8, 100 - i) for i in range(8)] + [("m", f"Word{i:04}{'q' * 9}{i:04}", 50) for i in range(1, 12)]
    chain = [("k", "a" * i + "b" * (24 - i), 100 - i) for i in range(25)]
    frame = spark.createDataFrame(counts + chain, "manuscript_id string, word string, n long")
    assert rows(clusters.greedy_variants(frame, prefixes=())) == loop(counts + chain)


def test_deletions_are_not_broadcast(spark, tmp_path):
    """A few spellings are small, their deletions are not: estimates take them for small, and the driver would gather them."""
    spark.createDataFrame([("m", f"word{i}") for i in range(50)], "manuscript_id string, low string").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    assert "Broadcast" not in clusters._near(words, words, 3)._jdf.queryExecution().executedPlan().toString()


def test_each_rest_comes_once(spark):
    words = spark.createDataFrame([("m", w) for w in ("aaaabbbbb", "abab", "aab", "b")], "manuscript_id string, low string")
    found = sorted((r.low, r.rest) for r in clusters._deletions(words, 3).collect())
    expected = {(w, "".join(kept)) for w in ("aaaabbbbb", "abab", "aab", "b") for k in range(4) if k <= len(w) for kept in combinations(w, len(w) - k)}
    assert found == sorted(expected)


def test_empty(spark):
    assert rows(clusters.greedy_variants(spark.createDataFrame([], "manuscript_id string, word string, n long"))) == set()


def test_whole_table(spark):
    found = rows(library.name_clusters(spark, "/root/testdata/sf0.001"))
    counts = [tuple(r) for r in clusters.capitalised(library._documents(spark, "/root/testdata/sf0.001").where("raw IS NOT NULL")).collect()]
    assert found == loop(counts) and found


def test_near_names_are_those_of_all_pairs(spark):
    """Words meet in cells of a length and a part, and nothing but words of like letters is measured; the pairs stay those of the rule."""
    dice = random.Random(5)
    words = sorted({"".join(dice.choices("abcd", k=dice.randint(5, 10))).capitalize() for _ in range(120)} | {"Mariam", "Miryam", "Aaaaa", "Bbbbb"})
    chapters = spark.createDataFrame([("m", "c1", 1, " and ".join(words)), ("k", "c1", 1, "Mariam")], "manuscript_id string, chapter string, ord long, raw string")
    frame = relations.run("name_variants", chapters=chapters)
    found = sorted((r.manuscript_id, r.name_a, r.name_b, r.distance) for r in frame.collect())
    assert found == [("m", a, b, k) for i, a in enumerate(words) for b in words[i + 1 :] if (k := distance(a, b)) <= 3] and found
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan and "short" in plan


def test_names_far_apart_hardly_meet(spark):
    """Words meet by halves with one change: few pairs do, none within distance 3 is missed and none comes twice, whatever their length."""
    dice = random.Random(7)
    letters = "eeeeaaannnrrstiodlhbcgmuz"
    words = {"".join(dice.choices(letters, k=dice.randint(5, 17))) for _ in range(160)}
    for word in sorted(words):
        for _ in range(dice.randint(0, 3)):
            at = dice.randint(0, len(word) - 1)
            word = word[:at] + dice.choice(["", dice.choice(letters), word[at] + word[at], dice.choice(letters) + word[at]]) + word[at + 1 :]
        words.add(word)
    words = sorted({w.capitalize() for w in words if len(w) >= 5} | {"Eeeee", "Eeeeeeee", "Neeee", "Eneee", "Aeeeeeeeeeee", "Aeeeeeeeeeeee"})
    spark.createDataFrame([(m, w) for m in ("m", "k") for w in words], "manuscript_id string, w string").createOrReplaceTempView("coined")
    wanted = sorted((m, a, b, k) for i, a in enumerate(words) for b in words[i + 1 :] if (k := distance(a, b)) <= 3 for m in ("m", "k"))
    assert {(len(a) > 12) + (len(b) > 12) for _, a, b, _ in wanted} == {0, 1, 2} and {k for *_, k in wanted} == {1, 2, 3}
    assert sorted(tuple(r) for r in spark.sql(prose.near_names("SELECT * FROM coined")).collect()) == wanted
    shorter, longer = prose.name_cells(prose._coded("SELECT * FROM coined WHERE length(w) > 7"))
    met = spark.sql(f"SELECT a.w, b.w FROM {shorter} a JOIN {longer} b ON a.k = b.k AND a.manuscript_id = b.manuscript_id AND a.w <> b.w").count()
    several = sum(7 < len(w) <= 12 for w in words)
    assert met < several * several / 10, (met, several)


def test_names_are_read_once(spark):
    frame = catalogue.QUERIES["name_variants"](spark, "/root/testdata/sf0.001")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("regexp_extract_all") == 1, final
