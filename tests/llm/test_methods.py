"""What the operators decide beyond the contracts' columns, and the pipeline's stages, against brute force."""

import json
import random

import pytest

import corpus_pipeline
from folioscope.llm import chat, cluster, decontaminate, licenses, lines, near, quality, queries, resample, secrets

from . import brute
from .test_operators import ITEMS, ROWS, rows, same

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, table):
    return spark.createDataFrame(table, "doc_id long, text string").selectExpr("'x' AS n_words", "doc_id", "text", "7L AS n_chars", "1 AS rid", "'z' AS `odd.name`")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(n))


def test_license_labels(spark):
    rng = random.Random(3)
    mit = licenses.WHOLE["mit-full"]
    edited = mit.split()
    for at in (20, 70, 120):
        edited.insert(at, "really")
    table = [
        (1, "the mit license the mit license"), (2, "Intro. " + mit + " Outro."), (3, " ".join(edited)), (4, mit[: len(mit) // 2]), (5, licenses.WHOLE["bsd-3-full"]),
        (6, "Released under the MIT License. Released under the MIT License."), (7, None), (8, ""), (9, prose(rng, 80)), (9, "of the software and of the software and of the"), (None, licenses.SENTENCES["cc-by-grant"]), (10, licenses.WHOLE["gpl-notice"].upper()),
    ]
    found = licenses.scan(frame(spark, table))
    same(rows(found, "doc_id", "labels", "score", "n_spans"), brute.license_labels(table, licenses.template_words()))
    labels = {r.doc_id: r.labels for r in found.collect()}
    assert labels[1] == "mit" and "mit-full" in labels[3] and "mit-full" not in labels[4] and "bsd-3-full" in labels[5] and labels[9] == ""


MESSY = [
    *ROWS, (20, "Home | News | Sport | About\n" + prose(random.Random(1), 60) + ".\nAll rights reserved.\nTOUS LES DROITS SONT"), (21, "WHAT IS THIS?! NO!! WHY?? HOW?!\n" + "so it goes. " * 30),
    (22, "\n".join(["Accept all cookies", "Diese Seite uses cookies", "She baked a cookie.", prose(random.Random(2), 55) + ".", prose(random.Random(4), 30)])), (23, "# $ % & * | < >\n" + prose(random.Random(6), 50) + "."), (24, "a\x1cb\x0bc d\n\x0b\n" * 30),
]


def test_quality_verdicts_and_clean_texts(spark):
    docs = frame(spark, MESSY)
    wanted = brute.cleaned(MESSY)
    same(rows(quality.judge(docs), "doc_id", "kept", "n_lines", "n_bad_lines", "n_lost_words", "clean_text"), wanted)
    left = quality.clean(docs)
    assert left.columns == docs.columns
    same(rows(left, "doc_id", "text", "n_chars"), [(d, t, len(t)) for d, kept, *_, t in wanted if kept])


def planted(rng):
    """Unrelated texts, exact and near copies of some of them in chains, and groups that share much but not enough."""
    table = []
    for i in range(40):
        base = prose(rng, 60).split()
        table.append((i, " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 3, 30 if i == 5 else 2])):
            words = base[:]
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            base = words if rng.random() < 0.5 else base
            table.append((100 + 50 * i + j, " ".join(words)))
    rng.shuffle(table)
    return table


@pytest.mark.parametrize(("large", "few"), [(16, 200_000), (2, 0), (10**9, 200_000)])
def test_near_groups_at_all_sizes_of_components(spark, monkeypatch, large, few):
    monkeypatch.setattr(cluster, "LARGE", large)
    monkeypatch.setattr(cluster, "FEW_EDGES", few)
    table = planted(random.Random(11))
    same(rows(near.near_groups(frame(spark, table)), "doc_id", "n_shingles", "component_id", "kept"), brute.groups(table))


def test_stage_near_dedup_keeps_one_of_each_group(spark):
    table = planted(random.Random(12)) + [(3, None), (3, ""), (None, "x y"), (None, "x y")]
    docs = frame(spark, table)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    wanted = sorted((d, t) for (d, t), (_, n, c, k) in zip(table, brute.groups(table), strict=True) if n and k and d is not None)
    assert sorted((r.doc_id, r.text) for r in kept.where("length(text) > 0 AND doc_id IS NOT NULL").collect()) == wanted
    assert kept.where("doc_id IS NULL").count() == 2 and kept.where("coalesce(text, '') = ''").count() == 1


def test_stage_line_dedup(spark):
    table = [(1, "one line of words that is long\nRose"), (2, "one line of words thet is long\nThorn"), (3, "Rose"), (4, None), (5, "Rose\nDew"), (6, "one line of words that is long")]
    kept = rows(corpus_pipeline.line_dedup(spark, frame(spark, table), ""), "doc_id", "text")
    assert kept == sorted([(1, table[0][1]), (2, "Thorn"), (4, None), (5, "Dew")], key=repr)
    assert {d: brute.sha(t or "") for d, t in kept} == {d: h for d, _, h in brute.every_line(table) if d not in (3, 6)}


def test_stage_decontamination(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, ROWS)
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    clean = [hit[-1] is False for hit in brute.leaks(ROWS, ITEMS)]
    same(rows(kept, "doc_id", "text"), [x for x, ok in zip(ROWS, clean, strict=True) if ok])


def test_fingerprints_that_many_items_and_documents_share(spark):
    rng = random.Random(8)
    common = prose(rng, 7)
    items = [(i, f"{prose(rng, 6)} {common} {prose(rng, 6)}") for i in range(30)]
    docs = [(i, f"{prose(rng, 8)} {common} {prose(rng, 8)}") for i in range(30)] + [(100 + i, " ".join(items[i][1].split()[i % 6 : i % 6 + 11])) for i in range(30)]
    found = decontaminate.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    same(rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.leaks(docs, items))


def talk(conv, *turns):
    return [(conv, t, role, text) for t, role, text in turns]


def call(*ids, name="search", arguments=None):
    return json.dumps({"content": "c", "tool_calls": [{"id": i, "name": name, "arguments": {"query": f"q{i}"} if arguments is None else arguments} for i in ids]})


def answer(i, content=1):
    return json.dumps({"tool_call_id": i, "content": content})


TALKS = [
    *talk(1, (0, "user", "hi"), (1, "assistant", call("a")), (2, "tool", answer("a", 1)), (3, "assistant", call("a")), (4, "tool", answer("a", 2)), (5, "user", "bye")),
    *talk(2, (0, "tool", answer("z")), (1, "assistant", call("y", "z")), (9, "tool", answer("y")), (8, "tool", answer("z")), (10, "tool", answer("none"))),
    *talk(None, (0, "assistant", call("n")), (1, "tool", answer("n")), (None, None, None)),
    *talk(3, (None, "user", "first"), (0, "assistant", call(None)), (0, "assistant", "{broken"), (1, "tool", "[1]")),
    *talk(4, (0, "assistant", call("x", arguments={"limit": 3})), (0, "assistant", call("x", arguments={"limit": 3})), (1, "tool", answer("x")), (1, "tool", answer("x"))),
    *talk(5, (0, "assistant", call("v", name="unknown")), (1, "assistant", call("w", arguments='{"query": "s"}')), (2, "system", "é\n\"q\" \\ 世")),
]


def test_chats(spark):
    table = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").selectExpr("*", "'k' AS calls", "'c' AS chat", "1 AS n_open")
    for part in (1, 5):
        found = chat.format_chats(table.repartition(part), queries.TOOLS)
        same(rows(found, "conv_id", "n_messages", "n_calls", "n_invalid", "n_linked", "n_orphans", "n_open", "chat"), brute.chats(TALKS, queries.TOOLS))
    assert chat.format_chats(table.limit(0), queries.TOOLS).count() == 0


def test_chat_query_holds_calls(spark):
    from pyspark.sql import functions as F

    found = queries.op5_chat_format(spark, "/root/testdata/sf0.001")
    (total,) = found.agg(F.sum("n_calls").alias("c"), F.sum("n_linked").alias("l")).collect()
    assert total.c > 0 and total.l > 0


def test_resampling(spark):
    rng = random.Random(9)
    table = [(i, prose(rng, rng.randrange(1, 30))) for i in range(120)] + [(5, "alphaa"), (None, None), (None, None), (None, ""), (None, "betab"), (7, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (9999, 1)]
    docs = frame(spark, table)
    found = resample.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=64).collect()
    share = sum(q == 1 for _, q in labels) / sum(q is not None for _, q in labels)
    wanted, edge = brute.resampled(table, {d for d, q in labels if q == 1 and d is not None}, share, 64, resample.SEED)
    key = lambda r: (repr(r[0]), r[1], round(r[2], 9), round(r[3], 9))
    assert sorted(map(key, ((r.doc_id, r.n_grams, r.log_ratio, r.score) for r in found))) == sorted(map(key, wanted))
    assert sorted(round(r.score, 9) for r in found if r.kept) == sorted(round(x, 9) for x in edge)


def test_resampling_splits_equal_scores(spark):
    table = [(None, None)] * 40 + [(1, "good good"), (2, "bad bad")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    found = resample.resample(frame(spark, table), labels, share=0.5).collect()
    assert len(found) == 42 and sum(r.kept for r in found) == 21


def test_a_text_beyond_one_slice(spark):
    rng = random.Random(10)
    piece = "\n".join(prose(rng, 12) + "." for _ in range(400))
    long = "\n".join(f"{piece} secret = {i}abcdef" for i in range(160))
    assert len(long) > 4 << 20
    table = [(1, long), (2, "short"), (3, None)]
    docs, items = frame(spark, table), [(1, " ".join(piece.split()[5:25]))]
    same(rows(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.quality(table))
    same(rows(secrets.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), brute.secrets(table))
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string"))
    same(rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.leaks(table, items))


def test_pipeline_on_awkward_tables(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for name, table in (("rows", ROWS + MESSY), ("empty", [])):
        path = f"{tmp_path}/{name}"
        frame(spark, table).write.parquet(f"{path}/documents.parquet")
        items.write.parquet(f"{path}/benchmark.parquet")
    first = corpus_pipeline.run(spark, f"{tmp_path}/rows")
    n = first.count()
    assert n > 0 and corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert first.count() == n  # a later run leaves an earlier result readable


def test_edits_are_judged_inside_long_lines():
    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 160)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "a"])
        for most in (1, 2, 3):
            assert lines.within(a, "".join(b), most) == (brute.distance(a, "".join(b)) <= most)
