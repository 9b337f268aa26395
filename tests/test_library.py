"""Sources, operators, sinks and the stream over files, against brute force or what the input must give."""

import random
from collections import defaultdict

import pytest

from folioscope.functions import lexicons as lx
from folioscope.operators import clusters, human_pass, markup
from folioscope.operators.lint import lint, repeats
from folioscope.plans import fixtures
from folioscope.sinks import epub, reports
from folioscope.sources import files

RAW = "# One\n\n<!-- words: 9 -->\n\nIt was late. He ran home like a wolf in winter and did not stop. “Go now!” she said. Love is time."


@pytest.fixture(scope="module")
def chapters(spark):
    return spark.createDataFrame(fixtures.CHAPTERS, "manuscript_id string, chapter string, ord long, raw string")


def texts(spark, *raw):
    return spark.createDataFrame([(f"f{i}", r) for i, r in enumerate(raw)], "chapter string, raw string")


def brute_repeats(chapters: dict[str, list[str]], least: int, per_10k: float) -> set:
    places = defaultdict(list)
    for name, toks in chapters.items():
        for i in range(len(toks) - 2):
            if sum(t not in lx.FUNCTION_WORDS for t in toks[i : i + 3]) >= 2:
                places[tuple(toks[i : i + 3])].append((name, i))
    total, spans = sum(map(len, chapters.values())), set()
    for occ in places.values():
        if len(occ) < least or len({c for c, _ in occ}) < 2 or len(occ) * 10000 / total < per_10k:
            continue
        same = lambda k: len(x := {chapters[c][i + k] if 0 <= i + k < len(chapters[c]) else None for c, i in occ}) == 1 and None not in x
        right = 3
        while right < 40 and same(right):
            right += 1
        left = 0
        while left + right < 40 and same(-left - 1):
            left += 1
        c, i = occ[0]
        spans.add((" ".join(chapters[c][i - left : i + right]), len(occ)))
    return {(p, n) for p, n in spans if not any(p in q and len(q) > len(p) for q, _ in spans)}


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    words = ["stone", "the", "lamp", "of", "road", "jar", "cold", "sea", "ash"]
    phrase = [f"w{i}" for i in range(9)]
    chapters = {}
    for c in range(6):
        toks = []
        for _ in range(12):
            toks += rng.choices(words, k=rng.randint(1, 12)) + rng.choice([phrase, phrase[2:7], []])
        chapters[f"c{c}"] = toks
    rows = spark.createDataFrame([("m", c, i, " ".join(t)) for i, (c, t) in enumerate(chapters.items())] + [("m", "null", 9, None), ("m", "empty", 10, "")], "manuscript_id string, chapter string, ord long, raw string")
    found = {(r.phrase, r.n) for r in repeats(rows).collect()}
    assert found and found == brute_repeats(chapters, 5, 4.0)


def test_lint_flags_and_does_not(spark):
    dashes = "She counted the jars — the ones from the north room — again. " * 60
    calm = " ".join(f"She set the bread on the table and counted the jars in row {i}." for i in range(80))
    rows = spark.createDataFrame([("bad", "a", 1, dashes), ("calm", "a", 1, calm), ("none", "a", 1, "<!-- x — y -->")], "manuscript_id string, chapter string, ord long, raw string")
    found = {(r.manuscript_id, r.check_name, r.severity) for r in lint(rows).collect()}
    assert ("bad", "em_dash_density", "fail") in found and ("none", "manuscript", "fail") in found
    assert not any(m == "calm" and s == "fail" for m, _, s in found)
    assert lint(rows.limit(0)).count() == 0
    with pytest.raises(KeyError):
        lint(rows, "", {"colour": 1})


def test_names_and_voices(spark):
    said = "".join(f"“I will go now.” said {who}. " for who in ("Anna", "John") for _ in range(8))
    rows = spark.createDataFrame([("m", "a", 1, said + "\n\n" + "Then Miryam and Mariam met. " * 5)], "manuscript_id string, chapter string, ord long, raw string")
    found = {(r.check_name, r.item) for r in lint(rows).collect()}
    assert ("voice_collision", "Anna / John") in found and ("entity_variant", "Mariam:5,Miryam:5") in found


def test_escalation(spark):
    body = lambda n: "The road lay dark and long. " * 40 + "I decided to go. " * n
    rows = spark.createDataFrame([("m", f"c{i}", i, body(1 if i < 3 else 8)) for i in range(9)], "manuscript_id string, chapter string, ord long, raw string")
    assert ("phrase_escalation", "I decided") in {(r.check_name, r.item) for r in lint(rows).collect()}


def test_records(spark):
    found = files.records(texts(spark, 'event id=a day=1 label="two words"\n# no\n\nevent id=a day=2\nage person=P\nbogus x=1\nonce id=w at=a\nonce id=w at=b', ""), {"event": ["id", "day"], "age": ["person", "years"], "once": ["id"]}).collect()
    assert {r.line: r.error for r in found} == {1: None, 4: "id repeats that of line 1", 5: "missing years", 6: "unknown record: bogus", 7: None, 8: None}
    assert next(r for r in found if r.line == 1).fields == {"id": "a", "day": "1", "label": "two words"}


def test_yaml(spark):
    y = files.yaml_map(texts(spark, "book:\n  title: \"A Tale\"\n  tags:\n    - one\n    - two\nstate:\n  phase: draft\n  - lost\n", "  early: 1\n", None))
    rows = {(r.chapter, r.block, r.name, r.value, r.error) for r in y.collect()}
    assert {("f0", "book", "title", "A Tale", None), ("f0", "book", "tags", "one", None), ("f0", "book", "tags", "two", None), ("f0", "state", "phase", "draft", None)} <= rows
    assert {r[4] for r in rows} == {None, "item without a list", "value before a block"}
    assert files.scalar(y, "state.phase").collect()[0].value == "draft" and files.scalar(y, "title").collect()[0].value == "A Tale"


def test_files(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "chapter-02.md").write_text("# Two\n\nText.")
    (tmp_path / "m1" / "chapter-02-report.md").write_text("meta chapter=2 hook=image")
    (tmp_path / "m1" / "other.bin").write_text("x")
    (tmp_path / "m1" / "zero.md").write_text(" \n")
    found = files.chapters(spark, str(tmp_path), canonical=True).collect()
    assert [(r.manuscript_id, r.chapter, r.chapter_no, r.raw) for r in found] == [("m1", "chapter-02.md", 2, "# Two\n\nText.")]
    assert {r.file: r.verdict for r in files.imports(spark, str(tmp_path)).collect()} == {"chapter-02.md": "adopted", "chapter-02-report.md": "adopted", "other.bin": "wrong suffix", "zero.md": "empty"}
    meta = files.report_meta(files.chapters(spark, str(tmp_path), "*-report.md")).collect()
    assert [r.meta for r in meta] == [{"chapter": "2", "hook": "image"}]
    (tmp_path / "e.csv").write_text("reader_id,chapter,rating,comment,delayed\nr1,1,5,good,yes\nr2,,3,x,\nr3,2,9,x,\n,1,2,,\n")
    assert [r.error for r in files.evidence(spark, str(tmp_path / "e.csv")).collect()] == [None, "no chapter", "rating not from 1 to 5", "no reader"]
    p = spark.createDataFrame([("a", 10, "the", 50.0), ("a", 10, "of", 25.0)], "profile string, total_words long, word string, rate double")
    reports.profiles_json(p, str(tmp_path / "p"))
    assert sorted(files.profiles(spark, str(tmp_path / "p")).collect()) == sorted(p.collect())


def test_human_pass_round_trip(spark):
    rows = spark.createDataFrame([("m", "chapter-01.md", 1, RAW), ("m", "chapter-02.md", 2, None)], "manuscript_id string, chapter string, ord long, raw string")
    picked = human_pass.select_lines(rows)
    lines = picked.collect()
    assert {r.kind for r in lines} >= {"opening", "closing", "longest"} and all(RAW[r.start : r.end] == r.text for r in lines)
    entries, errors = human_pass.parse_worksheets(human_pass.worksheet(picked))
    assert errors.count() == 0 and sorted((r.start, r.original) for r in entries.collect()) == sorted((r.start, r.text) for r in lines)
    from pyspark.sql import functions as F

    edited = entries.withColumn("rewrite", F.when(F.col("kind").isin("opening", "closing"), F.concat(F.lit("New: "), "original")).otherwise(F.col("rewrite")))
    done = {r.chapter: r for r in human_pass.splice(rows, edited).collect()}
    first = done["chapter-01.md"]
    assert first.applied == 2 and first.error is None
    assert first.raw.replace(human_pass.START, "").replace(human_pass.END, "").replace("New: ", "") == RAW and "<!-- hp:start -->New: It was late.<!-- hp:end -->" in first.raw
    assert done["chapter-02.md"].raw is None and done["chapter-02.md"].error is None
    stale = human_pass.splice(rows.withColumn("raw", F.concat("raw", F.lit("!"))), edited).filter("error IS NOT NULL").collect()
    assert [r.error for r in stale] == ["chapter changed since the plan"] and stale[0].raw == RAW + "!"
    assert human_pass.read_worksheet("entry chapter=a\nORIGINAL:\n```\nx\n")["errors"] == ["line 1: block missing or open"]


def test_markup_and_epub(spark, chapters, tmp_path):
    made = markup.xhtml("# A *b*\n\n<!-- no -->one\ntwo **x** & <y\n> q\n\n***\n")
    assert made == {"body": '<h1>A <em>b</em></h1>\n<p>one two <strong>x</strong> &amp; &lt;y</p>\n<blockquote><p>q</p></blockquote>\n<hr class="scene-break"/>', "errors": []}
    assert [e["line"] for e in markup.xhtml("fine\n\n- item\n[a](b)")["errors"]] == [3, 4]
    books = {r.manuscript_id: r for r in epub.books(chapters).collect()}
    assert set(books) == {"m1", "m2"} and all(b.errors == [] for b in books.values())
    assert books["m1"].epub == {r.manuscript_id: r for r in epub.books(chapters).collect()}["m1"].epub
    (tmp_path / "good.epub").write_bytes(books["m1"].epub)
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    assert [r.file for r in files.epub_problems(spark, str(tmp_path)).collect()] == ["bad.epub"]


def test_clusters(spark):
    counts = [("Miryam", 9), ("Mariam", 5), ("Maryam", 3), ("Konstantin", 4), ("Constantin", 4), ("Paul", 7), ("Elizabeth", 5)]
    rows = spark.createDataFrame([("m", w, n) for w, n in counts], "manuscript_id string, word string, n long")
    found = {(r.canonical, r.variants) for r in clusters.greedy_variants(rows).collect()}
    assert found == {("Miryam", "Mariam:5,Maryam:3,Miryam:9"), ("Constantin", "Constantin:4,Konstantin:4")}


def test_report(spark, chapters, tmp_path):
    found = {r.manuscript_id: r for r in reports.markdown(lint(chapters)).collect()}
    assert found["m1"].report.startswith("# Lint Report\n\nVerdict: ") and ("## warn" in found["m1"].report)
    reports.write_texts(reports.markdown(lint(chapters)), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).count() == 2


def test_registered_queries_run(spark):
    from folioscope.plans import catalogue, library

    for name in library.NAMES:
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and catalogue.COVERS[name]


def test_stream(spark, tmp_path):
    from folioscope.streaming.ledger import findings_stream

    (tmp_path / "in" / "m1").mkdir(parents=True)
    (tmp_path / "in" / "m1" / "chapter-01.md").write_text("Short text.")
    query = findings_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert "short_chapter" in {r.check_name for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_styles_by_runs_of_asterisks():
    import re
    from html import escape

    def passes(text):
        text = escape(text, quote=False)
        for mark, tag in ((r"[*][*]", "strong"), (r"[*]", "em")):
            text = re.sub(f"{mark}([^*]+){mark}", lambda m, t=tag: f"<{t}>{m[1]}</{t}>", text)
        return text

    for text in ("*a **b** c*", "***x***", "**a** and *b*", "* a * b *", "a ** b", "****", "*", "", "**a*b**c*", "x*y*z*w*", "**a** **b**", "*<a>* & **c"):
        assert markup._styled(text) == passes(text), text


def test_books_with_metadata_and_matter(spark):
    import io
    import zipfile

    chapters = spark.createDataFrame([("b1", "chapter-01.md", 1, "# One\n\nText."), ("b2", "chapter-01.md", 1, "Text."), ("b3", "chapter-01.md", 1, "Text.")], "manuscript_id string, chapter string, ord long, raw string")
    meta = spark.createDataFrame([("b1", "The Jar", "A. Nother", "en", "House"), ("b2", "", "B. Else", "en", None)], "manuscript_id string, title string, author string, language string, publisher string")
    matter = spark.createDataFrame([("b1", "also-by", "More."), ("b1", "dedication", "To all."), ("b3", "index", "No.")], "manuscript_id string, kind string, raw string")
    made = {r.manuscript_id: r for r in epub.books(chapters, meta=meta, matter=matter).collect()}
    book = zipfile.ZipFile(io.BytesIO(made["b1"].epub))
    opf = book.read("OEBPS/content.opf").decode()
    assert "<dc:title>The Jar</dc:title>" in opf and "<dc:publisher>House</dc:publisher>" in opf and "style.css" in book.read("OEBPS/page00001.xhtml").decode()
    assert [("To all." in (t := book.read(f"OEBPS/page0000{i}.xhtml").decode()), "More." in t) for i in (1, 2, 3)] == [(True, False), (False, False), (False, True)]
    assert made["b2"].epub is None and made["b2"].errors == ["title is missing"] and made["b3"].errors == ["index: unknown matter"]
