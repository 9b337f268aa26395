"""Places of typographic flaws against a letter-by-letter reading of each chapter."""

import random
import re

import pytest

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import SPARK
from folioscope.operators.lint import over_frames
from folioscope.plans import places

SCHEMA = "manuscript_id string, chapter string, ord long, raw string"


def laid(raw):
    return re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", "x", m[0]), raw.replace(places.MARK, "x"), flags=re.S)


def flaws(texts):
    """(chapter, check, start, line) of one manuscript's chapters."""
    out, texts = set(), {n: laid(t) for n, t in texts.items() if t is not None}
    whole = "\n".join(texts.values())
    curly = len(re.findall("[“”]", whole)) >= len(re.findall(r'(?<!\w)"', whole))
    one = whole.count("…") >= len(re.findall(r"(?<!\.)\.{3}(?!\.)", whole))
    for name, text in texts.items():

        def add(check, at, name=name, text=text):
            out.add((name, check, at, text.count("\n", 0, at) + 1))

        for m in re.finditer(r"(?<!\w)\"|(?<!\w)'(?=\w)" if curly else "[“”’]", text):
            add("quote_style_mixing", m.start())
        paragraphs, at = re.split(r"\n\s*\n", text), 0
        for p, after in zip(paragraphs, [*paragraphs[1:], ""], strict=True):
            gap, odd = p.count("“") - p.count("”"), p.count('"') % 2
            goes_on = ((gap == 1 and not p.count('"')) or (odd and not gap)) and all(x.lstrip()[:1] in ("“", '"') and x for x in (p, after))
            if (gap or odd) and not goes_on:
                add("unbalanced_quotes", at)
            at += len(p) + 2
        depth, sunk = 0, None
        for i, ch in enumerate(text):
            depth += (ch == "(") - (ch == ")")
            sunk = i if depth < 0 and sunk is None else sunk
        if depth:
            add("unbalanced_delims", sunk or 0)
        for check, pattern in {"doubled_words": r"(?i)\b(\w+)\s+\1\b", "doubled_spaces": r"[ \t]{2,}", "ellipsis_consistency": r"\.{4,}|" + (r"(?<!\.)\.{3}(?!\.)" if one else "…"), "mojibake": r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"}.items():
            for m in re.finditer(pattern, text):
                add(check, m.start())
        for marker in lx.MOJIBAKE:
            if marker in text:
                add("mojibake", text.index(marker))
        if ("—" in text) + ("--" in text) + bool(re.search(r"\s–\s", text)) > 1:
            add("dash_consistency", 0)
        heads = list(re.finditer(r"^(#{1,6})\s+\S.*$", text, re.M))
        tops = [m for m in heads if len(m[1]) == min(len(h[1]) for h in heads)]
        if len(tops) > 1:
            add("heading_levels", tops[1].start())
        for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
            if not text[m.end() : after].strip():
                add("empty_sections", m.start())
        number, heading = re.search(r"\d+", name), re.search(r"^#{1,2}\s*Chapter\s+(\d+)\b", text, re.I | re.M)
        if number and heading and int(number[0]) != int(heading[1]):
            add("chapter_numbering", heading.start())
        if not number:
            out.add((name, "chapter_numbering", 0, 0))
    numbered = sorted((n, int(re.search(r"\d+", n)[0])) for n in texts if re.search(r"\d+", n))
    out |= {(b, "chapter_numbering", 0, 0) for (_, x), (b, y) in zip(numbered, numbered[1:]) if y != x + 1}
    if len({m[1].strip() for t in texts.values() for m in re.finditer(r"^\s*([*#~\-]{3,}|[*#~\-]\s*[*#~\-]\s*[*#~\-])\s*$", t, re.M)}) > 1:
        out.add((None, "scene_break_consistency", 0, 0))
    return out


def run(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return over_frames(f"SELECT * FROM {places.places(SPARK, 'chapters_to_check')} x", chapters=frame).collect()


PIECES = ["word ", "word word ", "the The ", "a  b", "\n", "\n\n", "\n \n", "(", ")", "“Yes", "”", '"', "'tis ", "don't ", "’", "...", "....", "…", " – ", "—", "--", "\n# Head\n", "\n## Part\n\ntext\n", "\n***\n", "\n---\n", "\t\t", "\x02", "Ã©", "<!-- a -- (b\n b -->", "was\nwas was ", "é é "]


@pytest.mark.parametrize("seed", [2, 3])
def test_every_check_against_a_plain_reading(spark, seed):
    dice = random.Random(seed)
    rows = [(m, n, i, "".join(dice.choices(PIECES, k=dice.randint(0, 60)))) for m in ("a", "b", "c") for i, n in enumerate(["chapter-01.md", "chapter-02.md", "chapter-04.md", "afterword.md"])]
    rows += [("d", "chapter-1.md", 1, "# Chapter 3\n\nFine."), ("d", "chapter-2.md", 2, None), ("e", "chapter-1.md", 1, ""), ("f", "chapter-1.md", 1, "“One\n\n“Two”\n\nHe \"said\" no.")]
    found = run(spark, rows)
    for m in "abcdef":
        mine = [r for r in found if r.manuscript_id == m]
        got = {(r.chapter, r.check_name, r.start, r.line) for r in mine}
        assert got == flaws({n: t for k, n, _, t in rows if k == m}), m
    assert len({r.check_name for r in found}) == 12


def test_excerpts(spark):
    text = "First line here.\nShe she went (home and  sat <!-- no\nno --> down.\n"
    found = {r.check_name: r for r in run(spark, [("m", "chapter-01.md", 1, text)])}
    shown = lambda a, b: laid(text)[max(0, a - 30) : b + 30].replace("\n", " ").strip()
    assert text[17:24] == "She she" and text[39:41] == "  "
    twice = found["doubled_words"]
    assert (twice.line, twice.excerpt, twice.item, twice.severity) == (2, shown(17, 24), "She", "fail")
    assert (found["doubled_spaces"].line, found["doubled_spaces"].excerpt) == (2, shown(39, 41))
    assert found["unbalanced_delims"].start == 0 and found["unbalanced_delims"].line == 1
