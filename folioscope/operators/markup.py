"""Markdown subset to XHTML: headings, paragraphs, quotations, scene breaks, strong and emphasis; the rest is an error row."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Constructs that the compiler refuses, with what it says of them.
REFUSED = [
    (r"!\[", "image syntax is not supported by the fiction compiler"),
    (r"(?<!!)\[[^\]]*\]\([^)]*\)", "link syntax is not supported by the fiction compiler"),
    (r"\[\^[^\]]+\]", "footnote syntax is not supported by the fiction compiler"),
    (r"^\s*\|.*\|\s*$", "tables are not supported by the fiction compiler"),
    (r"^\s*([-*+]|\d+[.)])\s+\S", "lists are not supported by the fiction compiler"),
    (r"^\s*<[a-zA-Z]", "raw HTML is not supported by the fiction compiler"),
]
# Fixed value: a line that breaks a scene.
SCENE_BREAK = r"\s*([*#~\-]\s*){3,}$"
_RESULT = "struct<body:string,errors:array<struct<line:int,message:string>>>"


def _kind(line: str) -> tuple[str, str]:
    """Class of a line and what of it is shown."""
    if not line:
        return "gap", ""
    if re.match(SCENE_BREAK, line):
        return "break", ""
    if head := re.match(r"(#{1,6})\s+(.+)$", line):
        return f"h{len(head[1])}", head[2].strip()
    return ("quote", line[1:].strip()) if line.startswith(">") else ("para", line.strip())


def _styled(text: str) -> str:
    """Strong and emphasis.  Runs of asterisks part the text; a piece between two runs with enough of them left takes those
    beside it, first by two, then by one, and grows together with its neighbours where a run is used up."""
    pieces = re.split(r"(\*+)", escape(text, quote=False))
    texts, stars = pieces[::2], [len(x) for x in pieces[1::2]]
    for need, tag in ((2, "strong"), (1, "em")):
        for i in range(1, len(texts) - 1):
            if texts[i] and stars[i - 1] >= need and stars[i] >= need:
                texts[i] = f"<{tag}>{texts[i]}</{tag}>"
                stars[i - 1], stars[i] = stars[i - 1] - need, stars[i] - need
        joined, left = [texts[0]], []
        for n, piece in zip(stars, texts[1:], strict=True):
            if n:
                left.append(n)
                joined.append(piece)
            else:
                joined[-1] += piece
        texts, stars = joined, left
    return texts[0] + "".join("*" * n + piece for n, piece in zip(stars, texts[1:], strict=True))


def xhtml(markdown: str | None) -> dict:
    """Body and errors; null is empty. Neighbouring lines of one paragraph or quotation join."""
    blocks: list[tuple[str, list[str]]] = []
    errors = []
    for number, raw in enumerate(re.sub(r"(?s)<!--.*?-->", "", markdown or "").splitlines(), 1):
        kind, shown = _kind(raw.rstrip() if raw.strip() else "")
        if kind == "para":
            errors += [{"line": number, "message": f"{said}: {raw.strip()[:60]!r}"} for pattern, said in REFUSED if re.search(pattern, raw)][:1]
        if blocks and kind in ("para", "quote") and blocks[-1][0] == kind:
            blocks[-1][1].append(shown)
        else:
            blocks.append((kind, [shown]))
    frames = {"para": "<p>{}</p>", "quote": "<blockquote><p>{}</p></blockquote>", "break": '<hr class="scene-break"/>'}
    body = [frames.get(kind, f"<{kind}>{{}}</{kind}>").format(_styled(" ".join(parts))) for kind, parts in blocks if kind != "gap"]
    return {"body": "\n".join(body), "errors": errors}


def compile_chapters(chapters: DataFrame) -> DataFrame:
    """manuscript_id, chapter, body, errors (array of line and message) of each chapter."""

    def render(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([xhtml(x) for x in raw], columns=["body", "errors"])

    return chapters.select("manuscript_id", "chapter", F.pandas_udf(render, _RESULT)("raw").alias("r")).select("manuscript_id", "chapter", "r.*")
