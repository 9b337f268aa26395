"""Human pass: choose lines of a chapter, read a worksheet back, splice rewrites in under protection marks.

A chapter is one row, so each step is row-local; rewrites meet their chapter by an equi-join on its name and are folded in
by a native aggregate, highest offset first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions import lexicons as lx

START, END = "<!-- hp:start -->", "<!-- hp:end -->"
QUOTES = "\"'“”‘’"
_BLANK = "\x00"
_BREAK = re.compile(r"(?<=[.!?])[\"'”’\s]+")
_HIDDEN = re.compile(re.escape(START) + r".*?" + re.escape(END) + r"|<!--.*?-->|^#[^\n]*$", re.DOTALL | re.MULTILINE)
_LINE = "index int, kind string, start int, end int, text string"
_ARROW = {"index": pa.int32(), "kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "text": pa.string()}
#: Lines that leave a batch together.
LINES = 1024
_ENTRY = "struct<entries:array<struct<chapter:string,index:int,kind:string,start:int,end:int,sha256:string,original:string,rewrite:string>>,errors:array<string>>"


def spans_of(raw: str) -> list[tuple[int, int]]:
    """Offsets of sentences outside comments, headings and protected text, without surrounding blanks."""
    text = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", _BLANK, m[0]), raw)
    edges = [0, *(x for m in _BREAK.finditer(text) for x in m.span()), len(text)]
    found = []
    for start, end in zip(edges[::2], edges[1::2]):
        part = text[start:end]
        blank = lambda s: s.strip(_BLANK + " \t\r\n\f\v\x85\xa0  　")
        if body := blank(part):
            first = start + part.index(body)
            found.append((first, first + len(body)))
    return found


def choose(raw: str | None, most: int = 10) -> list[dict]:
    """Opening, closing, longest, first simile, first dialogue and first maxim; a span keeps the first kind that claims it."""
    spans = spans_of(raw or "")
    if not spans:
        return []
    said = {s: raw[s[0] : s[1]] for s in spans}
    wanted = [
        ("opening", spans[:1]),
        ("closing", spans[-1:]),
        ("longest", [max(spans, key=lambda s: s[1] - s[0])]),
        ("simile", [s for s in spans if re.search(lx.SIMILE, said[s], re.IGNORECASE)][:1]),
        ("dialogue_opener", [s for s in spans if said[s][0] in QUOTES or said[s][-1] in QUOTES][:1]),
        ("maxim", [s for s in spans if re.search(lx.ABSTRACT, said[s], re.IGNORECASE) and not re.search(lx.CONCRETE, said[s], re.IGNORECASE)][:1]),
    ]
    kinds: dict[tuple[int, int], str] = {}
    for kind, hits in wanted:
        for span in hits:
            kinds.setdefault(span, kind)
    return [{"kind": kinds[s], "start": s[0], "end": s[1], "text": said[s]} for s in sorted(kinds)][:most]


def select_lines(chapters: DataFrame) -> DataFrame:
    """manuscript_id, chapter, sha256 of the text, index from 1, kind, start, end (code points), text.

    Of an Arrow batch, one text at a time becomes a Python string, and lines leave it ``LINES`` at a time.
    """
    read = chapters.select("manuscript_id", "chapter", F.sha2("raw", 256).alias("sha256"), "raw")
    told = StructType([f for f in read.schema if f.name != "raw"] + list(StructType.fromDDL(_LINE)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids = batch.column("raw"), batch.select(["manuscript_id", "chapter", "sha256"])
            rows, lines = [], []
            for at in range(batch.num_rows):
                found = choose(raw[at].as_py())
                rows += [at] * len(found)
                lines += [{"index": k} | x for k, x in enumerate(found, 1)]
                if len(lines) >= LINES:
                    yield _beside(ids, rows, lines)
                    rows, lines = [], []
            if lines:
                yield _beside(ids, rows, lines)

    return read.mapInArrow(pick, told)


def _beside(ids: pa.RecordBatch, rows: list[int], lines: list[dict]) -> pa.RecordBatch:
    """Lines behind the columns of the rows that they are of."""
    own = ids.take(pa.array(rows, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [*own.columns, *(pa.array([x[n] for x in lines], t) for n, t in _ARROW.items())], names=[*own.schema.names, *_ARROW]
    )


def worksheet(lines: DataFrame) -> DataFrame:
    """One worksheet text per manuscript from the chosen lines."""
    fence = F.lit("```")
    head = F.format_string('entry  chapter=%s  index=%d  kind=%s  start=%d  end=%d  sha256="%s"', "chapter", "index", "kind", "start", "end", "sha256")
    block = F.concat_ws("\n", head, F.lit("ORIGINAL:"), fence, F.col("text"), fence, F.lit("REWRITE:"), fence, F.col("text"), fence, F.lit(""))
    blocks = F.array_sort(F.collect_list(F.struct("chapter", "index", block.alias("block"))))
    return lines.groupBy("manuscript_id").agg(F.concat(F.lit("# Human Pass Worksheet\n\n"), F.array_join(F.transform(blocks, lambda b: b.block), "\n")).alias("raw"))


def read_worksheet(text: str | None) -> dict:
    """Entries and errors of a worksheet; a malformed block is an error and its entry is left out."""
    rows, at, entries, errors = (text or "").splitlines(), 0, [], []

    def fenced(label: str) -> str | None:
        nonlocal at
        if [x.strip() for x in rows[at : at + 2]] != [f"{label}:", "```"]:
            return None
        close = next((i for i in range(at + 2, len(rows)) if rows[i].strip() == "```"), None)
        if close is None:
            return None
        body, at = "\n".join(rows[at + 2 : close]), close + 1
        return body

    while at < len(rows):
        line_no, head = at + 1, rows[at]
        at += 1
        if not re.match(r"\s*entry\s", head):
            continue
        fields = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("[^"]*"|\S+)', head)}
        bodies = [fenced("ORIGINAL"), None]
        bodies[1] = fenced("REWRITE") if bodies[0] is not None else None
        if None in bodies:
            errors.append(f"line {line_no}: block missing or open")
        elif lacking := [k for k in ("chapter", "index", "kind", "start", "end", "sha256") if k not in fields]:
            errors.append(f"line {line_no}: entry missing {', '.join(lacking)}")
        elif not all(fields[k].isdigit() for k in ("index", "start", "end")):
            errors.append(f"line {line_no}: a number is expected in index, start and end")
        else:
            entries.append(fields | {k: int(fields[k]) for k in ("index", "start", "end")} | {"original": bodies[0], "rewrite": bodies[1]})
    return {"entries": entries, "errors": errors}


def parse_worksheets(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and errors of worksheets (manuscript_id, raw)."""
    names = [f.split(":")[0] for f in _ENTRY.removeprefix("struct<entries:array<struct<").split(">")[0].split(",")]

    def read(raw: pd.Series) -> pd.DataFrame:
        found = [read_worksheet(x) for x in raw]
        return pd.DataFrame({"entries": [[{n: e[n] for n in names} for e in f["entries"]] for f in found], "errors": [f["errors"] for f in found]})

    parsed = sheets.select("manuscript_id", F.pandas_udf(read, _ENTRY)("raw").alias("found"))
    return parsed.select("manuscript_id", F.explode("found.entries").alias("e")).select("manuscript_id", "e.*"), parsed.select("manuscript_id", F.explode("found.errors").alias("error"))


def splice(chapters: DataFrame, entries: DataFrame) -> DataFrame:
    """Chapters with rewrites under protection marks: manuscript_id, chapter, raw, applied, skipped, error (raw unchanged then).

    A chapter is refused as a whole if its text has another checksum than the worksheet or an original no longer stands at
    its offset. Entries of unknown chapters come back with a null raw.
    """
    per = entries.groupBy("manuscript_id", "chapter").agg(
        F.min("sha256").alias("sha_low"), F.max("sha256").alias("sha_high"), F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("back"), "start", "end", "original", "rewrite"))).alias("es")
    )
    both = chapters.join(per, ["manuscript_id", "chapter"], "full_outer")
    changed = F.filter("es", lambda e: e.rewrite != e.original)
    moved = F.exists(changed, lambda e: F.substring(F.col("raw"), e.start + 1, e.end - e.start) != e.original)
    error = F.when(F.col("es").isNull(), None).when(F.col("raw").isNull(), "chapter not found").when(F.col("sha_low") != F.col("sha_high"), "entries disagree on the checksum")
    error = error.when(F.sha2("raw", 256) != F.col("sha_low"), "chapter changed since the plan").when(moved, "text moved")
    new = F.aggregate(changed, F.col("raw"), lambda t, e: F.concat(F.left(t, e.start), F.lit(START), e.rewrite, F.lit(END), F.substring(t, e.end + 1, F.length(t))))
    n = F.coalesce(F.size(changed), F.lit(0))
    ok = F.col("es").isNotNull() & F.col("error").isNull()
    return both.withColumn("error", error).select(
        "manuscript_id", "chapter", F.when(ok, new).otherwise(F.col("raw")).alias("raw"), F.when(ok, n).otherwise(0).alias("applied"), F.when(ok, F.size("es") - n).otherwise(0).alias("skipped"), "error"
    )
