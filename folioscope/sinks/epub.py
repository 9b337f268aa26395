"""EPUB 3 of a manuscript, the same bytes for the same chapters: entries have one fixed date, the mimetype is first and stored."""

from __future__ import annotations

import io
import uuid
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.markup import xhtml

EPOCH = (1980, 1, 1, 0, 0, 0)
# Matter in its order before and behind the chapters.
FRONT_MATTER = ["half-title", "title-page", "copyright", "dedication", "epigraph"]
BACK_MATTER = ["acknowledgments", "about-the-author", "also-by"]
STYLE = "body { margin: 0 6%; line-height: 1.5; }\np { margin: 0; text-indent: 1.4em; }\nh1, h2 { text-align: center; }\nhr.scene-break { border: 0; text-align: center; margin: 1.2em 0; }\n"
META = ["title", "author", "language", "identifier", "publisher", "rights", "description", "pubdate"]
_XML = '<?xml version="1.0" encoding="UTF-8"?>\n'


def _page(title: str, body: str, style: bool = True) -> str:
    link = '<link rel="stylesheet" type="text/css" href="style.css"/>' if style else ""
    return f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title>{link}</head><body>{body}</body></html>\n'


def identifier(meta: dict[str, str]) -> str:
    """A book's own identifier, or one that title and author give, the same each time."""
    return meta.get("identifier") or f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, meta['title'] + '|' + meta['author'])}"


def archive(meta: dict[str, str], pages: list[tuple[str, str]]) -> bytes:
    """Archive of pages (title, body) in order, with a book's metadata (``META``; title, author and language are needed)."""
    ids = [f"page{i:05d}" for i in range(1, len(pages) + 1)]
    items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
    items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="style" href="style.css" media-type="text/css"/>'
    toc = "".join(f'<li><a href="{i}.xhtml">{escape(t)}</a></li>' for i, (t, _) in zip(ids, pages, strict=True))
    told = {"title": meta["title"], "creator": meta["author"], "language": meta["language"], "publisher": meta.get("publisher"), "rights": meta.get("rights"), "description": meta.get("description"), "date": meta.get("pubdate")}
    head = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in told.items() if v)
    head += f'<dc:identifier id="book-id">{escape(identifier(meta))}</dc:identifier><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta>'
    spine = "".join(f'<itemref idref="{i}"/>' for i in ids)
    files = [("mimetype", "application/epub+zip")]
    files += [("META-INF/container.xml", f'{_XML}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n')]
    files += [("OEBPS/content.opf", f'{_XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book-id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{head}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>\n')]
    files += [("OEBPS/nav.xhtml", _page("Contents", f'<nav epub:type="toc"><ol>{toc}</ol></nav>', style=False)), ("OEBPS/style.css", STYLE)]
    files += [(f"OEBPS/{i}.xhtml", _page(*page)) for i, page in zip(ids, pages, strict=True)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in files:
            info = zipfile.ZipInfo(name, EPOCH)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            book.writestr(info, text)
    return out.getvalue()


def problems(meta: dict[str, str]) -> list[str]:
    """Fields that a book must have and lacks."""
    return [f"{k} is missing" for k in ("title", "author", "language") if not (meta.get(k) or "").strip()]


def books(chapters: DataFrame, author: str = "Unknown Author", language: str = "en", meta: DataFrame | None = None, matter: DataFrame | None = None) -> DataFrame:
    """manuscript_id, epub (binary, null if anything is wrong), errors. A book is one task: one archive has its whole text.

    ``meta`` (manuscript_id and columns of ``META``) gives a book's metadata; without a row there, its id is the title, and
    ``author`` and ``language`` are taken.  ``matter`` (manuscript_id, kind, raw) stands before or behind the chapters in
    its fixed order; an unknown kind is an error.
    """
    order = {k: i - len(FRONT_MATTER) for i, k in enumerate(FRONT_MATTER)} | {k: 1 + i for i, k in enumerate(BACK_MATTER)}
    parts = chapters.selectExpr("manuscript_id", "chapter", "CAST(ord AS BIGINT) AS ord", "raw", "0 AS place")
    if matter is not None:
        place = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
        parts = parts.unionByName(matter.select("manuscript_id", F.col("kind").alias("chapter"), F.lit(0).cast("long").alias("ord"), "raw", F.coalesce(F.try_element_at(place, F.col("kind")), F.lit(99)).alias("place")))
    told = F.lit(None).cast("map<string,string>")
    if meta is not None:
        known = [k for k in META if k in meta.columns]
        given = meta.select("manuscript_id", F.create_map(*(x for k in known for x in (F.lit(k), F.col(k).cast("string")))).alias("meta")).dropDuplicates(["manuscript_id"])
        parts = parts.join(given, "manuscript_id", "left")
    else:
        parts = parts.withColumn("meta", told)

    def bind(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "ord", "chapter"])
        manuscript = part["manuscript_id"].iloc[0]
        given = part["meta"].iloc[0]
        about = dict(given) if given else {"title": manuscript, "author": author, "language": language}
        made = [(c, xhtml(r)) for c, r in zip(part["chapter"], part["raw"], strict=True)]
        errors = problems(about) + [f"{c}: unknown matter" for c, p in zip(part["chapter"], part["place"], strict=True) if p == 99]
        errors += [f"{c}:{e['line']}: {e['message']}" for c, x in made for e in x["errors"]]
        return pd.DataFrame([(manuscript, None if errors else archive(about, [(c, x["body"]) for c, x in made]), errors)], columns=["manuscript_id", "epub", "errors"])

    return parts.select("manuscript_id", "chapter", "ord", "raw", "place", "meta").groupBy("manuscript_id").applyInPandas(bind, "manuscript_id string, epub binary, errors array<string>")
