"""Rule packs: patterns with limits, kept as rows and read over the chapters of the books that a pack is for.

A pack is appended by appending rows.  A book takes one pack: the one named by its subgenre, else by its genre, else one that says it
matches either; a book without a pack has no rows, and nothing else changes for it.
"""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import Dialect
from folioscope.plans.registry import chapters, plan

#: Rows of the tests: two packs over the markers of time, technology, place and money.
RULES = [("historical", f"H{i}", pattern, 0.0) for i, pattern in enumerate(lx.MARKERS.values(), 1)] + [("modern-life", "M1", "(?i)\\b(?:candle|lantern)s?\\b", 2.0), ("modern-life", "M2", "[0-9]+", 5.0)]
MATCHES = [("historical", "biblical fiction"), ("historical", "period drama"), ("modern-life", "city")]
PROJECTS = [("m1", "Historical", None), ("m2", "Drama", "City")]


def _slug(d: Dialect, x: str) -> str:
    return d.sub(d.sub(f"lower({d.trim(f'coalesce({x}, {d.lit(str())})')})", "[\\s/]+", "-"), "^-+|-+$", "")


def resolved(d: Dialect, rules: str, matches: str, projects: str) -> str:
    """The pack of each book that has one, by the order of the ways to find it."""
    names = f"(SELECT DISTINCT pack FROM {rules} n0)"
    by_name = lambda field, rank: f"SELECT p.manuscript_id, n.pack, {rank} AS way FROM {projects} p JOIN {names} n ON n.pack = {_slug(d, 'p.' + field)}"
    by_match = lambda field: f"SELECT p.manuscript_id, m.pack, 3 AS way FROM {projects} p JOIN {matches} m ON lower(m.matched) = lower({d.trim('p.' + field)})"
    ways = f"({by_name('subgenre', 1)} UNION ALL {by_name('genre', 2)} UNION ALL {by_match('subgenre')} UNION ALL {by_match('genre')})"
    return f"(SELECT manuscript_id, pack FROM (SELECT manuscript_id, pack, row_number() OVER (PARTITION BY manuscript_id ORDER BY way, pack) AS place FROM {ways} w) x WHERE place = 1)"


def scanned(d: Dialect, rel: str, rules: str, matches: str, projects: str) -> str:
    """Places of each rule of a book's pack in its chapters, all words beside them; rules without a place stay.

    A pack's rules travel to a chapter as one array, so a chapter is one row however many rules there are.
    """
    rule = d.struct({"rule": "rule", "pattern": "pattern", "most": "CAST(most_per_1k AS DOUBLE)"})
    bundles = f"(SELECT pack, {'collect_list' if d.spark else 'list'}({rule}) AS rs FROM {rules} b0 WHERE pattern IS NOT NULL GROUP BY pack)"
    count = "regexp_count(p, r.pattern)" if d.spark else "len(regexp_extract_all(bound, r.pattern))"
    told = d.map("rs", "r", d.struct({"rule": "r.rule", "most": "r.most", "n": f"CAST({count} AS BIGINT)", "words": "words"}))
    text = f"(SELECT manuscript_id, {d.strip_comments('raw')} AS p FROM {rel} c0 WHERE raw IS NOT NULL)"
    bound = "" if d.spark else f"{d.bounded('t.p')} AS bound, "
    # books and packs are one small row each and go to the texts: by 20 names of books, texts would meet in as few tasks
    hint = "/*+ BROADCAST(k), BROADCAST(b) */ " if d.spark else ""
    held = f"(SELECT {hint}t.manuscript_id, k.pack, t.p, {bound}b.rs, {d.size(d.lint_tokens('t.p'))} AS words FROM {text} t JOIN {resolved(d, rules, matches, projects)} k ON k.manuscript_id = t.manuscript_id JOIN {bundles} b ON b.pack = k.pack)"
    each = d.spread(f"(SELECT manuscript_id, pack, {told} AS fs FROM {held} h0)", "manuscript_id, pack", "fs", "fpos", "f")
    return f"(SELECT manuscript_id, pack, f.rule AS rule, max(f.most) AS most, CAST(sum(f.n) AS BIGINT) AS n, CAST(sum(f.words) AS BIGINT) AS words FROM {each} e GROUP BY manuscript_id, pack, f.rule)"


def _given(d: Dialect) -> tuple[str, str, str]:
    return d.table("pack_rules", RULES, "pack, rule, pattern, most_per_1k"), d.table("pack_matches", MATCHES, "pack, matched"), d.table("pack_projects", PROJECTS, "manuscript_id, genre, subgenre")


@plan("X24 X32 A1 S16")
def pack_findings(d):
    """Rules of a book's pack that its chapters break: more places in 1,000 words than the rule allows."""
    return f"SELECT manuscript_id, pack, rule, n, round(n * 1000.0 / greatest(words, 1), 6) AS per_1k, most FROM {scanned(d, chapters(d), *_given(d))} x WHERE n * 1000.0 / greatest(words, 1) > most"


@plan("X32")
def pack_bands(d):
    """Rules of a book's pack that have any place: up to one clean, up to three watched, more a failure of fidelity."""
    return f"SELECT manuscript_id, pack, n, CASE WHEN n <= 1 THEN 'clean' WHEN n <= 3 THEN 'watch' ELSE 'fidelity failure' END AS band FROM (SELECT manuscript_id, pack, count(CASE WHEN n > 0 THEN 1 END) AS n FROM {scanned(d, chapters(d), *_given(d))} x GROUP BY manuscript_id, pack) y"
