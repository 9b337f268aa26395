"""Findings of proof, macro structure, chronology and texture banks, in the columns of the lint findings.

Each takes relations by name, so the plans below run them on the driver's documents or the fixtures and
``operators.audits`` on any DataFrame. ``n`` counts the places; ``item`` tells cases of one check apart.
"""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import END, PARAGRAPH_END, WORD, Dialect
from folioscope.plans import fixtures as fx
from folioscope.plans.lint import FIELDS, _documents, _row
from folioscope.plans.registry import chapters, plan

_OUT = "manuscript_id, chapter, " + ", ".join(FIELDS)


def _flags(d: Dialect, more: str = "") -> str:
    """Line-wise patterns: only a line feed ends a line, as in the other engine."""
    return f"(?{'d' if d.spark else ''}m{more})"


def _times(x: str, part: str) -> str:
    return f"(length({x}) - length(replace({x}, '{part}', '')))"


def _opened(d: Dialect, rows: list[str], source: str) -> str:
    found = d.spread(f"(SELECT manuscript_id, chapter, {d.array(rows)} AS fs FROM {source} b)", "manuscript_id, chapter", "fs", "fpos", "f")
    return f"SELECT manuscript_id, chapter, {', '.join(f'f.{k} AS {k}' for k in FIELDS)} FROM {found} g WHERE f.hit"


def _open_quotes(d: Dialect) -> str:
    """Paragraphs whose quotes do not close, unless the next one goes on with the speech."""
    p = d.at("ps", "i")
    left, right, plain = (_times(p, c) for c in "“”\"")
    one = f"(({left} - {right} = 1 AND {plain} = 0) OR ({plain} % 2 = 1 AND {left} = {right}))"
    begins = f"^{chr(92) + 's*' if d.spark else ''}[“" + chr(34) + "]"  # Spark's paragraphs are not trimmed
    goes_on = f"coalesce({one} AND {d.has(p, begins)} AND {d.has(d.at('ps', 'i + 1'), begins)}, false)"
    return d.size(d.keep(d.numbers("1", d.size("ps")), "i", f"({left} <> {right} OR {plain} % 2 = 1) AND NOT {goes_on}"))


def _doubled(d: Dialect) -> str:
    """A word and the same word again with nothing but blanks between; three in a row are one place."""
    if d.spark:
        # letter by letter, as in Dialect.tokens; a pair behind a pair is met by the next match, so places are the same
        return f"CASE WHEN {ODD_CASE} THEN {_pairs(d)} ELSE {d.count('lower(p)', f'(?<!{WORD})({WORD}++)' + chr(92) + 's+' + chr(92) + f'1(?!{WORD})')} END"
    return _pairs(d)


#: Texts on Spark whose lower case is not that of their letters one by one.
ODD_CASE = "(contains(p, 'Σ') OR contains(p, 'İ'))"


def _pairs(d: Dialect) -> str:
    """The same in an array of words and marks, any two neighbours held against each other."""
    a, b = d.at("pieces", "i"), d.at("pieces", "i + 1")
    same = d.map(d.numbers("1", d.size("pieces") + " - 1"), "i", f"CASE WHEN lower({a}) = lower({b}) AND {d.has(a, '^' + WORD)} THEN '1' ELSE '0' END")
    return d.count(f"coalesce({d.join(same, '')}, '')", "11?")


def _where(d: Dialect, needs: list[str], x: str, other: str = "CAST(0 AS BIGINT)") -> str:
    """``x`` where the text p holds any of ``needs``, else ``other``: on Spark a plain search spares most texts a regular expression."""
    return f"CASE WHEN {' OR '.join(d.contains('p', d.lit(n)) for n in needs)} THEN {x} ELSE {other} END" if d.spark else x


def proof(d: Dialect, rel: str) -> str:
    """Typographic findings of chapters (manuscript_id, chapter, ord, raw).

    Quotes and ellipses are held against the manuscript's majority; the other checks need one chapter only. The text
    is read once; what goes on are counts. Editorial comments count as one letter, so their dashes are no dashes.
    """
    low = "array_min(hs)" if d.spark else "list_min(hs)"
    text = f"(SELECT manuscript_id, chapter, ord, {d.sub('raw', '(?s)<!--.*?-->', 'x')} AS p FROM {rel} src WHERE raw IS NOT NULL)"
    parts = f"""(SELECT manuscript_id, chapter, ord, p, {d.paragraphs('p')} AS ps, {d.all_of('p', WORD + r'+|[^' + WORD[1:-1] + r'\s]')} AS pieces, {d.keep(d.lines('p'), 'x', f"{d.trim('x')} <> ''")} AS ls,
        {d.all_of('p', _flags(d) + r'^(#{1,6})\s+\S', 1)} AS hs, {d.map(d.all_of('p', _flags(d) + lx.SCENE_BREAK, 1), 'x', d.trim('x'))} AS breaks, {d.first('p', _flags(d, 'i') + lx.CHAPTER_HEADING, 1)} AS head FROM {text} t)"""
    if d.spark:
        none = "CAST(array() AS ARRAY<STRING>)"
        parts = f"""(SELECT manuscript_id, chapter, ord, p, {_where(d, ['“', '”', '"'], d.whole_parts('p', f'()(?:{PARAGRAPH_END})'), none)} AS ps, CASE WHEN {ODD_CASE} THEN {d.all_of('p', WORD + r'+|[^' + WORD[1:-1] + r'\s]')} ELSE {none} END AS pieces,
            {_where(d, ['#'], d.keep(d.lines('p'), 'x', f"{d.trim('x')} <> ''"), none)} AS ls, {_where(d, ['#'], d.all_of('p', _flags(d) + r'^(#{1,6})\s+\S', 1), none)} AS hs,
            {_where(d, list('*#~-'), d.map(d.all_of('p', _flags(d) + lx.SCENE_BREAK, 1), 'x', d.trim('x')), none)} AS breaks, {_where(d, ['#'], d.first('p', _flags(d, 'i') + lx.CHAPTER_HEADING, 1), "''")} AS head FROM {text} t)"""
    heading = r"^#{1,6}\s+\S"
    counts = {
        "curly": _where(d, ["“", "”"], d.count("p", "[“”]")),
        "curly_any": _where(d, ["“", "”", "’"], d.count("p", "[“”’]")),
        "straight": _where(d, ['"'], f"{d.count('p', chr(34))} - {d.count('p', WORD + chr(34))}"),
        "apostrophes": _where(d, ["'"], d.count(d.sub("p", f"({WORD})'", r"\1_"), "'" + WORD)),
        "dots_one": _where(d, ["…"], d.count("p", "…")),
        "dots_three": _where(d, ["..."], f"{d.count('p', '[.]{3,}')} - {d.count('p', '[.]{4,}')}"),
        "dots_more": _where(d, ["...."], d.count("p", "[.]{4,}")),
        "open_quotes": _open_quotes(d),
        "depth": f"CAST({_times('p', '(')} - {_times('p', ')')} AS BIGINT)",
        "doubled": _doubled(d),
        "spaces": _where(d, ["  ", "\t"], d.count("p", r"[ \t]{2,}")),
        "dashes": f"CASE WHEN {d.contains('p', d.lit('—'))} THEN 1 ELSE 0 END + CASE WHEN {_where(d, ['–'], d.has('p', r'\s–\s'), 'false')} THEN 1 ELSE 0 END + CASE WHEN {d.contains('p', d.lit('--'))} THEN 1 ELSE 0 END",
        "tops": d.size(d.keep("hs", "h", f"h = {low}")),
        "broken": " + ".join(f"CASE WHEN {d.contains('p', d.lit(m))} THEN 1 ELSE 0 END" for m in lx.MOJIBAKE),
        "controls": d.count("p", r"[\x01-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]"),
        "empties": d.size(d.keep(d.numbers("1", d.size("ls")), "i", f"{d.has(d.at('ls', 'i'), heading)} AND coalesce({d.has(d.at('ls', 'i + 1'), heading)}, true)")),
        "file_no": d.number(d.first("chapter", "([0-9]+)", 1), "BIGINT"),
        "head_no": d.number("nullif(head, '')", "BIGINT"),
    }
    per = f"(SELECT manuscript_id, chapter, ord, breaks, {', '.join(f'{v} AS {k}' for k, v in counts.items())} FROM {parts} q)"
    style = f"""(SELECT manuscript_id AS style_of, sum(curly) >= sum(straight) AS is_curly, sum(dots_one) >= sum(dots_three) AS is_one FROM {per} k GROUP BY manuscript_id)"""
    before = "lag(file_no) OVER (PARTITION BY manuscript_id ORDER BY chapter)"
    gaps = f"(SELECT manuscript_id AS gap_in, chapter AS gap_at, ord AS gap_ord FROM (SELECT manuscript_id, chapter, ord, file_no <> {before} + 1 AS gap FROM {per} k WHERE file_no IS NOT NULL) z WHERE gap)"
    whole = f"""(SELECT k.*, s.is_curly, s.is_one, g.gap_at IS NOT NULL AS gap FROM {per} k JOIN {style} s ON s.style_of = k.manuscript_id LEFT JOIN {gaps} g ON g.gap_in = k.manuscript_id AND g.gap_at = k.chapter AND g.gap_ord = k.ord)"""
    quotes, dots = "CASE WHEN is_curly THEN straight + apostrophes ELSE curly_any END", "CASE WHEN is_one THEN dots_three ELSE dots_one END + dots_more"
    found = lambda check, severity, n, least=0, item="NULL": _row(d, check, severity, f"{n} > {least}", n, n, high=str(least), item=item)
    numbering = lambda what, when: _row(d, "chapter_numbering", "fail", when, "1", "1", item=d.lit(what))
    rows = [
        found("quote_style_mixing", "warn", quotes),
        found("unbalanced_quotes", "fail", "open_quotes"),
        found("unbalanced_delims", "fail", "abs(depth)"),
        found("doubled_words", "fail", "doubled"),
        found("doubled_spaces", "warn", "spaces"),
        found("dash_consistency", "warn", "dashes", 1),
        found("ellipsis_consistency", "warn", dots),
        found("heading_levels", "warn", "tops", 1),
        found("mojibake", "fail", "broken + controls"),
        found("empty_sections", "warn", "empties"),
        numbering("no number in the name", "file_no IS NULL"),
        numbering("heading differs", "file_no <> head_no"),
        numbering("gap", "gap"),
    ]
    marks = d.spread(f"(SELECT manuscript_id, breaks FROM {per} k)", "manuscript_id", "breaks", "bpos", "mark")
    scenes = f"(SELECT manuscript_id, {d.text('NULL')} AS chapter, count(DISTINCT mark) AS marks FROM {marks} m GROUP BY manuscript_id)"
    return f"{_opened(d, rows, whole)} UNION ALL {_opened(d, [found('scene_break_consistency', 'warn', 'marks', 1)], scenes)}"


def _mode(d: Dialect, s: str) -> str:
    words = d.size(d.all_of(s, r"[\p{L}\p{N}_'’-]+"))
    return f"""CASE WHEN coalesce({s}, '') = '' THEN 'other' WHEN {d.has(s, "^[“”‘’'" + chr(34) + "]|[“”‘’'" + chr(34) + "]$")} THEN 'dialogue' WHEN {s} LIKE '%?' THEN 'question' WHEN {words} <= 4 THEN 'fragment'
        WHEN {d.has(f'lower({s})', lx.ABSTRACT)} AND NOT {d.has(f'lower({s})', lx.CONCRETE)} THEN 'maxim' WHEN {d.has(f'lower({s})', lx.CONCRETE)} THEN 'image-action' ELSE 'other' END"""


def macro(d: Dialect, rel: str) -> str:
    """Shapes that too many chapters of a manuscript share; manuscripts under six chapters have no findings."""
    text = f"(SELECT manuscript_id, {d.strip_comments('raw')} AS p FROM {rel} src WHERE raw IS NOT NULL)"
    title = d.sub("title", r"(?i)^Chapter\s+[0-9]+\s*[:.\-]?\s*", "")
    body = f"CASE WHEN title = '' THEN p ELSE {d.sub('p', _flags(d) + '^#{1,6}' + chr(92) + 's+.+$', '')} END"
    sents = d.whole_parts(body, END) if d.spark else d.sentences(body)
    side = lambda i: d.trim(d.at("ss", i)) if d.spark else d.at("ss", i)
    parts = f"""(SELECT manuscript_id, {sents} AS ss, {d.count('p', _flags(d) + lx.SCENE_BREAK)} AS breaks, lower({d.first(title, r"[\p{L}\p{N}_'’-]+")}) AS lead_word
        FROM (SELECT manuscript_id, p, {d.first('p', _flags(d) + r'^#{1,6}\s+(.+)$', 1)} AS title FROM {text} t) u)"""
    modes = f"{_mode(d, side('1'))} AS opens, {_mode(d, side('-1'))} AS closes FROM {parts} q"
    if d.spark:
        modes = f"{_mode(d, 'first_s')} AS opens, {_mode(d, 'last_s')} AS closes FROM (SELECT manuscript_id, breaks, lead_word, {side('1')} AS first_s, {side('-1')} AS last_s FROM {parts} q) q1"
    shapes = f"(SELECT manuscript_id, breaks, nullif(lead_word, '') AS lead_word, {modes})"
    total = f"(SELECT manuscript_id AS whole_id, count(*) AS chs, count(lead_word) AS titled FROM {shapes} s GROUP BY manuscript_id HAVING count(*) >= {lx.MACRO_CHAPTERS})"
    kinds = d.array([d.struct({"kind": d.lit(k), "val": v}) for k, v in (("opening_mode_share", "opens"), ("closing_mode_share", "closes"), ("title_parallelism", "lead_word"), ("scene_break_uniformity", d.text("breaks")))])
    each = d.spread(f"(SELECT manuscript_id, {kinds} AS fs FROM {shapes} s)", "manuscript_id", "fs", "fpos", "f")
    counted = f"(SELECT manuscript_id, f.kind AS kind, f.val AS val, count(*) AS n FROM {each} e WHERE f.val IS NOT NULL GROUP BY manuscript_id, f.kind, f.val)"
    of = "CASE WHEN kind = 'title_parallelism' THEN titled ELSE chs END"
    return f"""SELECT manuscript_id, {d.text('NULL')} AS chapter, kind AS check_name, 'warn' AS severity, val AS item, n, CAST(n AS DOUBLE) / ({of}) AS measured, CAST(NULL AS DOUBLE) AS low, CAST({lx.MACRO_SHARE} AS DOUBLE) AS high
        FROM {counted} c JOIN {total} w ON w.whole_id = c.manuscript_id
        WHERE CASE kind WHEN 'scene_break_uniformity' THEN n = chs AND val <> '0' WHEN 'title_parallelism' THEN n >= {lx.MACRO_TITLES} AND CAST(n AS DOUBLE) / ({of}) > {lx.MACRO_SHARE} ELSE CAST(n AS DOUBLE) / ({of}) > {lx.MACRO_SHARE} END"""


def _finding(d: Dialect, check: str, severity: str, item: str, measured: str, source: str) -> str:
    return f"SELECT manuscript_id, {d.text('NULL')} AS chapter, '{check}' AS check_name, '{severity}' AS severity, {item} AS item, CAST(1 AS BIGINT) AS n, CAST({measured} AS DOUBLE) AS measured, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM {source}"


def _record_lines(d: Dialect, rel: str, kinds: dict[str, list[str]], numbers: dict[str, str], more: tuple[str, ...] = ("src", "kind"), only: str = "") -> str:
    """Records of a bank with their fields and why a line is none: an unknown kind, a field missing or no number.

    ``more`` names fields that no kind asks for; with ``only``, lines of other kinds are left out before their fields are read.
    """
    names = sorted({f for fs in kinds.values() for f in fs} | set(more))
    kind = f"lower({d.first('line', r'^\s*([A-Za-z0-9_]+)\s', 1)})"
    lacks = " ".join(f"WHEN record = '{k}' AND ({' OR '.join(f'f_{x} IS NULL' for x in fs)}) THEN 'field missing'" for k, fs in kinds.items())
    odd = " ".join(f"WHEN record = '{k}' AND {expr} IS NULL THEN 'no number'" for k, expr in numbers.items())
    # fields leave one generated struct, so no test of a field is pushed below it and parses the line again
    told = f"contains(lower(line), {d.lit(only)}) AND {kind} = {d.lit(only)}" if only else f"{d.trim('line')} <> '' AND NOT {d.has('line', r'^\s*#')}"
    parsed = d.struct({"record": kind} | {f"f_{x}": d.field("line", x) for x in names})
    each = d.spread(f"(SELECT manuscript_id, lineno, {d.array([parsed])} AS fs FROM {rel} src WHERE {told})", "manuscript_id, lineno", "fs", "fpos", "f")
    real = f"(SELECT manuscript_id, lineno, f.record AS record, {', '.join(f'f.f_{x} AS f_{x}' for x in names)} FROM {each} r1)"
    return f"(SELECT *, CASE WHEN record NOT IN ({', '.join(d.lit(k) for k in kinds)}) THEN 'unknown record' {lacks} {odd} END AS problem FROM {real} r0)"


def timeline(d: Dialect, rel: str) -> str:
    """Contradictions of chronology records (manuscript_id, lineno, line)."""
    kinds = {"event": ["id", "day"], "age": ["person", "at", "years"], "span": ["from", "to", "stated"], "once": ["id", "at"]}
    numbers = {"event": d.days("f_day"), "age": d.number("f_years", "DOUBLE"), "span": d.days("f_stated")}
    lines = _record_lines(d, rel, kinds, numbers, () if d.spark else ("src", "kind"))
    # Spark reads the lines anew for each use: of a kind, that is the lines and fields of this kind alone
    of_one = lambda k: _record_lines(d, rel, {k: kinds[k]}, {x: v for x, v in numbers.items() if x == k}, (), k)
    kept = lambda k: f"{of_one(k) if d.spark else lines} l WHERE record = '{k}' AND problem IS NULL"
    of = lambda k: f"(SELECT * FROM {kept(k)})"
    again = f"(SELECT *, row_number() OVER (PARTITION BY manuscript_id, f_id ORDER BY lineno) AS place FROM {kept('event')})"
    events = f"(SELECT manuscript_id AS of_id, f_id AS event_id, {d.days('f_day')} AS day FROM {again} a WHERE place = 1)"
    at = lambda x, e, f: f"{e}.of_id = {x}.manuscript_id AND {e}.event_id = {x}.{f}"
    refs = " UNION ALL ".join(f"SELECT manuscript_id, {f} AS ref FROM {of(k)} r{i}" for i, (k, f) in enumerate((("age", "f_at"), ("span", "f_from"), ("span", "f_to"), ("once", "f_at"))))
    aged = f"(SELECT a.manuscript_id, a.f_person, a.lineno, {d.number('a.f_years', 'DOUBLE')} AS years, e.day FROM {of('age')} a JOIN {events} e ON {at('a', 'e', 'f_at')})"
    drift = f"""(SELECT manuscript_id, f_person, abs(((lead(years) OVER w) - years) - ((lead(day) OVER w) - day) / 365.25) AS off FROM {aged} g WINDOW w AS (PARTITION BY manuscript_id, f_person ORDER BY day, lineno))"""
    spans = f"(SELECT s.manuscript_id, concat(s.f_from, ' to ', s.f_to) AS item, b.day - a.day AS actual, {d.days('s.f_stated')} AS stated FROM {of('span')} s JOIN {events} a ON {at('s', 'a', 'f_from')} JOIN {events} b ON {at('s', 'b', 'f_to')})"
    twice = f"(SELECT o.manuscript_id, o.f_id, count(DISTINCT o.f_at) AS anchors FROM {of('once')} o JOIN {events} e ON {at('o', 'e', 'f_at')} GROUP BY o.manuscript_id, o.f_id)"
    line = lambda what: f"concat('line ', {d.text('lineno')}, ': ', {what})"
    return " UNION ALL ".join(
        [
            _finding(d, "parse", "fail", line("problem"), "1", f"{lines} p WHERE problem IS NOT NULL"),
            _finding(d, "parse", "fail", line("'id stands before'"), "1", f"{again} p WHERE place > 1"),
            _finding(d, "unknown_event", "fail", "ref", "1", f"({refs}) u WHERE NOT EXISTS (SELECT 1 FROM {events} e WHERE {at('u', 'e', 'ref')})"),
            _finding(d, "age_contradiction", "fail", "f_person", "off", f"{drift} x WHERE off > 1.0"),
            _finding(d, "span_contradiction", "fail", "item", "actual - stated", f"{spans} x WHERE abs(actual - stated) > CASE WHEN abs(stated) < 60 THEN 0.5 ELSE 182.625 END"),
            _finding(d, "reversed_span", "fail", "item", "actual", f"{spans} x WHERE actual < 0"),
            _finding(d, "duplicate_occurrence", "fail", "f_id", "anchors", f"{twice} x WHERE anchors > 1"),
        ]
    )


def texture(d: Dialect, bank: str, rel: str) -> str:
    """Findings of a texture bank (manuscript_id, lineno, line) over the chapters of its manuscript.

    The bank is a list kept by hand, so a manuscript's terms travel to its chapters as one array; counts come back.
    """
    lines = _record_lines(d, bank, {"texture": ["id", "term"]}, {})
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY manuscript_id, f_id ORDER BY lineno) AS place FROM {lines} l WHERE problem IS NULL)"
    terms = f"(SELECT manuscript_id AS of_id, {d.sorted_set('lower(f_term)')} AS terms FROM {ranked} r WHERE place = 1 GROUP BY manuscript_id)"
    # on Spark, a text is put into lower case once, not for each term, and texts stay where they are read
    kept = d.let("lower(c.raw)", "low", d.keep("t.terms", "x", "contains(low, x)")) if d.spark else d.keep("t.terms", "x", "contains(lower(c.raw), x)")
    held = d.spread(f"(SELECT {'/*+ BROADCAST(t) */ ' if d.spark else ''}c.manuscript_id, {kept} AS fs FROM {rel} c JOIN {terms} t ON t.of_id = c.manuscript_id WHERE c.raw IS NOT NULL)", "manuscript_id", "fs", "fpos", "term")
    used = f"(SELECT DISTINCT manuscript_id AS used_in, term AS used_term FROM {held} h)"
    some = f"(SELECT DISTINCT manuscript_id AS some_id FROM {rel} c0)"
    kinds = ", ".join(d.lit(k) for k in lx.TEXTURE_KINDS)
    line = lambda what: f"concat('line ', {d.text('lineno')}, ': ', {what})"
    return " UNION ALL ".join(
        [
            _finding(d, "parse", "fail", line("problem"), "1", f"{lines} p WHERE problem IS NOT NULL"),
            _finding(d, "parse", "fail", line("'id stands before'"), "1", f"{ranked} p WHERE place > 1"),
            _finding(d, "missing_src", "warn", "f_id", "1", f"{ranked} p WHERE place = 1 AND f_src IS NULL"),
            _finding(d, "unknown_kind", "warn", "concat(f_id, ': ', f_kind)", "1", f"{ranked} p WHERE place = 1 AND f_kind NOT IN ({kinds})"),
            _finding(d, "unused_texture", "warn", "f_id", "0", f"{ranked} p JOIN {some} s ON s.some_id = p.manuscript_id LEFT JOIN {used} u ON u.used_in = p.manuscript_id AND u.used_term = lower(p.f_term) WHERE p.place = 1 AND u.used_in IS NULL"),
        ]
    )


def _shown(sql: str) -> str:
    return f"SELECT manuscript_id, chapter, check_name, severity, item, n, round(measured, 6) AS measured, low, high FROM ({sql}) shown"


def _bank(d: Dialect, name: str, rows: list) -> str:
    return d.table(name, [("m1", *r) for r in rows], "manuscript_id, lineno, line")


@plan("A35 A36 W5 W6 W9 W15 W16 W17 P10 C18")
def proof_findings(d):
    """Typographic findings of all documents, each source a manuscript."""
    return _shown(proof(d, _documents(d)))


@plan("A35 A36 W5 W6 W9 W15 W16 W17 P10")
def proof_chapters(d):
    return _shown(proof(d, chapters(d)))


@plan("P11 P12 P13 A20 C14 C18")
def macro_findings(d):
    """Shared shapes of all documents, each language a manuscript."""
    return _shown(macro(d, _documents(d, "lang")))


@plan("J5 J6 J7 W8 A30 S5 C17 C18")
def timeline_issues(d):
    return _shown(timeline(d, _bank(d, "records", fx.TIMELINE)))


@plan("S6 J2 A21 W12 C18")
def texture_issues(d):
    return _shown(texture(d, _bank(d, "bank", fx.TEXTURE), chapters(d)))


def occurrences(d: Dialect, rel: str, text: str, pattern: str) -> str:
    """Matches of a pattern in chapters: number, start (from 0), matched text and the text between it and the one before.

    A start is the length of all that stands before, so only lengths meet in the window, not texts.
    """
    mark = "\x1f"
    split = f"{'split' if d.spark else 'string_split'}({d.sub('p', pattern, mark)}, {d.lit(mark)})"
    cut = f"(SELECT manuscript_id, chapter, {d.all_of('p', pattern)} AS hits, {split} AS gaps FROM (SELECT manuscript_id, chapter, {d.sub(text, mark, ' ')} AS p FROM {rel} src WHERE raw IS NOT NULL) t)"
    each = d.spread(f"{cut} u", "manuscript_id, chapter, gaps", "hits", "i", "hit")
    w = "OVER (PARTITION BY manuscript_id, chapter ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(SELECT manuscript_id, chapter, i, hit, gap, CAST(sum(length(gap) + length(hit)) {w} - length(hit) AS BIGINT) AS start FROM (SELECT manuscript_id, chapter, i, hit, {d.at('gaps', 'i + 1')} AS gap FROM {each} e) f)"


#: Flaws that a pattern finds by itself, and what a text must hold to be searched for some of them.
SIMPLE = {"doubled_spaces": r"[^\s.]  +", "mojibake": "|".join(m.replace("|", "[|]") for m in lx.MOJIBAKE), "control_character": "[\x01-\x08\x0b\x0c\x0e-\x1e\x7f]"}
NEEDS = {"doubled_spaces": ["  "], "mojibake": lx.MOJIBAKE}
#: A word with itself in any case behind blanks, which stay for the next match.
AHEAD = f"(?iu)(?<!{WORD})({WORD}++)(?=\\s++\\1(?!{WORD}))"


def _excerpt(d: Dialect) -> str:
    return f"replace(substring(c.raw, CAST(greatest(f.start - 29, 1) AS INT), CAST(f.size + 30 + least(f.start, 30) AS INT)), {d.lit(chr(10))}, ' ')"


def _marked_places(d: Dialect, rel: str) -> str:
    """``proof_places`` for Spark: a text is cut at its flaws, so rows go with these, not with its words.

    Of each kind, odd parts are flaws and even ones what stands between.  Lengths and ends of lines of the parts before a flaw
    give its start and line.  Two words are the same if each one's lower case is, which the pattern is wider than.
    """
    mark = "\x1f"
    cuts = {k: f"split({d.sub('p', v if k == 'doubled_words' else f'({v})', mark + chr(92) + '1' + mark)}, {d.lit(mark)})" for k, v in ({"doubled_words": AHEAD} | SIMPLE).items()}
    whole = {k: _where(d, NEEDS[k], v, "CAST(array() AS ARRAY<STRING>)") if k in NEEDS else v for k, v in cuts.items()}
    kinds = d.keep(d.array([d.struct({"kind": d.lit(k), "ps": v}) for k, v in whole.items()]), "x", "size(x.ps) > 1")
    texts = f"(SELECT manuscript_id, chapter, replace(raw, {d.lit(mark)}, ' ') AS p FROM {rel} src WHERE raw IS NOT NULL)"
    of_kind = d.spread(f"(SELECT manuscript_id, chapter, {kinds} AS ks FROM {texts} t0)", "manuscript_id, chapter", "ks", "kpos", "k")
    parts = d.spread(f"(SELECT manuscript_id, chapter, k.kind AS kind, k.ps AS ps FROM {of_kind} t1)", "manuscript_id, chapter, kind, ps", "ps", "i", "hit")
    beside = ", ".join(f"get(ps, CAST(i AS INT) + {j}) AS {n}" for j, n in ((-1, "gap"), (1, "after"), (2, "next_hit")))
    near = f"(SELECT manuscript_id, chapter, kind, i, hit, {beside} FROM {parts} t2 WHERE i % 2 = 1)"
    ends = lambda x: f"(length({x}) - length(replace({x}, {d.lit(chr(10))}, '')))"
    blanks = f"(SELECT *, CASE WHEN kind = 'doubled_words' THEN {d.first('after', '^' + chr(92) + 's+')} END AS blank FROM {near} t3)"
    again = "CASE WHEN kind = 'doubled_words' THEN lower(hit) = lower(CASE WHEN length(after) > length(blank) THEN substring(after, length(blank) + 1, length(hit)) ELSE next_hit END) ELSE true END"
    sized = f"(SELECT manuscript_id, chapter, kind, i, length(gap) AS skip, length(hit) AS len, {ends('gap')} AS skip_ends, {ends('hit')} AS len_ends, CASE WHEN kind = 'doubled_words' THEN 2 * length(hit) + length(blank) ELSE length(hit) END AS size, {again} AS again FROM {blanks} t4)"
    w = "OVER (PARTITION BY manuscript_id, chapter, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = f"(SELECT manuscript_id, chapter, kind AS check_name, CAST(sum(skip + len) {w} - len AS BIGINT) AS start, CAST(size AS BIGINT) AS size, CAST(sum(skip_ends + len_ends) {w} - len_ends + 1 AS BIGINT) AS line, again FROM {sized} t5)"
    return f"SELECT f.manuscript_id, f.chapter, f.check_name, f.start, f.line, {_excerpt(d)} AS excerpt FROM {placed} f JOIN {rel} c ON c.manuscript_id = f.manuscript_id AND c.chapter = f.chapter WHERE f.again"


def proof_places(d: Dialect, rel: str) -> str:
    """Places of doubled words, doubled blanks, control characters and broken encodings, with line number and excerpt."""
    if d.spark:
        return _marked_places(d, rel)
    text = "raw"
    words = occurrences(d, rel, text, WORD + "+")
    doubled = f"SELECT manuscript_id, chapter, 'doubled_words' AS check_name, start, size FROM (SELECT manuscript_id, chapter, lag(start) OVER w AS start, CAST(start + length(hit) - lag(start) OVER w AS BIGINT) AS size, lower(hit) = lower(lag(hit) OVER w) AND {d.has('gap', r'^\s+$')} AS again FROM {words} x WINDOW w AS (PARTITION BY manuscript_id, chapter ORDER BY i)) y WHERE again"
    arms = [doubled, *(f"SELECT manuscript_id, chapter, '{name}', start, CAST(length(hit) AS BIGINT) FROM {occurrences(d, rel, text, p)} o" for name, p in SIMPLE.items())]
    lines = f"length(left(c.raw, CAST(f.start AS INT))) - length(replace(left(c.raw, CAST(f.start AS INT)), {d.lit(chr(10))}, '')) + 1"
    excerpt = _excerpt(d)
    return f"SELECT f.manuscript_id, f.chapter, f.check_name, f.start, CAST({lines} AS BIGINT) AS line, {excerpt} AS excerpt FROM ({' UNION ALL '.join(arms)}) f JOIN {rel} c ON c.manuscript_id = f.manuscript_id AND c.chapter = f.chapter"


@plan("P10")
def proof_excerpts(d):
    """Places in the chapters with their line and thirty characters on either side."""
    return proof_places(d, d.table("chapters", fx.FLAWED, "manuscript_id, chapter, ord, raw"))


@plan("P10")
def proof_document_places(d):
    """The same over all documents."""
    return proof_places(d, _documents(d))
