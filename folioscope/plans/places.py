"""Places of every typographic flaw, with line and excerpt: one relation of marks for all checks.

All marks that any check looks at, line ends among them, leave a text together as one array.  Their offsets are running sums
of lengths, their lines running counts of the line ends before them; texts meet the few flaws once more, for the excerpts.
"""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import WORD, Dialect
from folioscope.plans import fixtures as fx
from folioscope.plans.audits import _flags, _times
from folioscope.plans.lint import _documents
from folioscope.plans.registry import plan

#: A letter of the private use area parts texts; where a text has it, it counts as an x.
MARK = ""
#: Letters shown on either side of a flaw, and of a paragraph.
PAD, PARAGRAPH = 30, 60
_OF = "manuscript_id, chapter, ord"


def _split(d: Dialect, x: str, pattern: str) -> str:
    return f"{'split' if d.spark else 'string_split'}({d.sub(x, pattern, MARK)}, {d.lit(MARK)})"


def _lengths(d: Dialect, a: str, last: str, more: int = 0) -> str:
    """Letters of the first ``last`` elements, and ``more`` for each."""
    return f"CAST({d.total(d.map(d.cut(a, '1', last), 'y', f'CAST(length(y) + {more} AS DOUBLE)'))} AS BIGINT)"


def _layout(d: Dialect, rel: str) -> str:
    """Chapters (p) whose comments are letters x, line ends kept, so that offsets are those of the file."""
    comment = "(?s)<!--.*?-->"
    parts = f"(SELECT {_OF}, q, {d.map(d.all_of('q', comment), 'c', d.sub('c', '[^' + chr(10) + ']', 'x'))} AS hits, {_split(d, 'q', comment)} AS gaps FROM (SELECT {_OF}, {d.sub('raw', MARK, 'x')} AS q FROM {rel} c0 WHERE raw IS NOT NULL) c1)"
    zipped, gap, hit = ("arrays_zip(gaps, hits)", "z.gaps", "z.hits") if d.spark else ("list_zip(gaps, hits)", "z[1]", "z[2]")
    whole = d.join(d.map(zipped, "z", f"concat({gap}, coalesce({hit}, ''))"), "")
    return f"(SELECT {_OF}, CASE WHEN {d.contains('q', d.lit('<!--'))} THEN {whole} ELSE q END AS p FROM {parts} c2)"


def _marks(d: Dialect) -> dict[str, str]:
    return {
        "straight": '"', "apostrophe": "'", "curly": "[“”]", "tick": "’", "paren": "[()]", "spaces": r"[ \t]{2,}", "dots": "[.]{3,}", "ellipsis": "…",
        "heading": _flags(d) + r"^#{1,6}\s+\S.*$", "control": r"[\x01-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]",
    } | ({"doubled": AGAIN} if d.spark else {"word": WORD + "+"})


#: What a text must hold for a mark to be looked for at all: most texts hold few of them, and a plain search is cheap.
NEEDS = {"straight": ['"'], "apostrophe": ["'"], "curly": ["“", "”"], "tick": ["’"], "paren": ["(", ")"], "spaces": ["  ", "\t"], "dots": ["..."], "ellipsis": ["…"], "heading": ["#"]}
#: A word and itself again, by a reference back; the engine that knows none compares neighbours in an array.
AGAIN = r"(?iu)(?<![\p{L}\p{N}_])([\p{L}\p{N}_]+)\s+\1(?![\p{L}\p{N}_])"


def _guarded(d: Dialect, kind: str, array: str) -> str:
    if kind not in NEEDS:
        return array
    when = "(" + " OR ".join(d.contains("p", d.lit(x)) for x in NEEDS[kind]) + ")"
    return f"CASE WHEN {when} THEN {array} ELSE {'CAST(array() AS ARRAY<STRING>)' if d.spark else 'CAST([] AS VARCHAR[])'} END"


def _mark(d: Dialect, kind: str, i: str, skip: str, hit: str, size: str, pre="''", post="''", blank="false", given="NULL") -> str:
    number = lambda x: f"CAST({x} AS BIGINT)"
    return d.struct({"kind": d.lit(kind), "i": number(i), "skip": number(skip), "hit": d.text(hit), "size": number(size), "pre": d.text(pre), "post": d.text(post), "blank": blank, "given": number(given)})


def _arrays(d: Dialect, rel: str) -> str:
    """One row for each chapter with an array of its marks (fs)."""
    marks = _marks(d)
    held = ", ".join(f"{_guarded(d, k, d.all_of('p', v))} AS h_{k}, {_guarded(d, k, _split(d, 'p', v))} AS g_{k}" for k, v in marks.items()) + f", {d.lines('p')} AS g_line"
    dashes = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in (d.contains("p", d.lit("—")), d.has("p", r"\s–\s"), d.contains("p", d.lit("--"))))
    head = _flags(d, "i") + lx.CHAPTER_HEADING
    base = f"(SELECT {_OF}, p, {held}, {_split(d, 'p', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} AS paras, {dashes} AS dashes, {d.first('p', head, 0)} AS head, {d.first('p', head, 1)} AS head_no FROM {_layout(d, rel)} m0)"
    if not d.spark:
        # doubled words: one letter for each pair of neighbours, 1 where they are the same word with nothing but blanks between
        same = f"lower({d.at('h_word', 'i')}) = lower({d.at('h_word', 'i + 1')}) AND {d.has('coalesce(' + d.at('g_word', 'i + 1') + ', ' + d.lit('') + ')', '^' + chr(92) + 's+$')}"
        paired = f"(SELECT *, coalesce({d.join(d.map(d.numbers('1', d.size('h_word') + ' - 1'), 'i', f'CASE WHEN {same} THEN 1 ELSE 0 END'), '')}, '') AS pairs FROM {base} m1)"
        runs = f"(SELECT *, {d.all_of('pairs', '11?')} AS h_run, {_split(d, 'pairs', '11?')} AS g_run FROM {paired} m2)"
        at_word = f"{_lengths(d, 'g_run', 'k')} + {_lengths(d, 'h_run', 'k - 1')} + 1"
        base = f"(SELECT *, {d.map(d.numbers('1', d.size('h_run')), 'k', at_word)} AS twins FROM {runs} m3)"
    p = d.at("paras", "i")
    left, right, plain = (_times(p, c) for c in "“”\"")
    opens = lambda x: f"coalesce({d.has(x, '^' + chr(92) + 's*[“' + chr(34) + ']')}, false)"
    one = f"(({left} - {right} = 1 AND {plain} = 0) OR ({plain} % 2 = 1 AND {left} = {right}))"
    open_paras = d.keep(d.numbers("1", d.size("paras")), "i", f"({left} <> {right} OR {plain} % 2 = 1) AND NOT ({one} AND {opens(p)} AND {opens(d.at('paras', 'i + 1'))})")
    found = f"(SELECT *, {open_paras} AS opened FROM {base} m4)"

    def of(kind: str) -> str:
        h, g, after = d.at(f"h_{kind}", "i"), d.at(f"g_{kind}", "i"), f"coalesce({d.at(f'g_{kind}', 'i + 1')}, '')"
        blank = f"{d.trim(after)} = ''" if kind == "heading" else "false"
        return d.map(d.numbers("1", d.size(f"h_{kind}")), "i", _mark(d, kind, "i", f"length({g})", h, f"length({h})", f"right({g}, 1)", f"left({after}, 1)", blank))

    word = lambda j: d.at("h_word", j)
    doubled = [] if d.spark else [d.map("twins", "j", _mark(d, "doubled", "j", "0", word("j"), f"length({word('j')}) + length({d.at('g_word', 'j + 1')}) + length({word('j + 1')})", given=f"{_lengths(d, 'g_word', 'j')} + {_lengths(d, 'h_word', 'j - 1')}"))]
    paragraphs = d.map("opened", "i", _mark(d, "paragraph", "i", "0", "''", f"least({PARAGRAPH}, length({p}))", given=_lengths(d, "paras", "i - 1", 2)))
    cut = "slice" if d.spark else "list_slice"
    single = lambda when, mark: f"{cut}({d.array([mark])}, 1, CASE WHEN {when} THEN 1 ELSE 0 END)"
    mixed = single("dashes > 1", _mark(d, "dashes", "1", "0", "''", "0", given="0"))
    broken = [single(d.contains("p", d.lit(m)), _mark(d, "broken", str(i), "0", d.lit(m), str(len(m)), given=f"instr(p, {d.lit(m)}) - 1")) for i, m in enumerate(lx.MOJIBAKE)]
    headed = single("coalesce(head, '') <> ''", _mark(d, "chapter", "1", "0", "head_no", "length(head)", given="instr(p, head) - 1"))
    ends = d.map(d.numbers("1", d.size("g_line") + " - 1"), "i", _mark(d, "line", "i", f"length({d.at('g_line', 'i')})", "''", "1"))
    arrays = [ends] + [of(k) for k in marks if k != "word"] + [*doubled, paragraphs, mixed, headed, *broken]
    return f"(SELECT {_OF}, {d.flatten(d.array(arrays))} AS fs FROM {found} m5)"


def places(d: Dialect, rel: str) -> str:
    """Flaws of chapters (manuscript_id, chapter, ord, raw): check, severity, start from 0, line, excerpt and what it is about.

    Checks of a chapter without a place stand on line 1 (dashes), those of a manuscript or a number on line 0.
    A paragraph's offset takes every break between paragraphs for two letters.
    """
    when = lambda part, n: f"CASE WHEN {d.contains('p', d.lit(part))} THEN {n} ELSE 0 END"
    straights = when('"', f"{_times('p', chr(34))} - {d.count('p', WORD + chr(34))}")
    threes = when("...", f"{d.count('p', '[.]{3,}')} - {d.count('p', '[.]{4,}')}")
    style = f"""(SELECT manuscript_id AS style_of, sum({_times('p', '“')} + {_times('p', '”')}) AS curly, sum({straights}) AS straight, sum({_times('p', '…')}) AS one, sum({threes}) AS three FROM {_layout(d, rel)} s0 GROUP BY manuscript_id)"""
    each = d.spread(f"{_arrays(d, rel)} f0", _OF, "fs", "fpos", "f")
    inner = f"PARTITION BY {_OF}, f.kind ORDER BY f.i, f.hit"
    begun = f"(SELECT {_OF}, f.kind AS kind, f.i AS i, f.hit AS hit, f.size AS size, f.pre AS pre, f.post AS post, f.blank AS blank, coalesce(f.given, CAST(sum(f.skip + f.size) OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - f.size AS BIGINT)) AS start FROM {each} f1)"
    step = "CASE WHEN kind = 'paren' THEN CASE WHEN hit = '(' THEN 1 ELSE -1 END END"
    level = f"CASE WHEN kind = 'heading' THEN length({d.first('hit', '^#+')}) END"
    deep = f"(SELECT *, sum({step}) OVER (PARTITION BY {_OF}, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth, sum({step}) OVER (PARTITION BY {_OF}, kind) AS ends, {level} AS level, min({level}) OVER (PARTITION BY {_OF}, kind) AS top FROM {begun} g0)"
    known = f"""(SELECT *, min(CASE WHEN depth < 0 THEN i END) OVER (PARTITION BY {_OF}, kind) AS sunk, sum(CASE WHEN level = top THEN 1 ELSE 0 END) OVER (PARTITION BY {_OF}, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tops,
        CAST(sum(CASE WHEN kind = 'line' THEN 1 ELSE 0 END) OVER (PARTITION BY {_OF} ORDER BY start, CASE WHEN kind = 'line' THEN 1 ELSE 0 END, kind, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) + 1 AS line FROM {deep} g1)"""
    starts_word, ends_word = d.has("post", f"^{WORD}"), d.has("pre", f"{WORD}$")
    curly, straight = "(s.curly >= s.straight)", "(s.curly < s.straight)"
    file_no = d.number(d.first("k.chapter", "([0-9]+)", 1), "BIGINT")
    check = f"""CASE WHEN kind = 'straight' AND {curly} AND NOT {ends_word} THEN 'quote_style_mixing' WHEN kind = 'apostrophe' AND {curly} AND NOT {ends_word} AND {starts_word} THEN 'quote_style_mixing'
        WHEN kind IN ('curly', 'tick') AND {straight} THEN 'quote_style_mixing' WHEN kind = 'paragraph' THEN 'unbalanced_quotes' WHEN kind = 'paren' AND ends <> 0 AND i = coalesce(sunk, 1) THEN 'unbalanced_delims'
        WHEN kind = 'doubled' THEN 'doubled_words' WHEN kind = 'spaces' THEN 'doubled_spaces' WHEN kind = 'dashes' THEN 'dash_consistency' WHEN kind = 'dots' AND size > 3 THEN 'ellipsis_consistency'
        WHEN kind = 'dots' AND s.one >= s.three THEN 'ellipsis_consistency' WHEN kind = 'ellipsis' AND s.one < s.three THEN 'ellipsis_consistency' WHEN kind = 'heading' AND level = top AND tops = 2 THEN 'heading_levels'
        WHEN kind IN ('broken', 'control') THEN 'mojibake' WHEN kind = 'chapter' AND {d.number('hit', 'BIGINT')} <> {file_no} THEN 'chapter_numbering' END"""
    sunk = "kind = 'paren' AND sunk IS NULL"
    size = f"CASE WHEN kind = 'heading' THEN length({d.first('hit', '^#{1,6}' + chr(92) + 's+' + chr(92) + 'S')}) WHEN kind = 'paren' THEN 1 ELSE size END"
    item = "CASE WHEN kind IN ('heading', 'paragraph', 'dashes') THEN '' WHEN kind = 'control' THEN 'control character' WHEN kind = 'doubled' THEN " + d.first("hit", f"^{WORD}+") + " ELSE hit END"
    cols = "k.manuscript_id, k.chapter, k.ord, k.kind"
    # a heading may break two rules; the marks are read once for both
    both = d.array([d.struct({"name": check, "item": d.text(item), "size": f"CAST({size} AS BIGINT)"}), d.struct({"name": "CASE WHEN kind = 'heading' AND blank THEN 'empty_sections' END", "item": "hit", "size": "CAST(size AS BIGINT)"})])
    told = f"(SELECT {cols}, CASE WHEN {sunk} THEN 0 ELSE start END AS start, CASE WHEN {sunk} THEN 1 ELSE line END AS line, {both} AS cs FROM {known} k JOIN {style} s ON s.style_of = k.manuscript_id WHERE kind <> 'line')"
    out = "manuscript_id, chapter, ord, kind, start, line"
    flaws = f"(SELECT {out}, c.name AS check_name, c.item AS item, c.size AS size FROM {d.spread(f'{told} t0', out, 'cs', 'cpos', 'c')} t1 WHERE c.name IS NOT NULL)"
    low = f"greatest(f.start - {PAD}, 0)"
    excerpt = f"CASE WHEN f.kind = 'dashes' THEN '' WHEN f.check_name = 'empty_sections' THEN f.item ELSE {d.trim(f'replace(substring(c.p, CAST({low} + 1 AS INT), CAST(f.start + f.size + {PAD} - {low} AS INT)), {d.lit(chr(10))}, {d.lit(chr(32))})')} END"
    fails = "('unbalanced_quotes', 'unbalanced_delims', 'doubled_words', 'mojibake', 'chapter_numbering')"
    within = f"SELECT f.manuscript_id, f.chapter, f.check_name, CASE WHEN f.check_name IN {fails} THEN 'fail' ELSE 'warn' END AS severity, f.start, f.line, {excerpt} AS excerpt, f.item FROM {flaws} f JOIN {_layout(d, rel)} c ON c.manuscript_id = f.manuscript_id AND c.chapter = f.chapter AND c.ord = f.ord WHERE f.check_name IS NOT NULL"
    breaks = d.spread(f"(SELECT manuscript_id, {d.map(d.all_of('p', _flags(d) + lx.SCENE_BREAK, 1), 'x', d.trim('x'))} AS bs FROM {_layout(d, rel)} b0 WHERE {' OR '.join(d.contains('p', d.lit(x)) for x in '*#~-')})", "manuscript_id", "bs", "bpos", "mark")
    empty = "CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS line, '' AS excerpt"
    scenes = f"SELECT manuscript_id, {d.text('NULL')} AS chapter, 'scene_break_consistency' AS check_name, 'warn' AS severity, {empty}, {d.join(d.sorted_set('mark'), ' ')} AS item FROM {breaks} b1 GROUP BY manuscript_id HAVING count(DISTINCT mark) > 1"
    named = f"(SELECT manuscript_id, chapter, {d.number(d.first('chapter', '([0-9]+)', 1), 'BIGINT')} AS file_no FROM {rel} n0 WHERE raw IS NOT NULL)"
    numbered = f"(SELECT *, lag(file_no) OVER (PARTITION BY manuscript_id, file_no IS NULL ORDER BY chapter) AS before FROM {named} n1)"
    numbers = f"SELECT manuscript_id, chapter, 'chapter_numbering' AS check_name, 'fail' AS severity, {empty}, CASE WHEN file_no IS NULL THEN 'no number' ELSE concat('gap after ', {d.text('before')}) END AS item FROM {numbered} n2 WHERE file_no IS NULL OR file_no <> before + 1"
    return f"(SELECT manuscript_id, chapter, check_name, severity, CAST(start AS BIGINT) AS start, CAST(line AS BIGINT) AS line, excerpt, item FROM ({within} UNION ALL {scenes} UNION ALL {numbers}) w)"


@plan("P10 A35 A36 W5 W6 W9 W15 W16 W17 C18")
def proof_spans(d):
    """Every flaw of the documents with its place, each source a manuscript."""
    return f"SELECT manuscript_id, chapter, check_name, severity, start, line, excerpt, item FROM {places(d, _documents(d))} x"


@plan("P10")
def proof_spans_chapters(d):
    """The same over the chapters of a caller."""
    return f"SELECT manuscript_id, chapter, check_name, severity, start, line, excerpt, item FROM {places(d, d.table('chapters', fx.FLAWED, 'manuscript_id, chapter, ord, raw'))} x"
