"""Plans over dialogue: spans, attribution, signatures, collisions, drift, ledgers of motifs and texture."""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import Dialect
from folioscope.plans import fixtures as fx
from folioscope.plans.registry import chapters, plan

QUOTED = r"[\"“]([^\"“”]+)[\"”]"
#: A line of dialogue, and names beside a tag verb.
LINE = r"[“\"]([^”\"]{2,})[”\"]"
_VERB = "(?:" + "|".join(lx.TAG_VERBS) + ")"
_NAME = r"([A-Z][\p{L}\p{N}_'’-]+)"
_END = r"(?:$|[^\p{L}\p{N}_])"
VERB_NAME, NAME_VERB, NAME_VERB_BEFORE = rf"^[,.\s]*{_VERB}\s+{_NAME}", rf"^[,.\s]*{_NAME}\s+{_VERB}{_END}", rf"{_NAME}\s+{_VERB}[,:]?\s*$"
#: Characters beside a line in which its tag stands.
CONTEXT = 60
#: Lines of a speaker from which a signature says anything, and the gaps within which two cannot be told apart.
LEAST_LINES, LINE_GAP, QUESTION_GAP, CONTRACTION_GAP = 5, 1.5, 0.10, 0.02


def dialogue(d: Dialect, rel: str = "", keep: str = "manuscript_id, chapter, ord") -> str:
    """Lines with their speaker: a tag behind the line (verb first, then name first), in front of it, or the last speaker of
    the paragraph.  ``keep`` names the columns of ``rel`` that lines carry."""
    paras = d.spread(f"(SELECT {keep}, {d.paragraphs(d.strip_comments('raw'))} AS ps FROM {rel or chapters(d)} c WHERE raw IS NOT NULL) p", keep, "ps", "para", "ptext")
    mark = "\x1f"
    gaps = f"{'split' if d.spark else 'string_split'}({d.sub('ptext', LINE, mark)}, {d.lit(mark)})"
    lines = d.spread(f"(SELECT {keep}, para, {d.all_of('ptext', LINE, 1)} AS said, {gaps} AS gaps FROM {paras} q) s", f"{keep}, para, gaps", "said", "i", "line")
    after, before = f"left(coalesce({d.at('gaps', 'i + 2')}, ''), {CONTEXT})", f"right(coalesce({d.at('gaps', 'i + 1')}, ''), {CONTEXT})"
    tags = ((after, VERB_NAME), (after, NAME_VERB), (before, NAME_VERB_BEFORE))
    tag = "coalesce(" + ", ".join(f"nullif({d.first(x, p, 1)}, '')" for x, p in tags) + ")"
    last = f"last_value(named{') IGNORE NULLS' if d.spark else ' IGNORE NULLS)'} OVER (PARTITION BY {keep}, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(SELECT {keep}, para, i, {d.trim('line')} AS line, coalesce({last}, '?') AS speaker FROM (SELECT {keep}, para, i, line, {tag} AS named FROM {lines} l) n)"


def signatures(d: Dialect, rel: str = "", keys: str = "manuscript_id", keep: str = "manuscript_id, chapter, ord") -> str:
    """Speakers by ``keys``: lines, words, words a line, and shares of questions, contractions and qualifiers."""
    qualifiers = ", ".join(d.lit(w) for w in lx.QUALIFIERS)
    n = lambda a: f"CAST(sum({a}) AS DOUBLE)"
    contracted = d.size(d.keep("ws", "w", d.has("w", "['’]")))
    hedged = d.size(d.keep("ws", "w", f"w IN ({qualifiers})"))
    return f"""(SELECT {keys}, speaker, count(*) AS lines, CAST(sum({d.size('ws')}) AS BIGINT) AS words, {n(d.size('ws'))} / count(*) AS per_line, avg(CASE WHEN line LIKE '%?' THEN 1.0 ELSE 0.0 END) AS questions,
        {n(contracted)} / greatest(sum({d.size('ws')}), 1) AS contractions, {n(hedged)} / greatest(sum({d.size('ws')}), 1) AS qualifiers
        FROM (SELECT {keys}, speaker, line, {d.tokens('line')} AS ws FROM {dialogue(d, rel, keep)} s) w GROUP BY {keys}, speaker)"""


def collisions(d: Dialect, rel: str = "", keys: str = "manuscript_id", keep: str = "manuscript_id, chapter, ord", least: int = LEAST_LINES) -> str:
    """Pairs of speakers of ``keys`` whose signatures cannot be told apart, the one with more lines first."""
    s = signatures(d, rel, keys, keep)
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    kept = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    able = lambda t: f"{t}.speaker <> '?' AND {t}.lines >= {least} AND {t}.words > 0"
    return f"""(SELECT {kept}, concat(a.speaker, ' / ', b.speaker) AS pair FROM {s} a JOIN {s} b ON {same} AND (a.lines > b.lines OR (a.lines = b.lines AND a.speaker < b.speaker))
        WHERE {able('a')} AND {able('b')} AND abs(a.per_line - b.per_line) < {LINE_GAP} AND abs(a.questions - b.questions) < {QUESTION_GAP} AND abs(a.contractions - b.contractions) < {CONTRACTION_GAP})"""


#: Chapters from which thirds of a manuscript are compared.
THIRDS_FROM = 6


def thirds(d: Dialect, rel: str) -> str:
    """Chapters of the first and last third, k = max(1, n div 3), of manuscripts of six chapters or more; numbers are given to keys only."""
    k = "greatest(1, CAST(floor(n / 3.0) AS BIGINT))"
    keys = f"(SELECT manuscript_id, chapter, row_number() OVER (PARTITION BY manuscript_id ORDER BY ord, chapter) AS r, count(*) OVER (PARTITION BY manuscript_id) AS n FROM {rel} x WHERE raw IS NOT NULL)"
    part = f"(SELECT manuscript_id, chapter, CASE WHEN r <= {k} THEN 'early' WHEN r > n - {k} THEN 'late' END AS part FROM {keys} y WHERE n >= {THIRDS_FROM})"
    return f"(SELECT c.manuscript_id, c.chapter, c.ord, t.part, c.raw FROM {rel} c JOIN {part} t ON t.manuscript_id = c.manuscript_id AND t.chapter = c.chapter WHERE t.part IS NOT NULL)"


def drift(d: Dialect, rel: str, least: int = LEAST_LINES) -> str:
    """Pairs that collide late and did not early, and speakers with too few lines in a third to tell."""
    part, keep, keys = thirds(d, rel), "manuscript_id, chapter, ord, part", "manuscript_id, part"
    pairs = f"SELECT manuscript_id, pair AS who, part FROM {collisions(d, part, keys, keep, least)} c"
    sign = f"SELECT manuscript_id, speaker AS who, CASE WHEN lines >= {least} AND words > 0 THEN 1 ELSE 0 END AS able FROM {signatures(d, part, keys, keep)} s WHERE speaker <> '?'"
    return f"""(SELECT manuscript_id, 'drift' AS kind, who FROM ({pairs}) p GROUP BY manuscript_id, who HAVING max(part) = 'late' AND min(part) = 'late'
        UNION ALL SELECT manuscript_id, 'insufficient', who FROM ({sign}) q GROUP BY manuscript_id, who HAVING sum(able) < 2)"""


def _voices(d: Dialect) -> str:
    return d.table("chapters", fx.VOICES, "manuscript_id, chapter, ord, raw")


@plan("P19 P20 W3")
def dialogue_attribution(d):
    return f"SELECT manuscript_id, chapter, para, i, speaker, line FROM {dialogue(d)} s"


@plan("P19 P20 W3")
def dialogue_orders(d):
    """The four orders of name, verb and line, names with apostrophes, hyphens and letters beyond ASCII, and lines without a tag."""
    return f"SELECT manuscript_id, chapter, para, i, speaker, line FROM {dialogue(d, d.table('chapters', fx.TAGS, 'manuscript_id, chapter, ord, raw'))} s"


@plan("A17")
def speaker_stats(d):
    return f"SELECT manuscript_id, speaker, lines, words, round(per_line, 6) AS per_line, round(questions, 6) AS questions, round(contractions, 6) AS contractions, round(qualifiers, 6) AS qualifiers FROM {signatures(d)} s"


@plan("A17 O4 FL1")
def speaker_words(d):
    """Five most frequent content words of each speaker."""
    stop = ", ".join(d.lit(w) for w in lx.FUNCTION_WORDS)
    toks = d.spread(f"(SELECT manuscript_id, speaker, {d.tokens('line')} AS ws FROM {dialogue(d)} s) t", "manuscript_id, speaker", "ws", "pos", "tok")
    return f"""SELECT manuscript_id, speaker, tok, n FROM (SELECT manuscript_id, speaker, tok, count(*) AS n, row_number() OVER (PARTITION BY manuscript_id, speaker ORDER BY count(*) DESC, tok) AS r FROM {toks} k WHERE tok NOT IN ({stop}) GROUP BY manuscript_id, speaker, tok) q WHERE r <= 5"""


@plan("J8")
def voice_collision(d):
    return f"SELECT manuscript_id, pair FROM {collisions(d, _voices(d))} c"


@plan("J9 U3 U4 W13")
def voice_drift(d):
    """Pairs that collide in the last third and did not in the first, and speakers too thin to tell."""
    return f"SELECT manuscript_id, kind, who FROM {drift(d, _voices(d))} x"


@plan("A11")
def dialogue_ratio(d):
    inside = f"coalesce({d.size(d.tokens(d.join(d.all_of('raw', QUOTED, 1), ' ')))}, 0)"
    return f"SELECT manuscript_id, round(CAST(sum({inside}) AS DOUBLE) / sum({d.size(d.tokens('raw'))}), 6) AS ratio FROM {chapters(d)} c GROUP BY manuscript_id"


@plan("A13 A14 X34")
def dialogue_tags(d):
    """Tag verbs right behind a closing quote and between a word and an opening one, their share, and the share of said and asked."""
    after = d.all_of("raw", r"(?i)[\"”]\s*,?\s*(" + "|".join(lx.TAG_VERBS) + r")\b", 1)
    before = d.all_of("raw", r"(?i)\b[\p{L}\p{N}_]+\s+(" + "|".join(lx.TAG_VERBS) + r")[,:]?\s*[\"“]", 1)
    a = d.spread(f"(SELECT manuscript_id, {after} AS vs FROM {chapters(d)} c) t", "manuscript_id", "vs", "pos", "verb")
    b = d.spread(f"(SELECT manuscript_id, {before} AS vs FROM {chapters(d)} c) t", "manuscript_id", "vs", "pos", "verb")
    return f"""SELECT manuscript_id, verb, n, round(n / total, 6) AS share, round(plain / nullif(total, 0), 6) AS plain_share, n > 0.4 * total AS single FROM
        (SELECT manuscript_id, verb, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY manuscript_id) AS DOUBLE) AS total, CAST(sum(CASE WHEN verb IN ('said', 'asked') THEN count(*) ELSE 0 END) OVER (PARTITION BY manuscript_id) AS DOUBLE) AS plain
        FROM (SELECT manuscript_id, lower(verb) AS verb FROM {a} x UNION ALL SELECT manuscript_id, lower(verb) FROM {b} y) u GROUP BY manuscript_id, verb) v"""


@plan("X34")
def beats_and_tags(d):
    """Lines with a tag against lines with an action beat beside them: a paragraph's prose beside its lines without a tag verb."""
    paras = d.spread(f"(SELECT manuscript_id, {d.paragraphs(d.strip_comments('raw'))} AS ps FROM {chapters(d)} c) p", "manuscript_id", "ps", "para", "ptext")
    prose = d.sub("ptext", LINE, " ")
    tagged, spoken = d.has(prose, rf"\b{_VERB}\b"), d.has("ptext", LINE)
    return f"""SELECT manuscript_id, tags, beats, round(CAST(beats AS DOUBLE) / nullif(tags + beats, 0), 6) AS beat_share FROM (SELECT manuscript_id, count(CASE WHEN {tagged} THEN 1 END) AS tags, count(CASE WHEN NOT {tagged} AND {d.size(d.tokens(prose))} > 0 THEN 1 END) AS beats
        FROM {paras} q WHERE {spoken} GROUP BY manuscript_id) t"""


@plan("J4")
def forbidden_words(d):
    """Words that a speaker of the lexicon never says, in their lines; speakers match without case, words whole."""
    toks = d.spread(f"(SELECT manuscript_id, chapter, speaker, line, {d.tokens('line')} AS ws FROM {dialogue(d)} s) t", "manuscript_id, chapter, speaker, line", "ws", "pos", "tok")
    return f"SELECT k.manuscript_id, k.chapter, k.speaker, x.never_say, count(*) AS hits FROM {toks} k JOIN {d.table('lexicon', fx.LEXICON, 'who, never_say')} x ON lower(x.who) = lower(k.speaker) AND x.never_say = k.tok GROUP BY k.manuscript_id, k.chapter, k.speaker, x.never_say"


def _records(d: Dialect, rows: list, kind: str) -> str:
    return f"(SELECT * FROM {d.table(f'{kind}s', rows, 'lineno, line')} r WHERE line NOT LIKE '#%' AND {d.trim('line')} <> '' AND line LIKE {d.lit(kind + ' %')})"


def texture(d: Dialect) -> str:
    return f"(SELECT lineno, {d.field('line', 'id')} AS id, {d.field('line', 'term')} AS term, {d.field('line', 'kind')} AS kind, {d.field('line', 'src')} AS src FROM {_records(d, fx.TEXTURE, 'texture')} q)"


@plan("S6 S7 W12 FL9")
def bank_records(d):
    """Records of the texture and motif banks; a later line with a known id is an error that names the first."""
    motifs = f"(SELECT lineno, {d.field('line', 'id')} AS id, {d.field('line', 'term')} AS term FROM {_records(d, fx.MOTIFS, 'motif')} q)"
    return f"""SELECT 'texture' AS bank, lineno, id, term, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY lineno) > 1 THEN first_value(lineno) OVER (PARTITION BY id ORDER BY lineno) END AS repeats_line FROM {texture(d)} t
        UNION ALL SELECT 'motif', lineno, id, term, NULL FROM {motifs} m"""


@plan("J2 A21 S6")
def texture_findings(d):
    kinds = ", ".join(d.lit(k) for k in lx.TEXTURE_KINDS)
    return f"""SELECT id, CASE WHEN src IS NULL THEN 'missing_src' WHEN kind NOT IN ({kinds}) THEN 'unknown_kind' ELSE 'ok' END AS finding FROM {texture(d)} t"""


@plan("J1 S8 S3")
def ledger_meta(d):
    """Chapters with the meta record of their report; a chapter without one is missing, never an error."""
    reports = f"(SELECT manuscript_id, chapter_no, {d.field('line', 'structure')} AS structure, {d.field('line', 'hook')} AS hook FROM {d.table('reports', fx.REPORTS, 'manuscript_id, chapter_no, line')} q)"
    number = d.number(d.first("c.chapter", r"^chapter-([0-9]+)\.md$", 1), "BIGINT")
    return f"SELECT c.manuscript_id, c.chapter, r.structure, r.hook, r.chapter_no IS NULL AS missing FROM {chapters(d)} c LEFT JOIN {reports} r ON r.manuscript_id = c.manuscript_id AND r.chapter_no = {number} WHERE {d.has('c.chapter', '^chapter-[0-9]+[.]md$')}"


@plan("W7 A31 W14")
def structure_variety(d):
    """Chapters with a meta record whose structure is the one before; the share of each structure."""
    reports = f"(SELECT manuscript_id, chapter_no, {d.field('line', 'structure')} AS structure FROM {d.table('reports', fx.REPORTS, 'manuscript_id, chapter_no, line')} q)"
    return f"""SELECT manuscript_id, chapter_no, structure, coalesce(structure = before, false) AS repeats, round(same / n, 6) AS share, latest FROM (SELECT manuscript_id, chapter_no, structure, lag(structure) OVER (PARTITION BY manuscript_id ORDER BY chapter_no) AS before,
        CAST(count(*) OVER (PARTITION BY manuscript_id, structure) AS DOUBLE) AS same, count(*) OVER (PARTITION BY manuscript_id) AS n, last_value(structure) OVER (PARTITION BY manuscript_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM {reports} r) t"""


def similes(d: Dialect) -> str:
    return d.spread(f"(SELECT manuscript_id, chapter, {d.all_of('lower(' + d.strip_markdown('raw') + ')', lx.SIMILE)} AS ss FROM {chapters(d)} c) t", "manuscript_id, chapter", "ss", "pos", "simile")


@plan("P16 A22")
def opening_words(d):
    word = f"lower({d.at(d.lint_tokens(d.strip_markdown('raw')), '1')})"
    return f"SELECT manuscript_id, word, count(*) AS n, {d.join(d.sorted_set('chapter'), ',')} AS used_in FROM (SELECT manuscript_id, chapter, {word} AS word FROM {chapters(d)} c) t GROUP BY manuscript_id, word"


@plan("X30")
def voice_differentiation(d):
    """Speakers that differ in three measures at least, of words a line, questions, contractions and qualifiers, and so share one at most."""
    s = signatures(d)
    differ = " + ".join(f"CASE WHEN abs(a.{m} - b.{m}) >= {gap} THEN 1 ELSE 0 END" for m, gap in (("per_line", LINE_GAP), ("questions", QUESTION_GAP), ("contractions", CONTRACTION_GAP), ("qualifiers", CONTRACTION_GAP)))
    return f"SELECT a.manuscript_id, a.speaker AS one, b.speaker AS other, {differ} >= 3 AS apart, 4 - ({differ}) <= 1 AS share_one FROM {s} a JOIN {s} b ON a.manuscript_id = b.manuscript_id AND a.speaker < b.speaker AND a.speaker <> '?'"
