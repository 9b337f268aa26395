"""Phrases that are found at run time and counted in texts by equality of their first words."""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import WORD, Dialect
from folioscope.plans import frequent
from folioscope.plans.lint import _documents, repeats, thresholds
from folioscope.plans.ranks import ranked
from folioscope.plans.registry import plan

#: Runs of word characters; a phrase may begin and end only where such a run does.
ATOM = WORD + "+"
#: Words of a phrase by which texts meet it.
HEAD = 3


def thirds(d: Dialect, rel: str) -> str:
    """Chapters of the first and last third of manuscripts with six chapters or more; ids only."""
    k = "CAST(floor(n / 3.0) AS BIGINT)"
    ids = f"(SELECT manuscript_id, chapter, ord FROM {rel} i0)"
    return f"(SELECT manuscript_id AS t_of, chapter AS t_at, CASE WHEN place <= {k} THEN 'early' ELSE 'late' END AS third FROM {ranked(d, ids, 'manuscript_id', 'ord', 'chapter')} r WHERE n >= 6 AND (place <= {k} OR place > n - {k}))"


def _marked(d: Dialect, x: str) -> str:
    """A text with a mark at either end of each word: what is equal in it is equal by whole words."""
    return d.sub(x, f"({ATOM})", "\x01\\1\x02")


def counted(d: Dialect, texts: str, phrases: str) -> str:
    """How often each phrase stands in each text of its manuscript, by whole words, places that do not overlap.

    ``texts`` has manuscript_id, chapter and low (lower case), ``phrases`` manuscript_id and phrase (lower case, three words
    or more).  Texts and phrases meet by the first three words of the phrase, so the phrases may be any number, and
    what meets is counted letter by letter: the words' distances must be those of the phrase, too.
    """
    heads = f"(SELECT manuscript_id, phrase, {_marked(d, 'phrase')} AS marked, {d.join(d.cut(d.all_of('phrase', ATOM), '1', str(HEAD)), ' ')} AS head FROM (SELECT DISTINCT manuscript_id, phrase FROM {phrases} p0) p1)"
    if d.spark:
        # most beginnings lead to no phrase: they are dropped where the text is read, as rows, which Spark compiles
        begun = f"(SELECT manuscript_id, chapter, {d.all_of('low', ATOM)} AS atoms FROM {texts} t0)"
        rows = d.spread(frequent.beside(begun, frequent.key_bits(d, heads, "manuscript_id, head")), "manuscript_id, chapter, bits, atoms", "atoms", "gpos", "w")
        after = ", ".join(f"coalesce(get(atoms, CAST(gpos AS INT) + {j}), '')" for j in range(1, HEAD))
        runs = f"(SELECT manuscript_id, chapter, bits, concat_ws(' ', w, {after}) AS head FROM {rows} t3)"
        grams = f"(SELECT DISTINCT manuscript_id, chapter, head FROM {runs} t4 WHERE {frequent.held('xxhash64(manuscript_id, head)')})"
    else:
        grams = d.spread(f"(SELECT manuscript_id, chapter, {d.distinct(d.ngrams('atoms', HEAD))} AS gs FROM (SELECT manuscript_id, chapter, {d.all_of('low', ATOM)} AS atoms FROM {texts} t0) t1)", "manuscript_id, chapter", "gs", "gpos", "head")
    met = f"(SELECT g.manuscript_id AS m_of, g.chapter AS m_at, h.phrase, h.marked FROM {grams} g JOIN {heads} h ON h.manuscript_id = g.manuscript_id AND h.head = g.head)"
    whole = f"(SELECT manuscript_id, chapter, {_marked(d, 'low')} AS body FROM {texts} t2)"
    hits = "CAST((length(w.body) - length(replace(w.body, m.marked, ''))) / length(m.marked) AS BIGINT)"
    return f"(SELECT manuscript_id, chapter, phrase, hits FROM (SELECT w.manuscript_id, w.chapter, m.phrase, {hits} AS hits FROM {met} m JOIN {whole} w ON w.manuscript_id = m.m_of AND w.chapter = m.m_at) c WHERE hits > 0)"


def escalating(d: Dialect, rel: str, found: str, th: dict[str, float]) -> str:
    """Found phrases (manuscript_id, phrase) that come thick in the last third of a manuscript and thin in the first.

    Watched phrases are left out: the lint's own escalation check has them.
    """
    low = f"(SELECT c.manuscript_id, c.chapter, k.third, lower({d.strip_markdown('c.raw')}) AS low FROM {rel} c JOIN {thirds(d, rel)} k ON k.t_of = c.manuscript_id AND k.t_at = c.chapter WHERE c.raw IS NOT NULL)"
    watched = ", ".join(d.lit(w.lower()) for w in lx.WATCH_PHRASES)
    fresh = f"(SELECT manuscript_id, lower(phrase) AS phrase FROM {found} f0 WHERE lower(phrase) NOT IN ({watched}))"
    side = lambda s, x: f"CAST(sum(CASE WHEN third = '{s}' THEN {x} ELSE 0 END) AS BIGINT)"
    words = f"(SELECT manuscript_id AS w_of, {side('early', 'k')} AS early_words, {side('late', 'k')} AS late_words FROM (SELECT manuscript_id, third, {d.size(d.lint_tokens('low'))} AS k FROM {low} l0) l1 GROUP BY manuscript_id)"
    sums = f"(SELECT c.manuscript_id, c.phrase, {side('early', 'c.hits')} AS early_n, {side('late', 'c.hits')} AS late_n FROM {counted(d, low, fresh)} c JOIN {thirds(d, rel)} k ON k.t_of = c.manuscript_id AND k.t_at = c.chapter GROUP BY c.manuscript_id, c.phrase)"
    rate = lambda s: f"({s}_n * 1000.0 / greatest({s}_words, 1.0))"
    early, late = rate("early"), rate("late")
    grown = f"{late} >= {th['escalation_min_last_per_1k']} AND ((early_n > 0 AND {late} / nullif({early}, 0.0) >= {th['escalation_ratio']}) OR (early_n = 0 AND late_n >= 2))"
    return f"(SELECT manuscript_id, phrase, early_n, late_n, {early} AS early_per_1k, {late} AS late_per_1k FROM {sums} s JOIN {words} w ON w.w_of = s.manuscript_id WHERE {grown})"


def escalation_findings(d: Dialect, rel: str, found: str, th: dict[str, float]) -> str:
    """The same in the columns of the lint findings."""
    return f"""SELECT manuscript_id, {d.text('NULL')} AS chapter, 'phrase_escalation' AS check_name, 'warn' AS severity, phrase AS item, late_n AS n, CAST(round(late_per_1k, 6) AS DOUBLE) AS measured, CAST(early_per_1k AS DOUBLE) AS low,
        CAST({th['escalation_ratio']} AS DOUBLE) AS high FROM {escalating(d, rel, found, th)} e"""


@plan("J13 W13 U2 J14")
def discovered_escalation(d):
    """Repeats that the documents of a language hold, found without a list, whose use grows from the first to the last third."""
    th = thresholds() | {"ngram_per_10k": 0.5, "escalation_min_last_per_1k": 0.01}
    found = f"(SELECT manuscript_id, phrase FROM ({repeats(d, _documents(d, 'lang'), th)}) r)"
    return f"SELECT manuscript_id, phrase, early_n, late_n, round(early_per_1k, 6) AS early_per_1k, round(late_per_1k, 6) AS late_per_1k FROM {escalating(d, _documents(d, 'lang'), found, th)} x"


@plan("J13 W13 P1")
def repeat_spread(d):
    """Documents and places that hold each repeat of a language letter by letter, beside the places by words alone."""
    th = thresholds() | {"ngram_per_10k": 0.5}
    spans = f"(SELECT manuscript_id, phrase, n FROM ({repeats(d, _documents(d, 'lang'), th)}) r)"
    low = f"(SELECT manuscript_id, chapter, lower({d.strip_markdown('raw')}) AS low FROM {_documents(d, 'lang')} src)"
    hits = f"(SELECT manuscript_id, phrase, count(*) AS docs, CAST(sum(hits) AS BIGINT) AS places FROM {counted(d, low, spans)} c GROUP BY manuscript_id, phrase)"
    return f"SELECT s.manuscript_id, s.phrase, s.n AS by_words, coalesce(h.docs, 0) AS docs, coalesce(h.places, 0) AS places FROM {spans} s LEFT JOIN {hits} h ON h.manuscript_id = s.manuscript_id AND h.phrase = s.phrase"
