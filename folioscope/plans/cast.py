"""The cast that a manuscript's own words tell: where its names stand, and which profile is nearest."""

from __future__ import annotations

from folioscope.functions.dialect import Dialect
from folioscope.plans.lint import _documents, _names
from folioscope.plans.prose import fingerprint_delta
from folioscope.plans.ranks import ranked
from folioscope.plans.registry import plan

#: Profiles from which a nearest one is named at all.
LEAST_REFERENCES = 6


def presence(d: Dialect, rel: str) -> str:
    """Mentions of each name of a manuscript's cast in each of its chapters, in any case, zeros kept: at most fifteen rows a chapter."""
    names, ids = _names(d, rel), f"(SELECT manuscript_id, chapter, ord FROM {rel} i0 WHERE raw IS NOT NULL)"
    low = d.map(d.lint_tokens(d.strip_comments("raw")), "w", "lower(w)")
    words = d.spread(f"(SELECT manuscript_id, chapter, {low} AS ws FROM {rel} w0 WHERE raw IS NOT NULL)", "manuscript_id, chapter", "ws", "pos", "w")
    hits = f"(SELECT t.manuscript_id, t.chapter, t.w, count(*) AS hits FROM {words} t JOIN {names} n ON n.manuscript_id = t.manuscript_id AND n.cast_name = t.w GROUP BY t.manuscript_id, t.chapter, t.w)"
    return f"(SELECT c.manuscript_id, c.chapter, c.ord, n.cast_name, coalesce(h.hits, 0) AS hits FROM {ids} c JOIN {names} n ON n.manuscript_id = c.manuscript_id LEFT JOIN {hits} h ON h.manuscript_id = c.manuscript_id AND h.chapter = c.chapter AND h.w = n.cast_name)"


@plan("J3 W4 P1")
def cast_presence(d):
    """Detected names of each source by its documents."""
    return f"SELECT manuscript_id, chapter, cast_name, hits FROM {presence(d, _documents(d))} x"


@plan("W4 J3")
def cast_absence(d):
    """Names that are away from three documents or more of a source between two that hold them."""
    docs = f"(SELECT manuscript_id, chapter, ord FROM {_documents(d)} d0)"
    placed = f"(SELECT p.manuscript_id, p.cast_name, r.place FROM {presence(d, _documents(d))} p JOIN {ranked(d, docs, 'manuscript_id', 'ord', 'chapter')} r ON r.manuscript_id = p.manuscript_id AND r.chapter = p.chapter WHERE p.hits > 0)"
    return f"SELECT manuscript_id, cast_name, before AS last_seen, place AS seen_again, place - before - 1 AS away FROM (SELECT manuscript_id, cast_name, place, lag(place) OVER (PARTITION BY manuscript_id, cast_name ORDER BY place) AS before FROM {placed} q) g WHERE place - before - 1 >= 3"


@plan("O6 A26")
def fingerprint_winner(d):
    """The nearest reference of each target; none where there are fewer than six references, and no nearness that is not a number."""
    deltas = f"(SELECT target, reference, CASE WHEN isnan(delta) THEN NULL ELSE delta END AS delta FROM ({fingerprint_delta(d)}) f)"
    nearest = f"(SELECT *, min(delta) OVER (PARTITION BY target) AS least, count(*) OVER (PARTITION BY target) AS refs FROM {deltas} n)"
    return f"SELECT target, max(refs) AS refs, CASE WHEN max(refs) >= {LEAST_REFERENCES} THEN min(CASE WHEN delta = least THEN reference END) END AS winner FROM {nearest} w GROUP BY target"
