"""Terms inside texts, inside words too, found by equality of pieces: no text meets a term that it shares nothing with."""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import LINT_TOKEN, WORD, Dialect
from folioscope.plans import fixtures as fx
from folioscope.plans.lint import _documents, repeats, thresholds
from folioscope.plans.registry import chapters, plan
from folioscope.plans.voices import _records, similes, texture

#: A run of word characters or of marks lies inside one such run of any text that holds it.
RUN = WORD + r"+|[^\p{L}\p{N}_\s]+"
#: Letters of a term's longest run that are looked for, and of the parts that runs of texts are cut into.
PIECE, PART = 16, 48
GRAM = 3


def _parts(d: Dialect, text: str) -> str:
    """Runs of a text; long ones in parts, each also with the next one behind it, so that a piece lies in one of them."""
    joined = d.map(d.keep(d.ngrams("cs", 2), "g", f"instr(g, ' ') = {PART + 1}"), "g", "replace(g, ' ', '')")
    if d.spark:
        # few texts have a run as long as a part; the others' neighbours need not be joined
        joined = f"CASE WHEN exists({text}, c -> length(c) = {PART}) THEN {joined} ELSE CAST(array() AS ARRAY<STRING>) END"
    return d.distinct(f"{'concat' if d.spark else 'list_concat'}({text}, {joined})")


def containing(d: Dialect, texts: str, ids: str, terms: str) -> str:
    """How often each term (term) stands in each text (the columns ``ids``, and low), both in lower case, places that do not overlap.

    A term is looked for by the first letters of its longest run.  The vocabulary of the texts, which is short beside them,
    meets these by groups of three letters; the few words that hold one lead to texts, and only those are read for the
    term.  Terms without a mark or word character are never found.
    """
    hashed = lambda *x: f"{'xxhash64' if d.spark else 'hash'}({', '.join(x)})"
    # texts and parts travel as hashes: what they lead to is read letter by letter, so a collision costs a look and no more
    cut = f"(SELECT {hashed(ids)} AS tid, {d.all_of('low', f'{WORD}{{1,{PART}}}|[^{WORD[1:-1]}{chr(92)}s]{{1,{PART}}}')} AS cs FROM {texts} t0)"
    held = d.spread(f"(SELECT tid, {_parts(d, 'cs')} AS ps FROM {cut} t1)", "tid", "ps", "at", "chunk")
    runs = d.spread(f"(SELECT DISTINCT term, {d.all_of('term', RUN)} AS rs FROM {terms} k0 WHERE term IS NOT NULL)", "term", "rs", "at", "run")
    keys = f"(SELECT term, left({d.best('run', 'length(run)')}, {PIECE}) AS piece FROM {runs} k1 GROUP BY term)"
    each = d.flatten(d.array([d.map(d.numbers("1", "length(chunk)"), "i", f"substring(chunk, i, {q})") for q in range(1, GRAM + 1)]))
    grams = d.spread(f"(SELECT chunk, {d.distinct(each)} AS gs FROM (SELECT DISTINCT chunk FROM {held} h0) v0)", "chunk", "gs", "at", "gram")
    met = f"(SELECT {hashed('v.chunk')} AS cid, k.term FROM {grams} v JOIN {keys} k ON v.gram = left(k.piece, {GRAM}) WHERE contains(v.chunk, k.piece))"
    led = f"(SELECT DISTINCT h.tid, m.term FROM (SELECT tid, {hashed('chunk')} AS cid FROM {held} h1) h JOIN {met} m ON m.cid = h.cid)"
    names = ", ".join("t." + x.strip() for x in ids.split(","))
    return f"(SELECT {ids}, term, hits FROM (SELECT {names}, l.term, CAST((length(t.low) - length(replace(t.low, l.term, ''))) / length(l.term) AS BIGINT) AS hits FROM {led} l JOIN {texts} t ON l.tid = {hashed(names)}) x WHERE hits > 0)"


def coverage(d: Dialect, terms: str, rel: str) -> str:
    """Chapters that hold each term (id, term), in any case and inside words, and its places; terms of no chapter stay."""
    low = f"(SELECT manuscript_id, chapter, lower(raw) AS low FROM {rel} c0 WHERE raw IS NOT NULL)"
    found = containing(d, low, "manuscript_id, chapter", f"(SELECT lower(term) AS term FROM {terms} z0)")
    sums = f"(SELECT term, count(*) AS chapters, {d.join(d.sorted_set(d.text('manuscript_id')), ',')} AS held_by, CAST(sum(hits) AS BIGINT) AS total FROM {found} f GROUP BY term)"
    return f"(SELECT z.id, z.term, coalesce(s.chapters, 0) AS chapters, coalesce(s.held_by, '') AS held_by, coalesce(s.total, 0) AS total FROM {terms} z LEFT JOIN {sums} s ON s.term = lower(z.term))"


@plan("J2 A21")
def term_coverage(d):
    """Use of a bank of terms, the first three words of each benchmark item, in the documents."""
    first = d.join(d.cut(d.all_of("text", WORD + "+"), "1", "3"), " ")
    bank = f"(SELECT item_id AS id, {first} AS term FROM benchmark WHERE text IS NOT NULL)"
    return f"SELECT id, term, chapters, held_by, total FROM {coverage(d, f'(SELECT * FROM {bank} b WHERE term <> {d.lit(str())})', _documents(d))} x"


#: Thresholds of the ledger of what is used already: looser than the lint's, as it shall prevent the second use.
LEDGER = {"ngram_min_count": 2, "ngram_per_10k": 1.0}


def uses(d: Dialect, rel: str) -> str:
    """Similes, opening word and dialogue tags of each chapter on its own, and a row that it was seen: what adds up over chapters."""
    clean = f"(SELECT manuscript_id, chapter, {d.strip_comments('raw')} AS p FROM {rel} c0 WHERE raw IS NOT NULL)"
    verbs = "|".join(lx.TAG_VERBS)
    item = lambda kind, x: d.struct({"kind": d.lit(kind), "item": x})
    found = [
        d.map(d.all_of(f"lower({d.strip_markdown('p')})", lx.SIMILE), "x", item("simile", "x")),
        d.map(d.all_of("p", r"(?i)[\"”]\s*,?\s*(" + verbs + r")\b", 1), "x", item("tag", "lower(x)")),
        d.map(d.all_of("p", r"(?i)\b[\p{L}\p{N}_]+\s+(" + verbs + r")[,:]?\s*[\"“]", 1), "x", item("tag", "lower(x)")),
        d.array([item("opening", f"lower({d.at(d.lint_tokens(d.strip_markdown('p')), '1')})"), item("seen", d.text("''"))]),
    ]
    each = d.spread(f"(SELECT manuscript_id, chapter, {d.flatten(d.array(found))} AS fs FROM {clean} c1)", "manuscript_id, chapter", "fs", "at", "f")
    return f"(SELECT manuscript_id, chapter, f.kind AS kind, f.item AS item, count(*) AS n FROM {each} e WHERE f.item IS NOT NULL AND NOT (f.kind = 'tag' AND f.item IN ('said', 'asked')) GROUP BY manuscript_id, chapter, f.kind, f.item)"


@plan("J16 A22 P15 P16")
def chapter_uses(d):
    """What each document uses of similes, openings and tags."""
    return f"SELECT manuscript_id, chapter, kind, item, n FROM {uses(d, _documents(d))} x"


def _used_once(d: Dialect, rel: str, motifs: str) -> str:
    """The same for Spark, each part read once: texts for what adds up over chapters, items for the motifs that they hold.

    Items meet terms by the first letters of a term and are read for it where they stand.  Repeats of one phrase that differ
    in their chapters alone stay rows of their own.
    """
    phrases = f"SELECT manuscript_id, 'phrase' AS kind, phrase AS item, n, chs FROM ({repeats(d, rel, thresholds() | LEDGER)}) r"
    verbs = "|".join(lx.TAG_VERBS)
    item = lambda kind, x: d.struct({"kind": d.lit(kind), "item": x})
    spoken = [d.all_of("p", r"(?i)[\"”]\s*,?\s*(" + verbs + r")\b", 1), d.all_of("p", r"(?i)\b[\p{L}\p{N}_]+\s+(" + verbs + r")[,:]?\s*[\"“]", 1)]
    first = f"nullif({d.first('t', LINT_TOKEN)}, '')"
    found = [d.map(d.all_of("lower(t)", lx.SIMILE), "x", item("simile", "x")), *(d.map(v, "x", item("tag", "lower(x)")) for v in spoken), d.array([item("opening", f"lower({first})")])]
    taken = d.let(d.strip_comments("raw"), "p", d.let(d.strip_markdown("p"), "t", f"concat({', '.join(found)})"))
    each = d.spread(f"(SELECT manuscript_id, {taken} AS fs FROM {rel} c0 WHERE raw IS NOT NULL)", "manuscript_id", "fs", "at", "f")
    others = f"SELECT manuscript_id, f.kind AS kind, f.item AS item, count(*) AS n, 0L AS chs FROM {each} e WHERE f.item IS NOT NULL AND NOT (f.kind = 'tag' AND f.item IN ('said', 'asked')) GROUP BY manuscript_id, f.kind, f.item"
    items = f"(SELECT manuscript_id, kind, item, n, chs FROM ({phrases} UNION ALL {others}) u)"
    terms = f"(SELECT DISTINCT lower(term) AS term FROM {motifs} m0 WHERE {d.has('term', RUN)})"
    starts = d.distinct(d.flatten(d.array([d.map(d.numbers("1", "length(item)"), "i", f"substring(lower(item), i, {q})") for q in range(1, GRAM + 1)])))
    begun = d.spread(f"(SELECT *, CASE WHEN kind = 'tag' THEN array('') ELSE array_union(array(''), {starts}) END AS gs FROM {items} i0)", "manuscript_id, kind, item, n, chs", "gs", "at", "gram")
    hit = f"(SELECT /*+ BROADCAST(k) */ b.manuscript_id, b.kind, b.item, b.n, b.chs, coalesce(contains(lower(b.item), k.term), false) AS hit FROM {begun} b LEFT JOIN {terms} k ON b.gram = left(k.term, {GRAM}) WHERE b.gram = '' OR k.term IS NOT NULL)"
    return f"(SELECT manuscript_id, kind, item, n, bool_or(hit) AS exempt FROM {hit} h GROUP BY manuscript_id, kind, item, n, chs)"


def used(d: Dialect, rel: str, motifs: str) -> str:
    """What chapters have used already: phrases, similes, opening words and dialogue tags other than said and asked.

    Phrases, similes and opening words that hold a motif's term (term) are exempt: their return is meant.
    """
    if d.spark:
        return _used_once(d, rel, motifs)
    clean = f"(SELECT manuscript_id, chapter, {d.strip_comments('raw')} AS p FROM {rel} c0 WHERE raw IS NOT NULL)"
    phrases = f"SELECT manuscript_id, 'phrase' AS kind, phrase AS item, n FROM ({repeats(d, rel, thresholds() | LEDGER)}) r"
    vehicles = d.spread(f"(SELECT manuscript_id, {d.all_of('lower(' + d.strip_markdown('p') + ')', lx.SIMILE)} AS ss FROM {clean} c1)", "manuscript_id", "ss", "at", "item")
    similes = f"SELECT manuscript_id, 'simile' AS kind, item, count(*) AS n FROM {vehicles} s GROUP BY manuscript_id, item"
    word = f"lower({d.at(d.lint_tokens(d.strip_markdown('p')), '1')})"
    openings = f"SELECT manuscript_id, 'opening' AS kind, item, count(*) AS n FROM (SELECT manuscript_id, {word} AS item FROM {clean} c2) o WHERE item IS NOT NULL GROUP BY manuscript_id, item"
    verbs = "|".join(lx.TAG_VERBS)
    both = "concat" if d.spark else "list_concat"
    tag = f"{both}({d.all_of('p', r'(?i)[\"”]\s*,?\s*(' + verbs + r')\b', 1)}, {d.all_of('p', r'(?i)\b[\p{L}\p{N}_]+\s+(' + verbs + r')[,:]?\s*[\"“]', 1)})"
    each = d.spread(f"(SELECT manuscript_id, {tag} AS vs FROM {clean} c3)", "manuscript_id", "vs", "at", "verb")
    tags = f"SELECT manuscript_id, 'tag' AS kind, lower(verb) AS item, count(*) AS n FROM {each} v WHERE lower(verb) NOT IN ('said', 'asked') GROUP BY manuscript_id, lower(verb)"
    items = f"(SELECT manuscript_id, kind, item, n FROM ({phrases} UNION ALL {similes} UNION ALL {openings} UNION ALL {tags}) u)"
    texts = f"(SELECT DISTINCT lower(item) AS item_id, lower(item) AS low FROM {items} i0 WHERE kind <> 'tag')"
    exempt = f"(SELECT DISTINCT item_id FROM {containing(d, texts, 'item_id', f'(SELECT lower(term) AS term FROM {motifs} m0)')} e0)"
    return f"(SELECT i.manuscript_id, i.kind, i.item, i.n, e.item_id IS NOT NULL AS exempt FROM {items} i LEFT JOIN {exempt} e ON e.item_id = lower(i.item) AND i.kind <> 'tag')"


@plan("J16 A22 P15 P16")
def used_ledger(d):
    """Ledger of what the documents of each language have used, with the motif bank's exemptions."""
    motifs = f"(SELECT {d.field('line', 'term')} AS term FROM {_records(d, fx.MOTIFS, 'motif')} q)"
    return f"SELECT manuscript_id, kind, item, n, exempt FROM {used(d, _documents(d, 'lang'), motifs)} x"


@plan("J16 A22 P15 P16")
def used_ledger_chapters(d):
    """The same over the chapters of a caller."""
    motifs = f"(SELECT {d.field('line', 'term')} AS term FROM {_records(d, fx.MOTIFS, 'motif')} q)"
    return f"SELECT manuscript_id, kind, item, n, exempt FROM {used(d, d.table('chapters', fx.CHAPTERS, 'manuscript_id, chapter, ord, raw'), motifs)} x"


@plan("J2 A21")
def texture_coverage(d):
    """Chapters that hold each term, in any case and inside words; zero counts kept; of an id's records the first counts."""
    first = f"(SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY lineno) AS r FROM {texture(d)} x) y WHERE r = 1 AND term <> '')"
    low = f"(SELECT concat(manuscript_id, '/', chapter) AS place, lower(raw) AS low FROM {chapters(d)} c)"
    found = containing(d, low, "place", f"(SELECT lower(term) AS term FROM {first} z0)")
    sums = f"(SELECT term, {d.join(d.sorted_set('place'), ',')} AS chapters_used, CAST(sum(hits) AS BIGINT) AS total FROM {found} f GROUP BY term)"
    return f"SELECT z.id, z.term, coalesce(s.chapters_used, '') AS chapters_used, coalesce(s.total, 0) AS total FROM {first} z LEFT JOIN {sums} s ON s.term = lower(z.term)"


@plan("P15 A22 J16 FL5")
def simile_ledger(d):
    """Similes with their chapters, those that hold a motif's term exempt."""
    motifs = f"(SELECT lower({d.field('line', 'term')}) AS term FROM {_records(d, fx.MOTIFS, 'motif')} q)"
    counted = f"(SELECT manuscript_id, simile, count(*) AS n, {d.join(d.sorted_set('chapter'), ',')} AS used_in FROM {similes(d)} s GROUP BY manuscript_id, simile)"
    exempt = f"(SELECT DISTINCT simile FROM {containing(d, f'(SELECT DISTINCT simile, lower(simile) AS low FROM {similes(d)} s1)', 'simile', motifs)} x)"
    return f"SELECT c.manuscript_id, c.simile, c.n, c.used_in, e.simile IS NOT NULL AS exempt FROM {counted} c LEFT JOIN {exempt} e ON e.simile = c.simile"


@plan("J14 U2")
def watch_union(d):
    """Watched phrases and discovered ones, case aside, discovered ones that a watched one holds dropped."""
    watched, found = d.table("watched", fx.WATCHED, "phrase"), d.table("discovered", fx.DISCOVERED, "phrase")
    inside = f"(SELECT DISTINCT term FROM {containing(d, f'(SELECT DISTINCT lower(phrase) AS low, lower(phrase) AS whole FROM {watched} w0)', 'whole', f'(SELECT lower(phrase) AS term FROM {found} f0)')} x)"
    return f"""SELECT phrase, min(origin) AS origin FROM (SELECT lower(phrase) AS phrase, 'watched' AS origin FROM {watched} w UNION ALL
        SELECT lower(f.phrase), 'found' FROM {found} f WHERE NOT EXISTS (SELECT 1 FROM {inside} i WHERE i.term = lower(f.phrase))) u GROUP BY phrase"""
