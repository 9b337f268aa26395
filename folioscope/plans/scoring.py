"""Plans of scores and continuity rules over relations: boards, indices, verdicts, as-of facts, entity history.

Every relation has inline rows for the registered queries; ``operators.relations`` runs the plans over a user's own.
"""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import Dialect
from folioscope.plans import fixtures as fx
from folioscope.plans.registry import chapters, plan


def scores(d: Dialect) -> str:
    return d.table("scores", fx.SCORES, "book, iteration, dimension, weight, score")


def _genres(d: Dialect, limits: dict, names: str) -> str:
    """A table of limits by genre, as a relation."""
    return d.values([(g, *(v if isinstance(v, tuple) else (v,))) for g, v in limits.items()], f"genre, {names}")


def _float(limits: dict) -> dict:
    return {g: tuple(float(x) for x in (v if isinstance(v, tuple) else (v,))) for g, v in limits.items()}


@plan("X1 X2 X3 X8")
def score_board(d):
    """Floor, weighted average, approval, divergence from the commercial index, and bottleneck of each board.

    A board without a dossier has no evidence, so it is not approved and tells no divergence.
    """
    dossiers = d.table("dossiers", fx.DOSSIERS, "book, iteration, evidenced, audit, viability")
    return f"""SELECT t.book, t.iteration, lowest, average, coalesce(lowest >= {lx.BOARD_FLOOR} AND average >= {lx.BOARD_AVERAGE} AND lowest >= {lx.BOARD_LEAST} AND evidenced >= n AND audit <> 'MAJOR REWRITE', false) AS approved,
        abs(viability - lowest) >= {lx.DIVERGENCE} AS diverges, average - lowest > {lx.BOTTLENECK} AS bottleneck FROM
        (SELECT book, iteration, count(*) AS n, min(score) AS lowest, round(sum(weight * score) / sum(weight), 6) AS average FROM {scores(d)} s GROUP BY book, iteration) t LEFT JOIN {dossiers} o ON o.book = t.book AND o.iteration = t.iteration"""


def _deltas(d: Dialect) -> str:
    return f"""(SELECT book, iteration, dimension, score, before, score - before AS delta, lag(score - before) OVER (PARTITION BY book, dimension ORDER BY iteration) AS delta_before FROM
        (SELECT *, lag(score) OVER (PARTITION BY book, dimension ORDER BY iteration) AS before FROM {scores(d)} s) t)"""


@plan("X9 X10")
def score_trend(d):
    """Each dimension against the cycle before: state, gain capped at half a point, and a change of direction."""
    return f"""SELECT book, iteration, dimension, CASE WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'regressed' WHEN delta = 0 THEN 'stable' END AS state,
        CASE WHEN before IS NULL THEN score ELSE least(before + 0.5, score) END AS capped, coalesce(sign(delta) * sign(delta_before) < 0, false) AS oscillates FROM {_deltas(d)} t"""


@plan("X10 X14")
def score_cycle(d):
    """Cycles with two regressions or more escalate; a single dimension half a point under the floor is a near miss."""
    return f"""SELECT book, iteration, count(CASE WHEN delta < 0 THEN 1 END) AS regressions, count(CASE WHEN delta < -0.5 THEN 1 END) AS concerns, count(CASE WHEN delta < 0 THEN 1 END) >= 2 AS escalate,
        count(CASE WHEN score < {lx.BOARD_FLOOR} THEN 1 END) = 1 AND min(score) >= {lx.BOARD_FLOOR - 0.5} AS near_miss FROM {_deltas(d)} t GROUP BY book, iteration"""


VIABILITY = "book, pacing, anchors, casual, quote, plot, emotional, pitch, closeness, anchor"


@plan("X4 X5 X7")
def launch_index(d):
    """Launch index from its six inputs, each on a scale of ten, with its band; a chapter's anchor adds or takes half a point."""
    v = d.table("viability", fx.VIABILITY, VIABILITY)
    told = lambda x: f"CASE {x} WHEN 'yes' THEN 10.0 WHEN 'partial' THEN 5.0 ELSE 0.0 END"
    return f"""SELECT book, shareability, launch, CASE WHEN launch >= 9 THEN 'breakout' WHEN launch >= 8 THEN 'strong' WHEN launch >= 7 THEN 'viable' ELSE 'risk' END AS band FROM (SELECT book, round(share, 6) AS shareability,
        round(0.2 * pacing + 0.2 * memorable + 0.2 * casual + 0.2 * share + 0.1 * ({told('pitch')}) + 0.1 * ({told('closeness')}) + CASE anchor WHEN 'strong' THEN 0.5 WHEN 'none' THEN -0.5 ELSE 0.0 END, 6) AS launch
        FROM (SELECT *, CASE WHEN anchors <= 0 THEN 0.0 WHEN anchors = 1 THEN 4.0 WHEN anchors = 2 THEN 7.0 WHEN anchors = 3 THEN 9.0 ELSE 10.0 END AS memorable,
        0.6 * greatest(2 * quote, 2 * plot, 2 * emotional) + 0.4 * (2 * quote + 2 * plot + 2 * emotional) / 3 AS share FROM {v} v) t) u"""


@plan("X6 X7")
def legacy_index(d):
    """Legacy index by the weights of the book's engagement, with its band."""
    parts = d.table("legacies", fx.LEGACIES, "book, engagement, originality, theme, vocabulary, rereading, identity, framework")
    weights = d.values([(e, *w) for e, w in lx.LEGACY_WEIGHTS.items()], "engagement, w1, w2, w3, w4, w5, w6")
    return f"""SELECT book, legacy, CASE WHEN legacy >= 9 THEN 'permanent' WHEN legacy >= 8 THEN 'strong' WHEN legacy >= 7 THEN 'in print' ELSE 'one read' END AS band FROM
        (SELECT p.book, round(w1 * originality + w2 * theme + w3 * vocabulary + w4 * rereading + w5 * identity + w6 * framework, 6) AS legacy FROM {parts} p JOIN {weights} w ON w.engagement = p.engagement) t"""


@plan("X28")
def swarm_readiness(d):
    """A panel's raw score less 0.8, and readiness no more than 0.4 over the weakest gate."""
    panels, gates = d.table("panels", fx.PANELS, "book, raw"), d.table("gates", fx.GATES, "book, gate, score")
    return f"SELECT p.book, round(p.raw - 0.8, 6) AS calibrated, round(least(p.raw - 0.8, min(g.score) + 0.4), 6) AS readiness FROM {panels} p LEFT JOIN {gates} g ON g.book = p.book GROUP BY p.book, p.raw"


def _flags(d: Dialect) -> str:
    return d.table("flags", fx.FLAGS, "issue, chapter, reader")


@plan("X11 X15")
def issue_spread(d):
    """Issues by the chapters and by the core readers that they touch; the casual reader alone makes one important."""
    core = "CASE WHEN reader IN ('devourer', 'critic', 'hostile', 'casual') THEN reader END"
    return f"""SELECT issue, CASE WHEN count(DISTINCT chapter) >= 3 THEN 'SYSTEMIC' WHEN count(DISTINCT chapter) = 2 THEN 'WATCH' ELSE 'LOCAL' END AS spread,
        CASE count(DISTINCT {core}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'IMPORTANT' WHEN 2 THEN 'SHOULD FIX' WHEN 1 THEN CASE WHEN max({core}) = 'casual' THEN 'IMPORTANT' ELSE 'INVESTIGATE' END ELSE 'NOTED' END AS severity FROM {_flags(d)} i GROUP BY issue"""


@plan("X12")
def chapter_verdicts(d):
    """PASS at the excellence target, POLISH from the genre's hard floor on, FAIL under it; an unknown genre has no verdict."""
    e = d.table("evaluations", fx.EVALUATIONS, "book, chapter, genre, lowest, casual")
    return f"""SELECT e.book, e.chapter, CASE WHEN g.hard IS NULL THEN NULL WHEN e.lowest >= {lx.PASS_FLOOR} AND e.casual >= {lx.PASS_CASUAL} THEN 'PASS' WHEN e.lowest >= g.hard THEN 'POLISH' ELSE 'FAIL' END AS verdict
        FROM {e} e LEFT JOIN {_genres(d, _float(lx.HARD_FLOORS), 'hard')} g ON g.genre = e.genre"""


@plan("X13")
def gate_limits(d):
    """Chapters against their genre's limits for floor, patterns, extensions and em dashes, and the casual reader's word."""
    m = d.table("measures", fx.MEASURES, "book, chapter, genre, lowest, patterns, extensions, dashes, casual")
    failed = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in (("dashes", "m.dashes > g.most_dashes"), ("extensions", "m.extensions > g.most_extensions"), ("floor", "m.lowest < g.least"), ("patterns", "m.patterns > g.most_patterns"), ("reader", "m.casual <> 'keep reading'")))
    return f"""SELECT book, chapter, missed, missed = '' AS passes FROM (SELECT m.book, m.chapter, concat_ws(',', {failed}) AS missed FROM {m} m
        JOIN {_genres(d, lx.GATE_LIMITS, 'least, most_patterns, most_extensions, most_dashes')} g ON g.genre = m.genre) t"""


def _patterns(d: Dialect) -> str:
    return d.table("patterns", fx.PATTERNS, "book, genre, chapter, pattern, instances, words")


@plan("X16")
def pattern_penalty(d):
    """Penalty of a chapter's patterns by their density per 1,000 words; half for those at home in prescriptive books."""
    endemic = ", ".join(map(str, lx.ENDEMIC_PATTERNS))
    return f"""SELECT book, chapter, sum(CASE WHEN per_1k < 0.5 THEN -0.125 WHEN per_1k <= 1.0 THEN -0.25 ELSE -0.5 END * CASE WHEN genre = 'prescriptive' AND pattern IN ({endemic}) THEN 0.5 ELSE 1.0 END) AS penalty
        FROM (SELECT book, genre, chapter, pattern, 1000.0 * instances / words AS per_1k FROM {_patterns(d)} p WHERE instances > 0 AND words > 0) t GROUP BY book, chapter"""


@plan("X17")
def pattern_bands(d):
    """Bands by the number of patterns of a book's scan, and the flag for prose with none where some are at home."""
    scans = d.table("scans", fx.SCANS, "book, genre, patterns, accessible")
    return f"""SELECT s.book, CASE WHEN s.patterns <= g.clean THEN 'clean' WHEN s.patterns <= g.watch THEN 'watch' ELSE 'fingerprint' END AS band, s.patterns = 0 AND s.accessible AND s.genre IN ('commercial', 'prescriptive') AS overcorrected
        FROM {scans} s JOIN {_genres(d, lx.PATTERN_BANDS, 'clean, watch')} g ON g.genre = s.genre"""


@plan("X18 X38")
def prose_caps(d):
    """Chapters whose explanatory extensions pass their genre's number or density have prose capped."""
    m = d.table("proses", fx.PROSES, "book, chapter, genre, extensions, words, prose")
    over = "p.extensions > g.most OR 1000.0 * p.extensions / p.words > g.density"
    return f"SELECT p.book, p.chapter, {over} AS over, CASE WHEN {over} THEN least(p.prose, {lx.PROSE_CAP}) ELSE p.prose END AS capped FROM {m} p JOIN {_genres(d, lx.EXTENSION_CAPS, 'most, density')} g ON g.genre = p.genre WHERE p.words > 0"


@plan("X32")
def supplement_bands(d):
    """A genre pack's own patterns, counted apart: up to one clean, up to three watched, more a failure of fidelity."""
    h = d.table("supplements", fx.SUPPLEMENTS, "book, pattern, instances")
    return f"SELECT book, n, CASE WHEN n <= 1 THEN 'clean' WHEN n <= 3 THEN 'watch' ELSE 'fidelity failure' END AS band FROM (SELECT book, count(DISTINCT CASE WHEN instances > 0 THEN pattern END) AS n FROM {h} h GROUP BY book) t"


@plan("X19 W2")
def tension_map(d):
    """Runs of three equal levels, the climax's place, and turns of mood, six to twelve of which are regular."""
    levels = d.table("tensions", fx.TENSIONS, "book, chapter, level, mood")
    return f"""SELECT book, flat, climax, turns, turns BETWEEN 6 AND 12 AS regular FROM (SELECT book, count(CASE WHEN level = l1 AND level = l2 THEN 1 END) AS flat, {d.best('chapter', 'level * 100000 - chapter')} AS climax, count(CASE WHEN sign(mood) * sign(m1) < 0 THEN 1 END) AS turns FROM
        (SELECT book, chapter, level, mood, lag(level, 1) OVER w AS l1, lag(level, 2) OVER w AS l2, lag(mood, 1) OVER w AS m1 FROM {levels} t WINDOW w AS (PARTITION BY book ORDER BY chapter)) x GROUP BY book) y"""


def _prose(d: Dialect) -> str:
    return d.strip_markdown("raw")


@plan("X20")
def mechanical_scan(d):
    """Formulas of each chapter, forbidden words, and adverbs per 1,000 words against fifteen."""
    formulas = ", ".join(f"{d.count(f'lower({_prose(d)})', p)} AS {k.replace(' ', '_')}" for k, p in lx.FORMULAS.items())
    words = f"{d.tokens(_prose(d))}"
    banned = ", ".join(d.lit(w) for w in lx.FORBIDDEN_WORDS)
    return f"""SELECT manuscript_id, chapter, {', '.join(k.replace(' ', '_') for k in lx.FORMULAS)}, {d.size(d.keep('ws', 'w', f'w IN ({banned})'))} AS forbidden,
        1000.0 * {d.size(d.keep('ws', 'w', "w LIKE '%ly'"))} / greatest({d.size('ws')}, 1) >= 15 AS adverb_heavy FROM (SELECT manuscript_id, chapter, {formulas}, {words} AS ws FROM {chapters(d)} c) t"""


@plan("X20")
def word_outliers(d):
    """Words of five letters or more that stand over three times in 1,000 words of a chapter."""
    toks = d.spread(f"(SELECT manuscript_id, chapter, {d.tokens(_prose(d))} AS ws FROM {chapters(d)} c) t", "manuscript_id, chapter", "ws", "pos", "tok")
    return f"SELECT manuscript_id, chapter, tok, n FROM (SELECT manuscript_id, chapter, tok, n, sum(n) OVER (PARTITION BY manuscript_id, chapter) AS total FROM (SELECT manuscript_id, chapter, tok, count(*) AS n FROM {toks} k GROUP BY manuscript_id, chapter, tok) a) b WHERE n > total / 1000.0 * 3 AND length(tok) > 4"


@plan("X21")
def safe_replacements(d):
    """Chapters after the replacements that need no judgement: words, a dash before a new sentence, doubled blanks."""
    text = d.sub("raw", r"([a-z]+[.!?]?) — ([A-Z])", r"\1. \2")
    for word, other in lx.SAFE_WORDS.items():
        text = d.sub(d.sub(text, rf"\b{word}\b", other), rf"\b{word.capitalize()}\b", other.capitalize())
    return f"SELECT manuscript_id, chapter, {d.sub(text, '  +', ' ')} AS revised FROM {chapters(d)} c"


@plan("X37")
def triplet_share(d):
    """Share of paragraphs with a list of three, and opposed pairs; over a fifth of the paragraphs is a habit."""
    paras = d.spread(f"(SELECT manuscript_id, {d.paragraphs(_prose(d))} AS ps FROM {chapters(d)} c) t", "manuscript_id", "ps", "para", "ptext")
    three, opposed = r"\w+, \w+,? (?:and|or) \w+", r"(?i)\b(?:not|n't) [^.!?]{1,40}[—,;.] (?:but|it was) "
    return f"""SELECT manuscript_id, share, share > 0.2 AS habit, opposed FROM (SELECT manuscript_id, round(avg(CASE WHEN {d.has('ptext', three)} THEN 1.0 ELSE 0.0 END), 6) AS share, CAST(sum({d.count('ptext', opposed)}) AS BIGINT) AS opposed FROM {paras} p GROUP BY manuscript_id) t"""


@plan("X22")
def knowledge_gaps(d):
    """Facts used by a character who learns them later or never: an as-of join on the order of chapters."""
    f = d.table("facts", fx.FACTS, "who, fact, kind, ord")
    return f"SELECT u.who, u.fact, u.ord FROM {f} u LEFT JOIN (SELECT who, fact, min(ord) AS since FROM {f} l WHERE kind = 'learned' GROUP BY who, fact) l ON l.who = u.who AND l.fact = u.fact WHERE u.kind = 'used' AND (l.since IS NULL OR l.since > u.ord)"


@plan("X23")
def entity_merge(d):
    """Known fields against new ones: insert, skip or conflict, never overwritten.

    A conflict of which only one value still stands in the text is resolved to it.
    """
    known, fresh = d.table("known", fx.KNOWN, "entity, field, val"), d.table("fresh", fx.FRESH, "entity, field, val")
    alive = d.table("alive", fx.ALIVE, "entity, field, val")
    stands = lambda t: f"EXISTS (SELECT 1 FROM {alive} a WHERE a.entity = {t}.entity AND a.field = {t}.field AND a.val = {t}.val)"
    old = f"(SELECT k.*, CASE WHEN {stands('k')} THEN 1 ELSE 0 END AS stands FROM {known} k)"
    new = f"(SELECT f.*, CASE WHEN {stands('f')} THEN 1 ELSE 0 END AS stands FROM {fresh} f)"
    return f"""SELECT coalesce(k.entity, f.entity) AS entity, coalesce(k.field, f.field) AS field, CASE WHEN k.val <> f.val AND k.stands = 0 AND f.stands = 1 THEN f.val ELSE coalesce(k.val, f.val) END AS val,
        CASE WHEN k.val IS NULL THEN 'insert' WHEN f.val IS NULL THEN 'keep' WHEN k.val = f.val THEN 'skip' WHEN k.stands + f.stands = 1 THEN 'resolved' ELSE 'conflict' END AS action
        FROM {old} k FULL OUTER JOIN {new} f ON f.entity = k.entity AND f.field = k.field"""


@plan("X44")
def entity_patches(d):
    """Fields after patches: keep_original and remove_conflict leave the value, update sets it, add and create need a new one."""
    known, patches = d.table("known", fx.KNOWN, "entity, field, val"), d.table("patches", fx.PATCHES, "entity, field, action, val")
    return f"""SELECT coalesce(k.entity, p.entity) AS entity, coalesce(k.field, p.field) AS field, CASE WHEN (p.action = 'update' AND k.val IS NOT NULL) OR (p.action IN ('add', 'create') AND k.val IS NULL) THEN p.val ELSE k.val END AS val,
        CASE WHEN p.action IS NULL THEN 'untouched' WHEN p.action IN ('add', 'create') AND k.val IS NOT NULL THEN 'exists' WHEN p.action IN ('keep_original', 'update', 'remove_conflict') AND k.val IS NULL THEN 'missing'
        WHEN p.action IN ('keep_original', 'update', 'remove_conflict', 'add', 'create') THEN 'applied' ELSE 'unknown action' END AS outcome FROM {known} k FULL OUTER JOIN {patches} p ON p.entity = k.entity AND p.field = k.field"""


def _markers(d: Dialect, x: str) -> list[str]:
    return [d.struct({"marker": d.lit(k), "n": d.count(x, p)}) for k, p in lx.MARKERS.items()]


@plan("X24")
def marker_scan(d):
    """Markers of time, technology, place and money per language of the documents, each in one pass over the texts."""
    each = d.spread(f"(SELECT lang, {d.array(_markers(d, 'text'))} AS ms FROM (SELECT lang, {d.bounded('text')} AS text FROM documents WHERE text IS NOT NULL) t0) t", "lang", "ms", "mpos", "m")
    return f"SELECT lang, m.marker AS marker, CAST(sum(m.n) AS BIGINT) AS n, count(CASE WHEN m.n > 0 THEN 1 END) AS docs FROM {each} e GROUP BY lang, m.marker"


@plan("X25")
def teleports(d):
    """Characters whose place changes from one chapter to their next without a journey."""
    moves = d.table("moves", fx.MOVES, "entity, ord, place, travelled")
    return f"SELECT entity, ord, before, place FROM (SELECT entity, ord, place, travelled, lag(place) OVER (PARTITION BY entity ORDER BY ord) AS before FROM {moves} m WHERE place IS NOT NULL) t WHERE before <> place AND NOT coalesce(travelled, false)"


@plan("X40")
def entity_history(d):
    """Validity of each field's values."""
    return f"""SELECT entity, field, val, ord AS since, lead(ord) OVER (PARTITION BY entity, field ORDER BY ord) AS until FROM
        (SELECT *, lag(val) OVER (PARTITION BY entity, field ORDER BY ord) AS before FROM {d.table('entities', fx.ENTITIES, 'entity, field, ord, val')} e) t WHERE before IS NULL OR before <> val"""


@plan("X26")
def open_objects(d):
    """Set-ups told with emphasis that no later chapter pays off: a warning if major, else minor."""
    setups, payoffs = d.table("setups", fx.SETUPS, "thing, ord, major"), d.table("payoffs", fx.PAYOFFS, "thing, ord")
    return f"SELECT s.thing, s.ord, CASE WHEN s.major THEN 'warning' ELSE 'minor' END AS level FROM {setups} s WHERE NOT EXISTS (SELECT 1 FROM {payoffs} p WHERE p.thing = s.thing AND p.ord > s.ord)"


@plan("X41")
def coverage_gaps(d):
    """Entities of the text that the state does not know, by how many chapters hold them, and known ones in untracked chapters."""
    seen, tracked, known = d.table("mentions", fx.MENTIONS, "entity, ord, speaks"), d.table("tracked", fx.TRACKED, "ord"), d.table("known", fx.KNOWN, "entity, field, val")
    return f"""SELECT entity, 'untracked entity' AS gap, CASE WHEN count(DISTINCT ord) >= 2 OR bool_or(speaks) THEN 'warning' ELSE 'minor' END AS level, min(ord) AS ord FROM {seen} m WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.entity = m.entity) GROUP BY entity
        UNION ALL SELECT m.entity, 'stale state', 'warning', min(m.ord) FROM {seen} m WHERE EXISTS (SELECT 1 FROM {known} k WHERE k.entity = m.entity) AND NOT EXISTS (SELECT 1 FROM {tracked} t WHERE t.ord = m.ord) GROUP BY m.entity"""


@plan("X42")
def revision_scope(d):
    """Documents labelled bad with their neighbours in the source; numbers are given to ids only."""
    return """WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents), r AS (SELECT c.source, c.ord FROM c JOIN labels l ON l.doc_id = c.doc_id WHERE l.quality = 0),
        n AS (SELECT source, ord - 1 AS ord FROM r UNION SELECT source, ord FROM r UNION SELECT source, ord + 1 FROM r) SELECT c.source, c.doc_id FROM c JOIN n ON n.source = c.source AND n.ord = c.ord"""


@plan("X42")
def revision_neighbours(d):
    """Revised chapters with the ones beside them."""
    listed, revised = d.table("ordered", fx.ORDERED, "book, ord"), d.table("revised", fx.REVISED, "book, ord")
    return f"SELECT DISTINCT c.book, c.ord FROM {listed} c JOIN (SELECT book, ord - 1 AS ord FROM {revised} a UNION ALL SELECT book, ord FROM {revised} b UNION ALL SELECT book, ord + 1 FROM {revised} e) r ON r.book = c.book AND r.ord = c.ord"


@plan("X29")
def stratified_sample(d):
    """Documents to read of each source: all under 60,000 words; else the first, the last, those labelled bad, and every tenth.

    Numbers are given to ids only; texts are read once, for their words.
    """
    return f"""WITH n AS (SELECT source, doc_id, {d.size(d.lint_tokens('text'))} AS words FROM documents WHERE text IS NOT NULL), w AS (SELECT source, sum(words) AS total FROM n GROUP BY source),
        o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS docs FROM n), b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
        SELECT o.source, o.doc_id, CASE WHEN w.total < 60000 THEN 'all' WHEN o.r = 1 THEN 'first' WHEN o.r = o.docs THEN 'last' WHEN b.doc_id IS NOT NULL THEN 'flagged' ELSE 'stratum' END AS reason
        FROM o JOIN w ON w.source = o.source LEFT JOIN b ON b.doc_id = o.doc_id WHERE w.total < 60000 OR o.r = 1 OR o.r = o.docs OR b.doc_id IS NOT NULL OR o.r % 10 = 0"""


@plan("X31")
def premise_winner(d):
    """The idea with the best floor of six dimensions, and whether it passes."""
    ideas = d.table("ideas", fx.IDEAS, "idea, hook, irony, escalation, question, gap, retelling")
    return f"SELECT {d.best('idea', 'lowest')} AS winner, max(lowest) AS lowest, max(lowest) >= 8.0 AS passes FROM (SELECT idea, least(hook, irony, escalation, question, gap, retelling) AS lowest FROM {ideas} i) t"


def _hooks(d: Dialect) -> str:
    return d.table("hooks", fx.HOOKS, "book, genre, chapter, hook, pull")


@plan("X35")
def hook_targets(d):
    """Chapters under their genre's hook or pull; the first one's hook needs one more."""
    return f"""SELECT h.book, h.chapter, h.hook < g.least_hook + CASE WHEN h.chapter = 1 THEN 1 ELSE 0 END AS weak_hook, h.pull < g.least_pull AS weak_pull FROM {_hooks(d)} h JOIN {_genres(d, lx.HOOK_PULL, 'least_hook, least_pull')} g ON g.genre = h.genre"""


@plan("X35")
def hook_momentum(d):
    """Mean momentum of a book's transitions against its genre's target, with the weak and the strong ones."""
    return f"""SELECT book, round(avg(momentum), 6) AS binge, count(CASE WHEN momentum < 7 THEN 1 END) AS weak, count(CASE WHEN momentum >= 9 THEN 1 END) AS strong, avg(momentum) >= CASE WHEN max(genre) = 'literary' THEN 6.5 ELSE 7.5 END AS passes FROM
        (SELECT book, genre, (pull + lead(hook) OVER (PARTITION BY book ORDER BY chapter)) / 2.0 AS momentum FROM {_hooks(d)} h) t WHERE momentum IS NOT NULL GROUP BY book"""


@plan("X33")
def chapter_lengths(d):
    """Chapters under 85 % of their own target."""
    targets = d.table("targets", fx.TARGETS, "manuscript_id, chapter, target")
    return f"SELECT c.manuscript_id, c.chapter, words, target, words < 0.85 * target AS short FROM (SELECT manuscript_id, chapter, {d.size(d.lint_tokens(_prose(d)))} AS words FROM {chapters(d)} t) c JOIN {targets} g ON g.manuscript_id = c.manuscript_id AND g.chapter = c.chapter"


@plan("X39")
def genre_ranges(d):
    """Books against their genre's words, a reading grade up to 7, under 105 adverbs in 10,000 words, and their turning points."""
    books, turns = d.table("books", fx.BOOKS, "book, genre, words, grade, adverbs"), d.table("turning_points", fx.TURNS, "book, ord, at_word")
    return f"""SELECT b.book, b.words BETWEEN g.least AND g.most AS words_fit, b.grade <= 7 AS grade_fits, 10000.0 * b.adverbs / b.words < 105 AS adverbs_fit, max(abs(100.0 * t.at_word / b.words - 25.0 * t.ord)) <= 5 AS turns_fit
        FROM {books} b JOIN {_genres(d, lx.BOOK_WORDS, 'least, most')} g ON g.genre = b.genre LEFT JOIN {turns} t ON t.book = b.book GROUP BY b.book, b.words, b.grade, b.adverbs, g.least, g.most"""


@plan("X43")
def voice_bank(d):
    """Kinds of samples that a voice bank has too few of."""
    samples = d.table("samples", fx.SAMPLES, "book, kind")
    return f"""SELECT b.book, n.kind, count(s.kind) AS has, n.least AS needs FROM (SELECT DISTINCT book FROM {samples} x) b CROSS JOIN {d.values(list(lx.VOICE_SAMPLES.items()), 'kind, least')} n
        LEFT JOIN {samples} s ON s.book = b.book AND (n.kind = 'any' OR s.kind = n.kind) GROUP BY b.book, n.kind, n.least HAVING count(s.kind) < n.least"""


@plan("")
def label_shares(d):
    """Share of good and toxic labels by source."""
    return "SELECT d.source, count(*) AS n, round(avg(CAST(l.quality AS DOUBLE)), 6) AS good, round(avg(CAST(l.toxic AS DOUBLE)), 6) AS toxic, avg(CAST(l.quality AS DOUBLE)) > 0.5 AS passes FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source"
