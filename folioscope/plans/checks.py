"""Plans of checks: chronology, typography, reader evidence, gates, state events, style overrides."""

from __future__ import annotations

from typing import NamedTuple

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import Dialect
from folioscope.plans import fixtures as fx
from folioscope.plans.ranks import ranked
from folioscope.plans.registry import chapters, plan


def _timeline(d: Dialect, kind: str, fields: dict[str, str]) -> str:
    cols = ", ".join(f"{d.field('line', k)} AS {v}" for k, v in fields.items())
    return f"(SELECT lineno, {cols} FROM {d.table('timeline', fx.TIMELINE, 'lineno, line')} r WHERE lower(line) LIKE '{kind} %')"


def events(d: Dialect) -> str:
    return f"(SELECT id, {d.days('raw_day')} AS day FROM {_timeline(d, 'event', {'id': 'id', 'day': 'raw_day'})} e)"


def ages(d: Dialect) -> str:
    return f"(SELECT lineno, person, at_id, {d.number('raw_years', 'DOUBLE')} AS years, src FROM {_timeline(d, 'age', {'person': 'person', 'at': 'at_id', 'years': 'raw_years', 'src': 'src'})} a)"


def spans(d: Dialect) -> str:
    return f"(SELECT lineno, from_id, to_id, {d.days('raw_stated')} AS stated, src FROM {_timeline(d, 'span', {'from': 'from_id', 'to': 'to_id', 'stated': 'raw_stated', 'src': 'src'})} s)"


def onces(d: Dialect) -> str:
    return _timeline(d, "once", {"id": "id", "at": "at_id", "src": "src"})


@plan("S5 FL9")
def timeline_records(d):
    """Kinds of record lines; comments and blanks left out, unknown kinds are errors, not exceptions."""
    kind = f"lower({d.first('line', '^([A-Za-z]+)', 1)})"
    return f"SELECT lineno, CASE WHEN {kind} IN ('event', 'age', 'span', 'once') THEN {kind} ELSE 'error' END AS kind FROM {d.table('timeline', fx.TIMELINE, 'lineno, line')} r WHERE line NOT LIKE '#%' AND {d.trim('line')} <> ''"


@plan("J5")
def timeline_unknown_events(d):
    refs = f"SELECT lineno, at_id AS ref FROM {ages(d)} a UNION ALL SELECT lineno, from_id FROM {spans(d)} s UNION ALL SELECT lineno, to_id FROM {spans(d)} s2 UNION ALL SELECT lineno, at_id FROM {onces(d)} o"
    return f"SELECT lineno, ref FROM ({refs}) r WHERE NOT EXISTS (SELECT 1 FROM {events(d)} e WHERE e.id = r.ref)"


@plan("W8 J7 X27")
def timeline_ages(d):
    """Adjacent age claims of a person whose difference is off the days between by over a year; two years are critical."""
    return f"""SELECT person, src, round(gap, 6) AS gap, CASE WHEN gap >= 2 THEN 'critical' ELSE 'warning' END AS level FROM (SELECT person, src, abs(((lead(years) OVER w) - years) - ((lead(day) OVER w) - day) / 365.25) AS gap
        FROM (SELECT a.person, a.src, a.years, e.day, a.lineno FROM {ages(d)} a JOIN {events(d)} e ON e.id = a.at_id) j WINDOW w AS (PARTITION BY person ORDER BY day, lineno)) t WHERE gap > 1.0"""


@plan("J6")
def timeline_spans(d):
    """Stated intervals against the events' days; half a day of tolerance under 60 days, half a year beyond."""
    return f"""SELECT lineno, from_id, to_id, round(b.day - a.day, 6) AS actual, round(stated, 6) AS stated, CASE WHEN b.day < a.day THEN 'reversed_span' WHEN abs(b.day - a.day - stated) > CASE WHEN abs(stated) < 60 THEN 0.5 ELSE 182.6 END THEN 'span_contradiction' ELSE 'ok' END AS verdict
        FROM {spans(d)} s JOIN {events(d)} a ON a.id = s.from_id JOIN {events(d)} b ON b.id = s.to_id"""


@plan("A30")
def timeline_once(d):
    return f"SELECT id, count(DISTINCT at_id) AS anchors, {d.join(d.sorted_set('at_id'), ',')} AS at_ids FROM {onces(d)} o GROUP BY id HAVING count(DISTINCT at_id) > 1"


def _chapter(d: Dialect, expr: str) -> str:
    return f"SELECT manuscript_id, chapter, {expr} AS n FROM {chapters(d)} c"


@plan("A35 P10")
def house_style(d):
    """Curly or straight quotes, one-character or dotted ellipses, by majority."""
    return f"""SELECT manuscript_id, CASE WHEN curly >= straight THEN 'curly' ELSE 'straight' END AS quotes, CASE WHEN unicode >= ascii THEN 'unicode' ELSE 'ascii' END AS ellipsis FROM
        (SELECT manuscript_id, sum({d.count('raw', '[“”]')}) AS curly, sum({d.count('raw', '"')}) AS straight, sum({d.count('raw', '…')}) AS unicode, sum({d.count('raw', '[.][.][.]')}) AS ascii FROM {chapters(d)} c GROUP BY manuscript_id) t"""


@plan("A36")
def dash_styles(d):
    """Chapters with more than one kind of dash; manuscripts with more than one scene break."""
    kinds = f"CASE WHEN {d.count('raw', '—')} > 0 THEN 1 ELSE 0 END + CASE WHEN {d.count('raw', '[^-]--[^-]')} > 0 THEN 1 ELSE 0 END + CASE WHEN {d.count('raw', ' – ')} > 0 THEN 1 ELSE 0 END"
    stars, rules = d.count("raw", r"(?m)^[*][*][*]$"), d.count("raw", r"(?m)^---$")
    return f"SELECT manuscript_id, chapter, {kinds} > 1 AS mixed_dashes, {stars} AS star_breaks, {rules} AS rule_breaks FROM {chapters(d)} c"


@plan("W15 FL4")
def unbalanced_delimiters(d):
    """Parentheses whose depth does not return to 0, and the lowest depth on the way."""
    chars = d.spread(f"(SELECT manuscript_id, chapter, {d.all_of('raw', '[()]')} AS ps FROM {chapters(d)} c) t", "manuscript_id, chapter", "ps", "pos", "p")
    return f"""SELECT manuscript_id, chapter, max(CASE WHEN r = 1 THEN depth END) AS final_depth, min(depth) AS lowest FROM (SELECT manuscript_id, chapter, CAST(sum(CASE WHEN p = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY manuscript_id, chapter ORDER BY pos) AS BIGINT) AS depth,
        row_number() OVER (PARTITION BY manuscript_id, chapter ORDER BY pos DESC) AS r FROM {chars} x) q GROUP BY manuscript_id, chapter HAVING max(CASE WHEN r = 1 THEN depth END) <> 0"""


@plan("W9")
def unbalanced_quotes(d):
    """Paragraphs with an open quote, unless the next one goes on with a quote."""
    paras = d.spread(f"(SELECT manuscript_id, chapter, {d.paragraphs('raw')} AS ps FROM {chapters(d)} c) t", "manuscript_id, chapter", "ps", "para", "ptext")
    return f"""SELECT manuscript_id, chapter, para FROM (SELECT manuscript_id, chapter, para, ({d.count('ptext', '“')} <> {d.count('ptext', '”')} OR {d.count('ptext', '"')} % 2 = 1) AS open, lead(ptext) OVER (PARTITION BY manuscript_id, chapter ORDER BY para) AS follows FROM {paras} p) q
        WHERE open AND NOT coalesce({d.has('follows', '^["“]')}, false)"""


@plan("W5 P10")
def proof_counts(d):
    """Doubled words by neighbouring tokens, doubled spaces, control characters and broken encodings."""
    toks = d.spread(f"(SELECT manuscript_id, chapter, {d.tokens(d.strip_comments('raw'))} AS ws FROM {chapters(d)} c) t", "manuscript_id, chapter", "ws", "pos", "tok")
    return f"""SELECT c.manuscript_id, c.chapter, coalesce(k.doubled, 0) AS doubled_words, {d.count('c.raw', '[^ .]  +[^ ]')} AS doubled_spaces, {d.count('c.raw', '[' + chr(1) + '-' + chr(8) + ']')} AS controls, {d.count('c.raw', 'Ã|â€|�')} AS mojibake FROM {chapters(d)} c
        LEFT JOIN (SELECT manuscript_id, chapter, count(CASE WHEN tok = before THEN 1 END) AS doubled FROM (SELECT manuscript_id, chapter, tok, lag(tok) OVER (PARTITION BY manuscript_id, chapter ORDER BY pos) AS before FROM {toks} x) y GROUP BY manuscript_id, chapter) k ON k.manuscript_id = c.manuscript_id AND k.chapter = c.chapter"""


@plan("W6 C6 S3")
def chapter_numbering(d):
    """Numbers from file and heading: unequal ones, and gaps after the chapter before."""
    file_no, head_no = d.number(d.first("chapter", "([0-9]+)", 1), "BIGINT"), d.number(d.first("raw", "^# Chapter ([0-9]+)", 1), "BIGINT")
    return f"""SELECT manuscript_id, chapter, file_no, head_no, file_no <> head_no AS mismatch, coalesce(file_no <> lag(file_no) OVER (PARTITION BY manuscript_id ORDER BY file_no) + 1, false) AS gap,
        coalesce(file_no <= lag(file_no) OVER (PARTITION BY manuscript_id ORDER BY ord), false) AS not_rising FROM (SELECT manuscript_id, chapter, ord, {file_no} AS file_no, {head_no} AS head_no FROM {chapters(d)} c) t"""


@plan("W16 W17")
def heading_checks(d):
    """Headings per chapter, top-level ones over one, and headings with nothing up to the next."""
    lines = d.spread(f"(SELECT manuscript_id, chapter, {d.lines('raw')} AS ls FROM {chapters(d)} c) t", "manuscript_id, chapter", "ls", "pos", "ln")
    return f"""SELECT manuscript_id, chapter, count(CASE WHEN ln LIKE '# %' THEN 1 END) AS tops, count(CASE WHEN ln LIKE '#%' THEN 1 END) AS headings, count(CASE WHEN ln LIKE '#%' AND follows LIKE '#%' THEN 1 END) AS empties FROM
        (SELECT manuscript_id, chapter, ln, lead(ln) OVER (PARTITION BY manuscript_id, chapter ORDER BY pos) AS follows FROM {lines} x WHERE {d.trim('ln')} <> '') y GROUP BY manuscript_id, chapter"""


@plan("S13 FL11 W11")
def evidence_rows(d):
    """Reader rows: rejected with a reason, doubled, or kept; invalid rows do not block later ones."""
    good = f"{d.number('chapter', 'BIGINT')} IS NOT NULL AND {d.number('rating', 'BIGINT')} BETWEEN 1 AND 5 AND reader_id <> ''"
    return f"""SELECT row_no, CASE WHEN NOT ok THEN 'rejected' WHEN r > 1 THEN 'duplicate' ELSE 'kept' END AS fate FROM (SELECT row_no, ok, row_number() OVER (PARTITION BY reader_id, chapter, ok ORDER BY row_no) AS r
        FROM (SELECT row_no, reader_id, chapter, coalesce({good}, false) AS ok FROM {d.table('evidence', fx.EVIDENCE, 'row_no, reader_id, chapter, rating, comment, delayed')} e) v) w"""


def evidence(d: Dialect) -> str:
    return f"""(SELECT reader_id, chapter_no, rating_no, delayed IN ('1', 'true', 'yes') AS late FROM (SELECT *, {d.number('chapter', 'BIGINT')} AS chapter_no, {d.number('rating', 'BIGINT')} AS rating_no, row_number() OVER (PARTITION BY reader_id, chapter ORDER BY row_no) AS r
        FROM {d.table('evidence', fx.EVIDENCE, 'row_no, reader_id, chapter, rating, comment, delayed')} e WHERE {d.number('chapter', 'BIGINT')} IS NOT NULL AND {d.number('rating', 'BIGINT')} BETWEEN 1 AND 5 AND reader_id <> '') v WHERE r = 1)"""


@plan("A28 A29")
def evidence_summary(d):
    """Readers, ratings and confidence tier per chapter and overall."""
    return f"""SELECT chapter_no, readers, rating, any_high, any_low, late, CASE WHEN n >= 6 AND spread >= 3 AND any_high AND any_low THEN 'strong' WHEN n >= 3 AND spread >= 2 THEN 'moderate' ELSE 'weak' END AS tier FROM
        (SELECT chapter_no, count(*) AS n, count(DISTINCT chapter_no) AS spread, count(DISTINCT reader_id) AS readers, round(avg(rating_no), 6) AS rating, bool_or(rating_no >= 4) AS any_high, bool_or(rating_no <= 2) AS any_low, count(CASE WHEN late THEN 1 END) AS late
        FROM {evidence(d)} e GROUP BY GROUPING SETS ((), (chapter_no))) t"""


#: A floor in bold at the head of a report, whatever the score's own name before it.
FLOOR_HEADLINE = r"[*][*][A-Za-z ]*Floor:[*][*]\s*([0-9]+(?:[.][0-9]+)?)"


def headlines(d: Dialect) -> str:
    """Floors as the headlines of evaluation reports state them; reports without one have none."""
    reports = d.table("evaluation_reports", fx.EVALUATION_REPORTS, "book, name, raw")
    return f"""(SELECT book, name, {d.number(d.first('raw', FLOOR_HEADLINE, 1), 'DOUBLE')} AS floor_score FROM {reports} r WHERE {d.has('name', '^eval-chapter-[^/]*[.]md$')})"""


@plan("S15")
def evaluation_floors(d):
    """Floors of the evaluation reports by chapter, from their headlines."""
    return f"SELECT book, name, floor_score FROM {headlines(d)} h WHERE floor_score IS NOT NULL"


@plan("A32 S15 FL8")
def headline_range(d):
    """Flat headlines: population CV under 0.02 with six chapters or more; fewer are skipped."""
    return f"""SELECT book, n, CASE WHEN n < 6 THEN 'skip' WHEN cv < 0.02 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT book, count(floor_score) AS n, coalesce(stddev_pop(floor_score) / avg(floor_score), 0) AS cv FROM {headlines(d)} h GROUP BY book) t"""


@plan("A32 FL8")
def dynamic_range(d):
    """Population CV of evaluation floors under 0.02 with six chapters or more."""
    return f"SELECT book, count(*) AS n, round(stddev_pop(floor_score) / avg(floor_score), 6) AS cv, count(*) >= 6 AND stddev_pop(floor_score) / avg(floor_score) < 0.02 AS flat FROM {d.table('floors', fx.FLOORS, 'book, chapter, floor_score')} f GROUP BY book"


@plan("A34 P3")
def protected_spans(d):
    """Protected spans per manuscript against a quarter of its chapters, one at least."""
    return f"SELECT manuscript_id, CAST(sum({d.count('raw', '(?s)<!-- hp:start -->.*?<!-- hp:end -->')}) AS BIGINT) AS n, CAST(greatest(1, ceil(count(*) / 4.0)) AS BIGINT) AS wanted FROM {chapters(d)} c GROUP BY manuscript_id"


def registry(d: Dialect) -> str:
    return d.values([(k, k in lx.ADVISORY_CHECKS) for k in lx.GATE_CHECKS], "name, advisory")


@plan("A37 J18 FL12 U6")
def gate_verdict(d):
    """Gates of phases: each check token (name and arguments, parted by colons) against the registry and the checks' outcomes.

    An unknown name is an error that blocks, whatever the outcome; a check without an outcome is an error, too; a check of
    English prose over another language is skipped; advisory ones never block.  With outputs pending no check counts and the
    gate is shut.
    """
    tokens, outcomes = d.table("gate_tokens", fx.GATE_TOKENS, "gate, token"), d.table("outcomes", fx.OUTCOMES, "gate, name, status")
    pending, langs = d.table("pending", fx.PENDING, "gate, path"), d.table("languages", fx.LANGUAGES, "gate, lang")
    english = ", ".join(d.lit(k) for k in lx.ENGLISH_CHECKS)
    each = f"""(SELECT t.gate, t.name, coalesce(k.advisory, false) AS advisory, CASE WHEN k.name IS NULL THEN 'error' WHEN t.name IN ({english}) AND lower(coalesce(l.lang, 'en')) NOT LIKE 'en%' THEN 'skip' ELSE coalesce(o.status, 'error') END AS status
        FROM (SELECT gate, {d.first('token', '^([^:]*)', 1)} AS name FROM {tokens} x) t LEFT JOIN {registry(d)} k ON k.name = t.name LEFT JOIN {outcomes} o ON o.gate = t.gate AND o.name = t.name LEFT JOIN {langs} l ON l.gate = t.gate)"""
    names = lambda test: f"coalesce({d.join(d.sorted_set(f'CASE WHEN {test} THEN name END'), ',')}, '')"
    bad = "status IN ('fail', 'error')"
    return f"""SELECT e.gate, coalesce(max(p.n), 0) = 0 AND NOT bool_or({bad} AND NOT advisory) AS ok, coalesce(max(p.n), 0) AS pending, CASE WHEN max(p.n) > 0 THEN '' ELSE {names(bad + ' AND NOT advisory')} END AS blocking,
        CASE WHEN max(p.n) > 0 THEN '' ELSE {names(bad + ' AND advisory')} END AS advised FROM {each} e LEFT JOIN (SELECT gate, count(*) AS n FROM {pending} q GROUP BY gate) p ON p.gate = e.gate GROUP BY e.gate"""


class Log(NamedTuple):
    """Relations of an event log: allowed blocks by type, events, what they set, and the phase each project starts in."""

    allowed: str
    events: str
    sets: str
    projects: str


def _log(d: Dialect) -> Log:
    return Log(
        d.table("allowed_blocks", [(t, b, t in lx.APPROVED_EVENTS) for t, blocks in lx.EVENT_BLOCKS.items() for b in blocks], "event_type, block, needs"),
        d.table("state_events", fx.EVENTS, "project, seq, event_type, note, expected_phase, approved"),
        d.table("state_sets", fx.SETS, "project, seq, path, val"),
        d.table("projects", fx.PROJECTS, "project, phase"),
    )


def state(d: Dialect, log: Log) -> str:
    """Events with the code that their own contents give them, the phase they expect and the one they set."""
    types = f"(SELECT event_type, bool_or(needs) AS needs FROM {log.allowed} a GROUP BY event_type)"
    block = d.first("s.path", "^([^.]*)", 1)
    wrong = f"(SELECT s.project, s.seq, min(s.path) AS path FROM {log.sets} s JOIN {log.events} v ON v.project = s.project AND v.seq = s.seq LEFT JOIN {log.allowed} a ON a.event_type = v.event_type AND a.block = {block} WHERE a.block IS NULL GROUP BY s.project, s.seq)"
    code = f"""CASE WHEN {d.trim("coalesce(e.note, '')")} = '' THEN 'schema-validation' WHEN t.event_type IS NULL THEN 'schema-validation' WHEN w.path IS NOT NULL THEN 'allowlist-violation' WHEN t.needs AND NOT coalesce(e.approved, false) THEN 'human-gate-required' ELSE 'ok' END"""
    phases = f"(SELECT project, seq, max(val) AS val FROM {log.sets} p0 WHERE path = 'phase.current' GROUP BY project, seq)"
    return f"""(SELECT e.project, e.seq, {code} AS code, e.expected_phase, p.val AS next_phase FROM {log.events} e LEFT JOIN {types} t ON t.event_type = e.event_type LEFT JOIN {wrong} w ON w.project = e.project AND w.seq = e.seq
        LEFT JOIN {phases} p ON p.project = e.project AND p.seq = e.seq)"""


#: Events that are folded one behind the other; runs of them are folded side by side.
RUN = 256


def walked(d: Dialect, log: Log) -> str:
    """Code of each event and the phase after it: an event that meets another phase than it expects is stale and changes nothing.

    Spark folds a log in runs.  A run's effect depends on the phase before it only through the phases that its events
    expect, so each run is tried with each of those, with none and with any other phase, all runs side by side; the
    phases before the runs follow from these few outcomes, and each run is then read once more.  No task holds more than a run,
    and of a project one entry for each run.
    """
    if not d.spark:
        stale = "n.code = 'ok' AND coalesce(n.expected_phase, '') <> '' AND f.phase <> '' AND n.expected_phase <> f.phase"
        numbered = f"(SELECT project, seq, code, expected_phase, next_phase, CAST(row_number() OVER (PARTITION BY project ORDER BY seq) AS BIGINT) AS r FROM {state(d, log)} s)"
        return f"""(WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {numbered} m), f(project, r, seq, code, phase) AS (SELECT project, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST('' AS VARCHAR), coalesce(phase, '') FROM {log.projects} p
            UNION ALL SELECT n.project, n.r, n.seq, CASE WHEN {stale} THEN 'stale-phase' ELSE n.code END, CASE WHEN n.code = 'ok' AND NOT ({stale}) AND n.next_phase IS NOT NULL THEN n.next_phase ELSE f.phase END FROM f JOIN n ON n.project = f.project AND n.r = f.r + 1)
            SELECT project, seq, code, phase AS phase_after FROM f WHERE r > 0)"""
    other = d.lit("\x01")
    stale = lambda ph: f"(e.code = 'ok' AND coalesce(e.expected_phase, '') <> '' AND {ph} <> '' AND e.expected_phase <> {ph})"
    after = lambda ph: f"CASE WHEN e.code = 'ok' AND e.next_phase IS NOT NULL AND NOT {stale(ph)} THEN e.next_phase ELSE {ph} END"
    placed = ranked(d, state(d, log), "project", "seq", "code")
    runs = f"""(SELECT project, CAST(floor((place - 1) / {RUN}) AS BIGINT) AS run, sort_array(collect_list(named_struct('place', place, 'seq', seq, 'code', code, 'expected_phase', expected_phase, 'next_phase', next_phase))) AS es FROM {placed} x GROUP BY project, CAST(floor((place - 1) / {RUN}) AS BIGINT))"""
    tried = f"(SELECT project, run, array_distinct(concat(transform(filter(es, e -> e.code = 'ok' AND e.expected_phase <> ''), e -> e.expected_phase), array('', {other}))) AS befores, es FROM {runs} r0)"
    outcomes = f"(SELECT project, run, map_from_arrays(befores, transform(befores, b -> aggregate(es, b, (ph, e) -> {after('ph')}))) AS leads FROM {tried} r1)"
    led = f"CASE WHEN map_contains_key(f.leads, acc.ph) THEN f.leads[acc.ph] WHEN f.leads[{other}] = {other} THEN acc.ph ELSE f.leads[{other}] END"
    chain = f"""(SELECT c.project, aggregate(c.fs, named_struct('ph', coalesce(p.phase, ''), 'befores', CAST(array() AS ARRAY<STRING>)), (acc, f) -> named_struct('ph', {led}, 'befores', concat(acc.befores, array(acc.ph)))).befores AS befores
        FROM (SELECT project, transform(array_sort(collect_list(named_struct('run', run, 'leads', leads)), (x, y) -> CAST(sign(x.run - y.run) AS INT)), z -> named_struct('leads', z.leads)) AS fs FROM {outcomes} o GROUP BY project) c JOIN {log.projects} p ON p.project = c.project)"""
    starts = d.spread(f"{chain} ch", "project", "befores", "run", "phase")
    replay = f"""aggregate(r.es, named_struct('ph', s.phase, 'done', CAST(array() AS ARRAY<STRUCT<seq: BIGINT, code: STRING, phase_after: STRING>>)), (acc, e) -> named_struct('ph', {after('acc.ph')}, 'done',
        concat(acc.done, array(named_struct('seq', CAST(e.seq AS BIGINT), 'code', CASE WHEN {stale('acc.ph')} THEN 'stale-phase' ELSE e.code END, 'phase_after', {after('acc.ph')}))))).done"""
    done = d.spread(f"(SELECT r.project, {replay} AS done FROM {runs} r JOIN {starts} s ON s.project = r.project AND s.run = r.run) y", "project", "done", "at", "v")
    return f"(SELECT project, v.seq AS seq, v.code AS code, v.phase_after AS phase_after FROM {done} z)"


def _last_values(d: Dialect, log: Log) -> str:
    return f"""SELECT project, path, {d.first('path', '^([^.]*)', 1)} AS block, {d.best('val', 'seq')} AS val FROM (SELECT s.project, s.seq, s.path, s.val FROM {log.sets} s JOIN {walked(d, log)} e ON e.project = s.project AND e.seq = s.seq WHERE e.code = 'ok') t GROUP BY project, path"""


@plan("FL13 FL14")
def state_codes(d):
    """Code of each event by its own contents: note, type, blocks that it writes, approval; and whether it may be sent again."""
    return f"SELECT project, seq, code, code IN ('schema-validation', 'reference-validation', 'stale-phase') AS retryable FROM {state(d, _log(d))} s"


@plan("FL13 FL14 K6 K14")
def state_events(d):
    """Code of each event of a project: as :func:`state_codes`, then the phase that it expects against the one it meets."""
    return f"SELECT project, seq, code, phase_after FROM {walked(d, _log(d))} w"


@plan("S11 S12 K14 K6")
def state_fold(d):
    """State after all events of a project that were taken: the last value of each dotted path, and its block."""
    return _last_values(d, _log(d))


def _event_log(d: Dialect) -> Log:
    """The events table as a log: each user a project, kinds and values as event types, notes, approvals and phases."""
    of = lambda x, cases, other: f"CASE {x} " + " ".join(f"WHEN {k} THEN {d.lit(v)}" for k, v in cases) + f" ELSE {d.lit(other)} END"
    whole = "CAST(floor(value) AS BIGINT)"
    kind = of("event_type", [("'signup'", "config-update"), ("'view'", "chapter-draft"), ("'click'", "phase-advance"), ("'purchase'", "phase-advance")], "fault")
    expected = of(f"{whole} % 5", [("0", "plan"), ("1", "draft"), ("2", "review")], "")
    user = d.text("user_id")
    events = f"(SELECT {user} AS project, event_id AS seq, {kind} AS event_type, CASE WHEN value < 0.5 THEN ' ' ELSE event_type END AS note, {expected} AS expected_phase, event_type = 'purchase' OR event_id % 2 = 0 AS approved FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)"
    path = "CASE WHEN event_id % 17 = 0 THEN 'secrets.key' WHEN event_type = 'signup' THEN 'runtime.model' WHEN event_type = 'view' THEN 'chapters.completed' ELSE 'phase.current' END"
    value = f"CASE WHEN event_type IN ('signup', 'view') THEN {d.text(whole)} ELSE {of('event_id % 3', [('0', 'plan'), ('1', 'draft')], 'review')} END"
    sets = f"(SELECT {user} AS project, event_id AS seq, {path} AS path, {value} AS val FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL AND event_id IS NOT NULL)"
    return _log(d)._replace(events=events, sets=sets, projects=f"(SELECT DISTINCT {user} AS project, {d.text(chr(39) + 'plan' + chr(39))} AS phase FROM events WHERE user_id IS NOT NULL)")


@plan("FL13 FL14 K6 K14")
def event_log_codes(d):
    """Codes and phases of the events table, read as a log of state events: each user a project."""
    return f"SELECT project, seq, code, phase_after FROM {walked(d, _event_log(d))} w"


@plan("S11 S12 K14 K6")
def event_log_states(d):
    """State of each user's project after the log's events that were taken."""
    return _last_values(d, _event_log(d))


@plan("S11 S12")
def state_lookup(d):
    """Values of a state document by key: a dotted path as it is, a bare key by its first line anywhere."""
    lines, keys = d.table("state_lines", fx.STATE_LINES, "project, path, val, lineno"), d.table("wanted_keys", fx.WANTED_KEYS, "project, key")
    leaf = d.first("l.path", "([^.]*)$", 1)
    return f"""SELECT w.project, w.key, {d.best('l.val', 'l.lineno', most=False)} AS val FROM {keys} w LEFT JOIN {lines} l ON l.project = w.project AND CASE WHEN w.key LIKE '%.%' THEN l.path = w.key ELSE {leaf} = w.key END GROUP BY w.project, w.key"""


def _coerced(d: Dialect) -> str:
    """Overrides with their typed value, null where it does not fit."""
    known = d.values([(k, float(v), isinstance(v, int)) for k, v in lx.THRESHOLDS.items()], "k, v, whole")
    given = d.table("overrides", fx.OVERRIDES, "k, v")
    fits = f"CASE WHEN t.whole THEN CAST({d.number('CASE WHEN ' + d.has('g.v', '^ *[-+]?[0-9]+ *$') + ' THEN g.v END', 'BIGINT')} AS DOUBLE) ELSE {d.number('g.v', 'DOUBLE')} END"
    return f"(SELECT coalesce(t.k, g.k) AS k, t.v AS standard, g.v AS given, CASE WHEN t.k IS NULL THEN 'unknown key' WHEN g.v IS NOT NULL AND {fits} IS NULL THEN 'bad value' END AS warning, {fits} AS fitted FROM {known} t FULL OUTER JOIN {given} g ON g.k = t.k)"


@plan("C1 C2")
def style_overrides(d):
    """All limits with overrides on top, typed; unknown keys and bad values are warnings and change nothing."""
    return f"SELECT k, CASE WHEN warning IS NULL THEN coalesce(fitted, standard) ELSE standard END AS resolved, warning FROM {_coerced(d)} c"


DERIVED = ["em_dash_per_1k", "adverb_per_1k", "filter_word_per_1k", "not_x_but_y_per_10k"]


@plan("C3 FL15")
def derived_overrides(d):
    """Limits from a corpus's own rates, a quarter on top, taken only where they are tighter; looser ones are told."""
    measured = d.table("measured", fx.MEASURED, "profile, k, rate")
    rows = [(name, k, float((lx.THRESHOLDS | lx.PROFILES.get(name, {}))[k])) for name in ("", *lx.PROFILES) for k in DERIVED]
    return f"""SELECT profile, k, round(candidate, 2) AS candidate, round(candidate, 2) < standard AS applies FROM (SELECT m.profile, m.k, 1.25 * m.rate AS candidate, t.v AS standard FROM {measured} m JOIN {d.values(rows, 'profile, k, v')} t ON t.profile = m.profile AND t.k = m.k) x"""


def corpus_vector(d: Dialect, rel: str, by: str) -> str:
    """Words, densities, dialogue, grade and plain tags of the texts (raw) of each ``by``."""
    t = "(" + d.strip_comments("raw") + ")"
    tags = "|".join(lx.TAG_VERBS)
    behind, ahead = r"(?i)[\"”]\s*,?\s*(?:{})\b", r"(?i)\b[\p{{L}}\p{{N}}_]+\s+(?:{})[,:]?\s*[\"“]"
    counted = lambda verbs: f"{d.count('p', behind.format(verbs))} + {d.count('p', ahead.format(verbs))}"
    not_adverb = "(" + ", ".join(d.lit(w) for w in lx.NOT_ADVERBS) + ")"
    filters = r"\b(?:I|[Hh]e|[Ss]he|[Tt]hey|[Ww]e|[A-Z][\p{L}\p{N}_'’-]+)\s+(?:" + "|".join(lx.FILTER_VERBS) + r")\b"
    spoken = d.join(d.all_of("p", r"[“\"]([^”\"]{2,})[”\"]", 1), " ")
    cols = {
        "words": d.size("ws"), "dashes": d.count("p", "—|--"), "adverbs": d.size(d.keep("ws", "w", f"length(w) > 3 AND w LIKE '%ly' AND w NOT IN {not_adverb}")), "filters": f"{d.count('p', filters)} + {d.count('p', lx.FOUND_SELF)}",
        "nxby": d.count("p", lx.NOT_BUT), "spoken": f"coalesce({d.size(d.tokens(spoken))}, 0)", "sents": f"greatest({d.size(d.sentences('p'))}, 1)",
        "syllables": f"CAST({d.total(d.map('ws', 'w', 'CAST(' + d.syllables('w') + ' AS DOUBLE)'))} AS BIGINT)", "tags": counted(tags), "plain": counted("said|asked"),
    }
    per = f"(SELECT {by}, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM (SELECT {by}, p, {d.tokens('p')} AS ws FROM (SELECT {by}, {t} AS p FROM {rel} src WHERE raw IS NOT NULL) a) b)"
    rate = lambda k, n: f"{n} * sum({k}) / sum(words)"
    return f"""(SELECT {by}, CAST(sum(words) AS BIGINT) AS words, {rate('dashes', '1000.0')} AS em_dash_per_1k, {rate('adverbs', '1000.0')} AS adverb_per_1k, {rate('filters', '1000.0')} AS filter_word_per_1k, {rate('nxby', '10000.0')} AS not_x_but_y_per_10k,
        {rate('spoken', '1.0')} AS dialogue_ratio, 0.39 * sum(words) / sum(sents) + 11.8 * sum(syllables) / sum(words) - 15.59 AS fk_grade, 1.0 * sum(plain) / nullif(sum(tags), 0) AS said_tag_share FROM {per} e GROUP BY {by} HAVING sum(words) > 0)"""


@plan("A27 C4 S4")
def corpus_baseline(d):
    """Corpus vector of a language's documents, with its warnings: small samples, dialogue and grade far from the profile's band."""
    v = corpus_vector(d, "(SELECT lang, text AS raw FROM documents WHERE text IS NOT NULL)", "lang")
    th = lx.THRESHOLDS
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("em_dash_per_1k", "adverb_per_1k", "filter_word_per_1k", "not_x_but_y_per_10k", "dialogue_ratio", "fk_grade", "said_tag_share"))
    return f"""SELECT lang, words, {rounded}, words < 1000 AS skipped, words < 5000 AS small, NOT dialogue_ratio BETWEEN {th['dialogue_ratio_min'] - 0.2} AND {th['dialogue_ratio_max'] + 0.2} AS dialogue_off,
        NOT fk_grade BETWEEN {th['fk_grade_min'] - 3.0} AND {th['fk_grade_max'] + 3.0} AS grade_off FROM {v} x"""


@plan("K8 C6")
def manuscript_text(d):
    """Chapters of a manuscript in order, joined."""
    if d.spark:
        return f"SELECT manuscript_id, length(array_join(transform(sort_array(collect_list(struct(ord, raw))), x -> x.raw), '\\n\\n')) AS n_chars, sha2(array_join(transform(sort_array(collect_list(struct(ord, raw))), x -> x.raw), '\\n\\n'), 256) AS digest FROM {chapters(d)} c GROUP BY manuscript_id"
    return f"SELECT manuscript_id, CAST(length(string_agg(raw, chr(10) || chr(10) ORDER BY ord)) AS INTEGER) AS n_chars, sha256(string_agg(raw, chr(10) || chr(10) ORDER BY ord)) AS digest FROM {chapters(d)} c GROUP BY manuscript_id"


@plan("C8 FL10 C5")
def pending_outputs(d):
    """Expected files that are missing, empty or still a template, and fields that a book's metadata must have."""
    expected, listed = d.table("expected_files", fx.EXPECTED, "path"), d.table("listed_files", fx.LISTED, "path, body")
    return f"""SELECT e.path, CASE WHEN l.path IS NULL THEN 'missing' WHEN {d.trim('l.body')} = '' THEN 'empty' ELSE 'template' END AS reason FROM {expected} e LEFT JOIN {listed} l ON l.path = e.path
        WHERE l.path IS NULL OR {d.trim('l.body')} = '' OR l.body LIKE '%*(fill in%' OR l.body LIKE '%TEMPLATE%'"""


@plan("J19 U5")
def archive_links(d):
    """Links of an archive's manifest and spine that lead nowhere: hrefs without a file, idrefs without an item."""
    items, spine, files = d.table("manifest_items", fx.MANIFEST, "book, id, href"), d.table("spine", fx.SPINE, "book, idref"), d.table("archive_files", fx.ARCHIVE, "book, name")
    return f"""SELECT m.book, 'missing file' AS problem, m.href AS name FROM {items} m WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.book = m.book AND f.name = m.href)
        UNION ALL SELECT s.book, 'unknown item', s.idref FROM {spine} s WHERE NOT EXISTS (SELECT 1 FROM {items} m WHERE m.book = s.book AND m.id = s.idref)"""


@plan("C9")
def phase_transition(d):
    """Phase after a passed gate, completed at the end; a failed gate stays, a bypassed one goes on and is told."""
    phases, projects = d.table("phases", fx.PHASES, "phase, next_phase"), d.table("gated_projects", fx.GATED, "project, phase, passed, bypass")
    return f"SELECT p.project, CASE WHEN p.passed OR p.bypass THEN coalesce(f.next_phase, 'completed') ELSE p.phase END AS phase_after, p.bypass AND NOT p.passed AS bypassed FROM {projects} p LEFT JOIN {phases} f ON f.phase = p.phase"


def _slug(d: Dialect, x: str) -> str:
    return d.sub(d.sub(f"lower({x})", "[^a-z0-9]+", "-"), "^-+|-+$", "")


@plan("J20 P18")
def agent_lookup(d):
    """Agents by key, slug or label, the first listed where several fit, and the family of the model they run on."""
    wanted, agents = d.table("wanted_agents", fx.WANTED_AGENTS, "name"), d.table("agents", fx.AGENTS, "lineno, key, label, model")
    names = lambda *parts: " OR ".join(f"contains(lower(m.model), '{x}')" for x in parts)
    slug = _slug(d, "w.name")
    family = f"CASE WHEN m.model IS NULL THEN NULL WHEN {names('claude', 'opus', 'sonnet')} THEN 'claude' WHEN {names('gpt', 'codex')} THEN 'openai' WHEN {names('gemini')} THEN 'google' WHEN {names('kimi')} THEN 'kimi' ELSE 'unknown' END"
    return f"""SELECT m.name, m.key, {family} AS family FROM (SELECT w.name, {d.best('a.key', 'a.lineno', most=False)} AS key, {d.best('a.model', 'a.lineno', most=False)} AS model FROM {wanted} w
        LEFT JOIN {agents} a ON a.key = w.name OR a.key = replace({slug}, '-', '_') OR {_slug(d, 'a.label')} = {slug} GROUP BY w.name) m"""
