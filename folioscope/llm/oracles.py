"""DuckDB counterparts of operators, from the contracts; fixed patterns and templates are the operators' own."""

from __future__ import annotations

from . import licenses, quality, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = "coalesce(text, '')"
_LOWERED = f"translate({_TEXT}, '{_UPPER}', '{_LOWER}')"
BLANK = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def numbered(words: str, table: str = "documents", key: str = "doc_id") -> str:
    """Rows of a table with a number of their own and their words."""
    return f"SELECT row_number() OVER () AS rid, {key}, {words} AS w FROM {table}"


OP2 = f"""
WITH d AS MATERIALIZED ({numbered(f"regexp_extract_all({_TEXT}, {BLANK})")}),
places AS (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS p FROM d),
windows AS MATERIALIZED (SELECT rid, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s FROM places),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
starts AS (SELECT rid, p FROM windows WHERE s IN (SELECT s FROM twice)),
gone AS MATERIALIZED (SELECT DISTINCT rid, unnest(generate_series(p, p + 34)) AS q FROM starts),
each AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY q) AS t FROM each ANTI JOIN gone USING (rid, q) GROUP BY rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)
"""

OP9 = f"""
WITH RECURSIVE d AS MATERIALIZED ({numbered(f"regexp_extract_all({_LOWERED}, {BLANK})")}),
s AS MATERIALIZED (
  SELECT DISTINCT rid, array_to_string(list_slice(w, p, p + 1), ' ') AS s
  FROM (SELECT rid, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS p FROM d WHERE len(w) > 0)
),
size AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
sized AS MATERIALIZED (SELECT s.rid, s.s, n FROM s JOIN size USING (rid) JOIN d USING (rid) WHERE doc_id IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b
  FROM sized AS a JOIN sized AS b ON a.s = b.s AND a.rid <> b.rid AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reached AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
low AS (SELECT a AS rid, min(doc_id) AS component_id FROM reached JOIN d ON reached.b = d.rid GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM d LEFT JOIN size USING (rid) LEFT JOIN low USING (rid)
"""

OP10 = f"""
WITH d AS MATERIALIZED ({numbered(f"regexp_extract_all({_LOWERED}, {ALNUM})")}),
i AS MATERIALIZED ({numbered(f"regexp_extract_all({_LOWERED}, {ALNUM})", "benchmark", "item_id")}),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 9), ' ') AS s, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT rid, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size),
said AS (SELECT rid, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS s FROM places),
hits AS MATERIALIZED (SELECT rid, p, size, s FROM said WHERE (s, size) IN (SELECT s, size FROM windows)),
covered AS (SELECT DISTINCT rid, unnest(generate_series(p, p + size - 1)) AS q FROM hits),
n_hit AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
names AS (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits JOIN windows USING (s, size) WHERE item_id IS NOT NULL),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM names GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN named USING (rid)
"""


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ",\n".join(f"({t}, '{label}', {str(base).lower()}, {k}, {_listed(w)})" for t, label, base, k, w in licenses.template_words())

OP1 = f"""
WITH d AS MATERIALIZED ({numbered(f"regexp_extract_all({_LOWERED}, {ALNUM})")}),
t(template, label, base, k, tw) AS (VALUES {_TEMPLATES}),
cut AS (SELECT template, label, base, k, tw, unnest(generate_series(1, len(tw) - k + 1)) AS p FROM t),
grams AS MATERIALIZED (SELECT template, label, base, k, len(tw) AS length, p - 1 AS place, array_to_string(list_slice(tw, p, p + k - 1), ' ') AS gram FROM cut),
kinds AS (SELECT DISTINCT k FROM t),
places AS (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, kinds WHERE len(w) >= k),
said AS (SELECT rid, k, p - 1 AS pos, array_to_string(list_slice(w, p, p + k - 1), ' ') AS gram FROM places),
votes AS MATERIALIZED (SELECT rid, template, label, base, length, k, place, pos - place AS diagonal FROM said JOIN grams USING (k, gram)),
diagonals AS (SELECT rid, template, base, diagonal FROM votes GROUP BY ALL),
opened AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal), 99) > 3 THEN 1 ELSE 0 END AS o FROM diagonals),
runs AS (SELECT rid, template, diagonal, sum(o) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM opened),
voted AS MATERIALIZED (SELECT * FROM votes JOIN runs USING (rid, template, diagonal)),
words AS (SELECT DISTINCT rid, template, run, unnest(generate_series(place, place + k - 1)) AS tword FROM voted),
covered AS (SELECT rid, template, run, count(*) AS n FROM words GROUP BY ALL),
spans AS (
  SELECT rid, template, run, label, base, length, min(diagonal) AS diagonal, max(diagonal + place + k) - min(diagonal + place) AS size
  FROM voted GROUP BY ALL
),
good AS (SELECT *, CAST(n AS DOUBLE) / length AS held FROM spans JOIN covered USING (rid, template, run) WHERE CASE WHEN base THEN n = length ELSE CAST(n AS DOUBLE) / length >= 0.8 AND size <= 1.5 * length END),
told AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(held) AS score, count(*) AS n_spans
  FROM good GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN told USING (rid)
"""

_PLAIN = """'{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, '')) || '}'"""
_ARGUMENTS = """CASE WHEN text IS NULL THEN '{}' ELSE '{"query":' || to_json(text) || '}' END"""
_CALL = f"""'{{"content":"","role":"assistant","tool_calls":[{{"arguments":' || {_ARGUMENTS} || ',"id":"turn-' || turn || '","name":"search"}}]}}'"""
_ANSWER = """'{"content":' || coalesce(to_json(text), 'null') || ',"role":"tool","tool_call_id":"turn-' || (turn - 1) || '"}'"""

OP5 = f"""
WITH calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
answers AS (SELECT a.conv_id, a.turn, a.text, c.turn IS NOT NULL AS linked FROM conversations AS a LEFT JOIN calls AS c ON a.conv_id = c.conv_id AND a.turn - 1 = c.turn WHERE role = 'assistant'),
shown AS (
  SELECT conv_id, 2 * turn AS place, 0 AS after, {_PLAIN} AS m, 'plain' AS kind, false AS wrong FROM conversations
  UNION ALL SELECT conv_id, 2 * turn + 1, 0, {_CALL}, 'call', text IS NULL FROM calls
  UNION ALL SELECT conv_id, CASE WHEN linked THEN 2 * turn - 1 ELSE 1000000000 - turn END, CASE WHEN linked THEN 1 ELSE 0 END, {_ANSWER}, CASE WHEN linked THEN 'linked' ELSE 'orphan' END, false FROM answers
)
SELECT conv_id, count(*) AS n_messages, count(*) FILTER (kind = 'call') AS n_calls, count(*) FILTER (wrong) AS n_invalid, count(*) FILTER (kind = 'linked') AS n_linked,
  count(*) FILTER (kind = 'orphan') AS n_orphans, count(*) FILTER (kind = 'call') - count(*) FILTER (kind = 'linked') AS n_open, '[' || string_agg(m, ',' ORDER BY place, after, m) || ']' AS chat
FROM shown GROUP BY conv_id
"""

_QUOTED = lambda pattern: "'" + pattern.replace("'", "''") + "'"

OP4 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, {BLANK}) AS w FROM documents),
cut AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
lines AS MATERIALIZED (SELECT rid, i, line, regexp_extract_all(line, {BLANK}) AS lw FROM cut),
counted AS (
  SELECT rid, i, line, len(lw) AS n, len(list_distinct(lw)) AS n_distinct, len(regexp_extract_all(line, {_QUOTED(quality.SEPARATOR)})) AS apart,
    len(regexp_extract_all(line, {_QUOTED(quality.SYMBOLS)})) AS marks, len(regexp_extract_all(line, '[!?]')) AS shouts
  FROM lines WHERE len(lw) > 0
),
judged AS MATERIALIZED (
  SELECT rid, i, line, n, (apart >= 3 AND 6 * apart >= n) OR (marks >= 3 AND 4 * marks > n) OR (n >= 4 AND 3 * shouts > n)
    OR (n >= 20 AND NOT regexp_matches(line, {_QUOTED(quality.SENTENCE_MARK)})) OR (n >= 4 AND regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}'))
    OR (n >= 20 AND 3 * n_distinct < n) OR (n <= 20 AND regexp_matches(line, {_QUOTED(quality.BOILERPLATE)})) AS bad
  FROM counted
),
by_line AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(n) FILTER (bad), 0) AS n_lost_words FROM judged GROUP BY rid),
places AS (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d),
three AS MATERIALIZED (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM places),
again AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS times FROM three),
hit AS (SELECT DISTINCT rid, unnest([p, p + 1, p + 2]) AS q FROM again WHERE times > 1),
repeated AS (SELECT rid, count(*) AS n_repeat_words FROM hit GROUP BY rid),
told AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, {_QUOTED(quality.SYMBOLS)})) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN by_line USING (rid) LEFT JOIN repeated USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept
FROM told
"""


def _found(kind: str, rank: int, pattern: str, group: int, fits: str, weak: bool) -> str:
    """Spans of one kind; the place of a match is the length of what stands before it."""
    p = _QUOTED(pattern)
    start = "past - length(v)" if weak else "past - length(hit)"
    return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, {start} AS first, past, {str(weak).lower()} AS weak FROM (
      SELECT rid, hit, v, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS past
      FROM (SELECT rid, unnest(hits) AS hit, unnest(vs) AS v, unnest(list_slice(gaps, 1, len(hits))) AS gap, generate_subscripts(hits, 1) AS i
            FROM (SELECT rid, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})))
    ) WHERE {fits}"""


_KINDS = [_found(k, i, p, g, f"length(v) >= {n}", False) for i, (k, (p, g, n)) in enumerate(secrets.BASE.items())]
_KINDS += [
    _found(k, 3 + i, p, g, " AND ".join([f"length(v) BETWEEN {low} AND {high}", *(f"regexp_matches(v, '{x}')" for x in holds)]), True)
    for i, (k, (p, g, low, high, holds)) in enumerate(secrets.WEAK.items())
]
_ROLES = "CASE WHEN kind IN ('access', 'weak_id') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END"

OP8 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TEXT} AS t FROM documents),
parts AS MATERIALIZED (SELECT *, {_ROLES} AS role FROM ({" UNION ALL ".join(_KINDS)})),
linked AS (
  SELECT a.rid, a.first, a.rank FROM parts AS a JOIN parts AS b ON a.rid = b.rid AND a.role <> b.role AND abs(a.first - b.first) <= {secrets.SCOPE}
  WHERE a.weak GROUP BY a.rid, a.first, a.rank HAVING count(DISTINCT b.role) >= 2 OR bool_or(NOT b.weak)
),
told AS (SELECT *, kind || ':' || first || ':' || past AS shown FROM parts WHERE NOT weak OR (rid, first, rank) IN (SELECT rid, first, rank FROM linked)),
summed AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (weak) AS n_linked,
    string_agg(shown, ',' ORDER BY first, rank) FILTER (NOT weak) AS base, string_agg(shown, ',' ORDER BY first, rank) AS spans
  FROM told GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN summed USING (rid)
"""


def _op12(clusters: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Lloyd's rounds as one common table each."""
    parts = [
        f"base AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: TRY_CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT *, sha256('2:' || vec_id) AS h FROM base) ORDER BY h, v LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, vec_id, v, near.cluster AS cluster, near.distance AS distance FROM (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'distance': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'cluster': cluster}}) AS near FROM base, c{i} GROUP BY rid))")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM (SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range({width})) AS place, unnest(v) AS x FROM a{i}) GROUP BY cluster, place) GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    last = f"SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    return "WITH " + ", ".join(parts) + " " + last


OP12 = _op12()
