"""Relations that the registered queries read where no caller gives any: all are made of the driver's tables.

Texts are chapters of a manuscript for each source, conversations are its dialogue; orders, lines, parts, customers and
events stand for boards, reports, chronologies and readers.  The rules are those of the plans; only the rows come from here.
"""

from __future__ import annotations

from folioscope.functions.dialect import WORD, Dialect

#: Plans that read dialogue: their chapters are conversations, one speaker a role.
DIALOGUE = {"dialogue_attribution", "dialogue_orders", "speaker_stats", "speaker_words", "voice_collision", "voice_drift", "dialogue_ratio", "dialogue_tags", "beats_and_tags", "forbidden_words", "voice_differentiation"}
GENRES = ("literary", "commercial", "thriller", "prescriptive", "memoir")


def relations(d: Dialect, name: str) -> dict[str, str]:
    """SQL of the relations, by name, for the plan ``name``."""
    s, whole, real = d.text, lambda x: f"CAST({x} AS BIGINT)", lambda x: f"CAST({x} AS DOUBLE)"
    down = lambda x: f"CAST(floor({x}) AS BIGINT)"

    def pick(x: str, *names: str | None) -> str:
        cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else d.lit(v)}" for i, v in enumerate(names))
        return f"(CASE {whole(x)} % {len(names)} {cases} END)"

    def pair(key: str, value: str) -> str:
        """``key="value"`` of a flat record; quotes and backslashes in a value would end it early."""
        return f"concat({d.lit(key + '=' + chr(34))}, replace(replace({value}, '\"', ''), {d.lit(chr(92))}, ''), '\" ')"

    days = lambda x: f"CAST(datediff(CAST({x} AS DATE), DATE '1992-01-01') AS BIGINT)" if d.spark else f"CAST(date_diff('day', DATE '1992-01-01', CAST({x} AS DATE)) AS BIGINT)"
    genre = lambda x: pick(x, *GENRES)
    first = lambda x, n: d.join(d.cut(d.all_of(x, WORD + "+"), "1", str(n)), " ")
    file = f"concat('chapter-', {s('doc_id')}, '.md')"
    docs = f"(SELECT source AS manuscript_id, {file} AS chapter, doc_id AS ord, text AS raw FROM documents WHERE text IS NOT NULL) given"
    speaker = "concat(upper(left(role, 1)), substring(role, 2))"
    line = d.sub("text", "[“”\"\\n]+", " ")
    talk = f"(SELECT concat('talk ', {s('conv_id % 40')}) AS manuscript_id, concat('chapter-', {s('conv_id')}, '-', {s('turn')}, '.md') AS chapter, conv_id * 1000 + turn AS ord, concat('“', {line}, '” ', {pick('conv_id + turn', 'said', 'asked', 'whispered')}, ' ', {speaker}, '.') AS raw FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL) given"
    customer, order = f"concat('b', {s('o_custkey')})", f"concat('b', {s('l_orderkey')})"
    user, part = f"concat('u', {s('user_id')})", f"concat('p', {s('p_partkey')})"
    tenth = lambda x, low, n: f"({low} + {whole(x)} % {n} / 10.0)"

    odd = lambda x, n: f"(CASE WHEN {x} % {n} = 0 THEN 1 ELSE 0 END)"
    # a line number comes more than once in an order: the plans' keys shall not
    lines = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) lines"

    # chronologies: orders are events of their customers' books, and tell ages; from one order to the next one it takes so long
    later = f"CASE WHEN o_orderkey % 3 = 0 THEN concat({s('o_orderkey % 400')}, 'd') ELSE '5w' END"
    owner = f"concat('c', {s('o_custkey % 50')})"
    lines_of = {
        0: f"concat('event id=o', {s('o_orderkey')}, ' day=', {s(days('o_orderdate'))})",
        1: f"concat('age person=c', {s('o_custkey')}, ' at=o', {s('o_orderkey')}, ' years=', {s(down(days('o_orderdate') + ' / 365.25') + ' + 20 + ' + odd('o_orderkey', 41))}, ' src=orders')",
        2: f"concat('span from=o', {s('o_orderkey')}, ' to=o', {s('o_orderkey + 1')}, ' stated=', {later}, ' src=orders')",
        3: f"concat('once id=p', {s('o_custkey % 300')}, ' at=o', {s('o_orderkey')}, ' src=orders')",
    }
    records = "(" + " UNION ALL ".join(f"SELECT {owner} AS manuscript_id, o_orderkey * 10 + {i} AS lineno, {x} AS line FROM orders" for i, x in lines_of.items()) + ")"
    # banks: what the benchmark's items begin with
    term = first("text", 3)
    bank = lambda kind: f"(SELECT item_id AS lineno, concat('{kind} ', {pair('id', 'concat(' + d.lit('t') + ', ' + s('item_id % 97') + ')')}, {pair('term', term)}, {pair('kind', pick('item_id', 'food', 'object', 'music', 'oddity'))}, CASE WHEN item_id % 3 = 0 THEN 'src=bench' ELSE '' END) AS line FROM benchmark WHERE text IS NOT NULL) given"
    languages = "(SELECT DISTINCT source AS manuscript_id FROM documents)"
    # scores
    rated = (("prose", "1.2", tenth("l_quantity", "7.5", "25")), ("theme", "1.0", tenth("l_partkey", "7.5", "25")), ("voice", "0.8", tenth("l_suppkey", "7.5", "25")))
    dims = "UNION ALL".join(f" SELECT {order} AS book, {whole('l_linenumber')} AS iteration, '{k}' AS dimension, {real(w)} AS weight, {real(v)} AS score FROM {lines} " for k, w, v in rated)
    # Spark: lines are brought together once, not for each dimension
    three = d.array([d.struct({"dimension": d.lit(k), "weight": real(w), "score": real(v)}) for k, w, v in rated])
    measured = f"SELECT book, iteration, s.dimension AS dimension, s.weight AS weight, s.score AS score FROM (SELECT {order} AS book, {whole('l_linenumber')} AS iteration, explode({three}) AS s FROM {lines}) measured"
    field = pick("c_custkey", "place", "age", "eyes")
    known = "(SELECT c_name AS entity, {0} AS field, {1} AS val FROM customer) given"
    orders_of = f"(SELECT {customer} AS book, {whole('o_orderkey')} AS chapter, {genre('o_custkey')} AS genre, o_orderkey, o_totalprice, o_orderstatus, o_custkey FROM orders) o"
    number = down("o_totalprice")
    out = {
        "chapters": talk if name in DIALOGUE else docs,
        "lexicon": d.values([("User", "the"), ("user", "and"), ("ASSISTANT", "of"), ("assistant", "die"), ("ghost", "boo")], "who, never_say"),
        "timeline": f"(SELECT lineno, line FROM {records} r) given",
        "records": f"{records} given",
        "textures": bank("texture"),
        "motifs": bank("motif"),
        "bank": f"(SELECT m.manuscript_id, b.lineno, b.line FROM {languages} m JOIN (SELECT * FROM {bank('texture')}) b ON {s('b.lineno % 20')} = {d.sub('m.manuscript_id', '[^0-9]', '')}) given",
        "reports": f"(SELECT source AS manuscript_id, doc_id AS chapter_no, concat('meta  chapter=', {s('doc_id')}, '  structure=', lang, '  hook=', {pick('n_chars', 'image', 'question', 'action')}) AS line FROM documents WHERE n_chars % 7 <> 0 AND lang IS NOT NULL) given",
        "watched": d.values([("in the house of",), ("at the end of the day",)], "phrase"),
        "discovered": f"(SELECT DISTINCT {first('text', 2)} AS phrase FROM documents WHERE text IS NOT NULL AND {first('text', 2)} <> '') given",
        "cast_names": "(SELECT DISTINCT r_name AS name FROM region) given",
        "evidence": f"(SELECT event_id AS row_no, CASE WHEN user_id % 31 = 0 THEN '' ELSE {user} END AS reader_id, CASE WHEN event_id % 41 = 0 THEN 'x' ELSE {s('event_id % 12')} END AS chapter, {s(down('value') + ' % 7')} AS rating, event_type AS comment, {pick('event_id', 'yes', '1', 'no', '')} AS delayed FROM events) given",
        "evaluation_reports": f"(SELECT {customer} AS book, concat({pick('o_orderkey', 'eval-chapter-', 'eval-chapter-', 'notes-')}, {s('o_orderkey')}, '.md') AS name, concat('# Report', {d.lit(chr(10))}, CASE WHEN o_orderkey % 5 = 0 THEN 'no headline' ELSE concat('**Overall Floor:** ', {s(real('7 + ' + number + ' % 30 / 10.0'))}, ' | **Overall Average:** 9.1') END) AS raw FROM orders) given",
        "floors": f"(SELECT {customer} AS book, {whole('o_orderkey')} AS chapter, {real('8.0 + ' + number + ' % 10 / 10.0')} AS floor_score FROM orders) given",
        "gate_tokens": f"(SELECT concat('g', {s('o_orderkey')}) AS gate, {pick('o_custkey', 'lint', 'proof', 'macro', 'dynamic_range:0.01', 'bogus', 'wordcount')} AS token FROM orders) given",
        "outcomes": f"(SELECT concat('g', {s('o_orderkey')}) AS gate, {pick('o_custkey', 'lint', 'proof', 'macro', 'dynamic_range', 'bogus', 'epub')} AS name, {pick(number, 'pass', 'fail', 'error', 'skip')} AS status FROM orders) given",
        "pending": f"(SELECT concat('g', {s('o_orderkey')}) AS gate, 'OUTLINE.md' AS path FROM orders WHERE o_orderkey % 11 = 0) given",
        "languages": f"(SELECT concat('g', {s('o_orderkey')}) AS gate, {pick(number, 'en', 'en-GB', 'pt-BR')} AS lang FROM orders) given",
        "state_lines": f"(SELECT {s('c_nationkey')} AS project, concat({pick('c_custkey', 'phase.', 'chapters.', 'book.meta.')}, {pick(down('c_custkey / 3.0'), 'current', 'completed', 'title')}) AS path, c_mktsegment AS val, {whole('c_custkey')} AS lineno FROM customer) given",
        "wanted_keys": f"(SELECT DISTINCT {s('n_nationkey')} AS project, k AS key FROM nation JOIN {d.values([('title', 1), ('phase.current', 1), ('completed', 1), ('book.meta.title', 1), ('nothing', 1)], 'k, one')} w ON w.one = 1) given",
        "overrides": f"(SELECT {pick('s_suppkey', 'em_dash_per_1k', 'adverb_per_1k', 'echo_window_words', 'min_chapter_words', 'colour')} AS k, {pick('s_nationkey', '3.5', 'many', '7', '150')} AS v FROM supplier WHERE s_suppkey <= 5) given",
        "expected_files": f"(SELECT concat('doc-', {s('doc_id')}) AS path FROM labels) given",
        "listed_files": f"(SELECT concat('doc-', {s('doc_id')}) AS path, CASE doc_id % 17 WHEN 3 THEN ' ' WHEN 5 THEN '<!-- TEMPLATE -->' ELSE text END AS body FROM documents WHERE doc_id % 13 <> 0) given",
        "manifest_items": f"(SELECT {order} AS book, concat('i', {s('l_linenumber')}) AS id, concat('p', {s('l_partkey')}) AS href FROM {lines}) given",
        "spine": f"(SELECT {order} AS book, concat('i', {s('l_linenumber + 50 * ' + odd('l_suppkey', 9))}) AS idref FROM {lines}) given",
        "archive_files": f"(SELECT {order} AS book, concat('p', {s('l_partkey')}) AS name FROM {lines} WHERE l_partkey % 10 <> 0) given",
        "phases": d.values([("plan", "draft"), ("draft", "review"), ("review", "publish"), ("publish", None)], "phase, next_phase"),
        "gated_projects": f"(SELECT concat('o', {s('o_orderkey')}) AS project, {pick('o_custkey', 'plan', 'draft', 'review', 'publish')} AS phase, o_orderstatus <> 'F' AS passed, o_orderpriority LIKE '1%' AS bypass FROM orders) given",
        "wanted_agents": f"(SELECT DISTINCT {pick('s_suppkey', 's', 'Supplier ', 'nobody ')} || {s('s_nationkey')} AS name FROM supplier) given",
        "agents": f"(SELECT {whole('s_suppkey')} AS lineno, concat('supplier_', {s('s_nationkey')}) AS key, concat('Supplier ', {s('s_suppkey % 25')}) AS label, {pick('s_suppkey', 'Claude Opus', 'gpt-5', 'Gemini', 'kimi-k2', 'other')} AS model FROM supplier) given",
        "scores": f"({measured if d.spark else dims}) given",
        "dossiers": f"(SELECT {order} AS book, {whole('l_linenumber')} AS iteration, {whole('l_suppkey % 5')} AS evidenced, {pick('l_partkey', '', '', 'MAJOR REWRITE')} AS audit, {real(tenth('l_partkey', '7.0', '30'))} AS viability FROM {lines} WHERE l_linenumber <= 3) given",
        "viability": f"(SELECT {part} AS book, {real(tenth('p_size', '5.0', '50'))} AS pacing, {whole('p_size % 6')} AS anchors, {real(tenth('p_partkey', '5.0', '50'))} AS casual, {real('p_partkey % 6')} AS quote, {real('p_size % 5')} AS plot, {real('p_partkey % 5')} AS emotional, {pick('p_size', 'yes', 'partial', 'no')} AS pitch, {pick('p_partkey', 'yes', 'partial', 'no')} AS closeness, {pick('p_size', 'strong', 'none', '')} AS anchor FROM part) given",
        "legacies": f"(SELECT {part} AS book, {pick('p_partkey', 'default', 'aspiration', 'prescriptive')} AS engagement, " + ", ".join(f"{real(tenth(f'p_partkey * {k} + p_size', '4.0', '60'))} AS {n}" for k, n in ((3, "originality"), (7, "theme"), (11, "vocabulary"), (13, "rereading"), (17, "identity"), (19, "framework"))) + " FROM part) given",
        "panels": f"(SELECT {customer} AS book, {real('6.0 + max(' + number + ') % 40 / 10.0')} AS raw FROM orders GROUP BY o_custkey) given",
        "gates": f"(SELECT {customer} AS book, {pick('o_orderkey', 'proof', 'score')} AS gate, {real(tenth(number, '6.0', '40'))} AS score FROM orders) given",
        "flags": f"(SELECT concat(event_type, {s('event_id % 200')}) AS issue, {whole('event_id % 6')} AS chapter, {pick('user_id', 'critic', 'casual', 'hostile', 'devourer', 'devoted')} AS reader FROM events) given",
        "evaluations": f"(SELECT book, chapter, genre, {real(tenth(number, '6.0', '40'))} AS lowest, {real(tenth('o_orderkey', '6.0', '40'))} AS casual FROM {orders_of}) given",
        "measures": f"(SELECT book, chapter, genre, {real(tenth(number, '6.0', '30'))} AS lowest, {whole('o_orderkey % 12')} AS patterns, {whole('o_orderkey % 9')} AS extensions, {whole('o_custkey % 12')} AS dashes, {pick('o_orderkey', 'keep reading', 'keep reading', 'put down')} AS casual FROM {orders_of}) given",
        "patterns": f"(SELECT {order} AS book, {genre('l_orderkey')} AS genre, {whole('l_linenumber')} AS chapter, {whole('l_partkey % 20')} AS pattern, {whole('l_quantity % 7')} AS instances, {whole('1000 + l_suppkey % 50 * 100')} AS words FROM {lines}) given",
        "scans": f"(SELECT {part} AS book, {genre('p_partkey')} AS genre, {whole('p_size % 14')} AS patterns, p_size % 2 = 0 AS accessible FROM part) given",
        "proses": f"(SELECT book, chapter, genre, {whole('o_orderkey % 12')} AS extensions, {whole(number + ' % 9000')} AS words, {real(tenth('o_orderkey', '7.0', '25'))} AS prose FROM {orders_of}) given",
        "supplements": f"(SELECT {order} AS book, concat('H', {s('l_partkey % 8')}) AS pattern, {whole('l_quantity % 4')} AS instances FROM {lines}) given",
        "tensions": f"(SELECT {order} AS book, {whole('l_linenumber')} AS chapter, {whole('l_quantity % 5 + 1')} AS level, {whole('l_partkey % 3 - 1')} AS mood FROM {lines}) given",
        "facts": f"(SELECT {user} AS who, concat('fact ', {s('event_id % 25')}) AS fact, CASE WHEN event_type = 'view' THEN 'learned' ELSE 'used' END AS kind, event_id AS ord FROM events) given",
        "known": known.format(field, "c_mktsegment"),
        "fresh": f"(SELECT c_name AS entity, {pick('c_custkey + c_nationkey % 2', 'place', 'age', 'eyes')} AS field, {pick('c_custkey', 'BUILDING', 'MACHINERY', 'AUTOMOBILE')} AS val FROM customer WHERE c_custkey % 4 <> 0) given",
        "alive": f"(SELECT c_name AS entity, {field} AS field, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE {pick('c_custkey', 'BUILDING', 'MACHINERY', 'AUTOMOBILE')} END AS val FROM customer) given",
        "patches": f"(SELECT c_name AS entity, {pick('c_custkey + c_nationkey % 2', 'place', 'age', 'eyes')} AS field, {pick('c_nationkey', 'keep_original', 'update', 'add', 'create', 'remove_conflict', 'erase')} AS action, {pick('c_custkey', 'new', 'newer', None)} AS val FROM customer WHERE c_custkey % 5 <> 0) given",
        "moves": f"(SELECT {user} AS entity, event_id AS ord, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS place, value > 20 AS travelled FROM events) given",
        "setups": f"(SELECT concat({user}, ' ', {s('event_id % 9')}) AS thing, event_id AS ord, value > 20 AS major FROM events WHERE event_type = 'signup') given",
        "payoffs": f"(SELECT concat({user}, ' ', {s('event_id % 9')}) AS thing, event_id AS ord FROM events WHERE event_type = 'purchase') given",
        "entities": f"(SELECT {user} AS entity, {pick('event_id', 'place', 'mood')} AS field, event_id AS ord, event_type AS val FROM events) given",
        "mentions": f"(SELECT concat('Customer#', {s('user_id')}) AS entity, {whole('event_id % 30')} AS ord, event_type = 'signup' AS speaks FROM events) given",
        "tracked": f"(SELECT DISTINCT {whole('event_id % 30')} AS ord FROM events WHERE event_id % 30 < 20) given",
        "ordered": f"(SELECT {order} AS book, {whole('l_linenumber')} AS ord FROM {lines}) given",
        "revised": f"(SELECT {order} AS book, {whole('l_linenumber')} AS ord FROM {lines} WHERE l_returnflag = 'R' AND l_quantity > 45) given",
        "ideas": f"(SELECT {part} AS idea, " + ", ".join(f"{real(f'p_partkey * {k} % 100003 / 10000.0')} AS {n}" for k, n in ((7919, "hook"), (6007, "irony"), (4001, "escalation"), (3001, "question"), (2003, "gap"), (1009, "retelling"))) + " FROM part) given",
        "hooks": f"(SELECT {order} AS book, {genre('l_orderkey')} AS genre, {whole('l_linenumber')} AS chapter, {whole('l_quantity % 6 + 5')} AS hook, {whole('l_partkey % 6 + 5')} AS pull FROM {lines}) given",
        "targets": f"(SELECT source AS manuscript_id, {file} AS chapter, {whole('doc_id % 900')} AS target FROM documents) given",
        "books": f"(SELECT {order} AS book, {genre('l_orderkey')} AS genre, {whole('sum(l_quantity) * 500')} AS words, {real('5.0 + max(l_partkey) % 40 / 10.0')} AS grade, {whole('sum(l_suppkey) % 1200')} AS adverbs FROM {lines} GROUP BY l_orderkey) given",
        "turning_points": f"(SELECT {order} AS book, {whole('l_linenumber')} AS ord, {whole('l_linenumber * 18000 + l_quantity * 100')} AS at_word FROM {lines} WHERE l_linenumber <= 3) given",
        "pack_projects": f"(SELECT manuscript_id, {pick('no', 'Historical', 'Drama', 'Verse')} AS genre, {pick('no', None, 'City', 'Period Drama', 'sea')} AS subgenre FROM (SELECT DISTINCT source AS manuscript_id, CAST({d.first('source', '[0-9]+')} AS BIGINT) AS no FROM documents WHERE {d.has('source', '[0-9]')}) n) given",
        "samples": f"(SELECT {order} AS book, {pick('l_partkey', 'voice-breaking', 'plain', 'irrelevant-thought', 'plain')} AS kind FROM {lines}) given",
    }
    return out

