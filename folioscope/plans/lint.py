"""Lint: one findings relation over chapters (manuscript_id, chapter, ord, raw).

Counts are taken in one pass over the text and aggregated once, by chapter and by manuscript together (grouping sets);
word-level checks (echoes, opener runs, repeats) work on exploded tokens. Every finding is a row: check_name, severity,
chapter (null: the manuscript), item, n, measured, low and high (the limits that it breaks; null: none).

Counts of a manuscript are sums over its chapters: a pattern or sentence does not run over a chapter's end.
"""

from __future__ import annotations

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import END, LINT_END, LINT_TOKEN, PARAGRAPH_END, Dialect
from folioscope.plans import frequent
from folioscope.plans.registry import chapters, plan
from folioscope.plans.voices import collisions, drift

QUOTED = r"[\"“]([^\"“”]+)[\"”]"
_TAGS = "|".join(lx.TAG_VERBS)
FIELDS = ["check_name", "severity", "item", "n", "measured", "low", "high"]
SPAN = 40


def thresholds(profile: str = "", overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Limits of a profile with overrides on top; unknown names raise KeyError."""
    name = profile.strip().lower().removesuffix(" fiction")
    found = lx.THRESHOLDS | lx.PROFILES.get(name, {})
    if unknown := set(overrides or {}) - set(found):
        raise KeyError(", ".join(sorted(unknown)))
    return found | (overrides or {})


def _phrase(words: str) -> str:
    return r"(?i)\b" + words.replace("-", "[-]") + r"\b"


def _counts(d: Dialect, rel: str, fails: bool = False) -> tuple[str, list[str]]:
    """One row of counts per chapter, and the names of the counts that add up.  Findings that fail ask nothing of a sentence's length."""
    text = f"(SELECT manuscript_id, chapter, ord, {d.strip_markdown('raw')} AS p FROM {rel} src)"
    parts = f"""(SELECT manuscript_id, chapter, ord, p, {d.lint_tokens('p')} AS ws, {d.tokens('p')} AS toks, {d.lint_sentences('p')} AS ss, {d.size(d.sentences('p'))} AS n_sents,
        {d.paragraphs('p')} AS opens, {d.join(d.all_of('p', QUOTED, 1), ' ')} AS spoken FROM {text} t)"""
    if d.spark:
        # sentences are not trimmed and paragraphs only counted; words and letters of words are counted in one line, not word by word
        parts = f"""(SELECT manuscript_id, chapter, ord, p, {d.tokens('p')} AS toks, {d.whole_parts('p', LINT_END)} AS ss, {d.size(d.whole_parts('p', END))} AS n_sents,
            {d.size(d.whole_parts('p', f'()(?:{PARAGRAPH_END})'))} AS opens, {d.join(d.all_of('p', QUOTED, 1), ' ')} AS spoken FROM {text} t)"""
    lens = d.keep(d.map(d.map("ss", "s", d.size(d.lint_tokens("s"))), "k", "CAST(k AS DOUBLE)"), "k", "k > 0")
    line = f", concat(' ', {d.join('toks', ' ')}, ' ') AS line" if d.spark else ""
    sized = f"(SELECT *, {lens} AS lens{line} FROM {parts} q)"
    filters = r"\b(?:I|[Hh]e|[Ss]he|[Tt]hey|[Ww]e|[A-Z][\w'’-]+)\s+(?:" + "|".join(lx.FILTER_VERBS) + r")\b"
    not_adverb = "(" + ", ".join(d.lit(w) for w in lx.NOT_ADVERBS) + ")"
    last = f"lower({d.at('ss', '-1')})"
    sums = {
        "words": d.size("ws"),
        "dashes": d.count("p", "—|--"),
        "nxby": d.count("p", lx.NOT_BUT),
        "ext": d.count("p", lx.EXTENSION),
        "filters": f"{d.count('p', filters)} + {d.count('p', lx.FOUND_SELF)}",
        "toks_n": d.size("toks"),
        "adverbs": d.size(d.keep("toks", "w", f"length(w) > 3 AND w LIKE '%ly' AND w NOT IN {not_adverb}")),
        "syllables": f"CAST({d.total(d.map('toks', 'w', 'CAST(' + d.syllables('w') + ' AS DOUBLE)'))} AS BIGINT)",
        "sents": "n_sents",
        "spoken_n": f"coalesce({d.size(d.tokens('spoken'))}, 0)",
        "paras": d.size("opens"),
        "maxims": f"CASE WHEN {d.has(last, lx.ABSTRACT)} AND NOT {d.has(last, lx.CONCRETE)} THEN 1 ELSE 0 END",
        "tags": f"{d.count('p', r'(?i)[\"”]\s*,?\s*(?:' + _TAGS + r')\b')} + {d.count('p', r'(?i)\b\w+\s+(?:' + _TAGS + r')[,:]?\s*[\"“]')}",
        "plain_tags": f"{d.count('p', r'(?i)[\"”]\s*,?\s*(?:said|asked)\b')} + {d.count('p', r'(?i)\b\w+\s+(?:said|asked)[,:]?\s*[\"“]')}",
    }
    if d.spark:
        last = f"lower({d.trim(d.at('ss', '-1'))})"
        sums |= {
            "words": d.count("p", LINT_TOKEN) if fails else f"CAST({d.total('lens')} AS BIGINT)",
            "adverbs": d.size(d.keep(d.all_of("line", " ([^ ]{2,}ly)(?= )", 1), "w", f"w NOT IN {not_adverb}")),
            "syllables": d.line_syllables("line"),
            "spoken_n": f"coalesce({d.n_tokens('spoken')}, 0)",
            "paras": "opens",
            "maxims": f"CASE WHEN {d.has(last, lx.ABSTRACT)} AND NOT {d.has(last, lx.CONCRETE)} THEN 1 ELSE 0 END",
        }
    cols = ", ".join(f"{v} AS {k}" for k, v in sums.items())
    n, s, q = d.size("lens"), d.total("lens"), d.total(d.map("lens", "k", "k * k"))
    cv = f"CASE WHEN {n} < 2 THEN 0.0 ELSE sqrt(greatest({q} - {s} * {s} / {n}, 0.0) / ({n} - 1)) / ({s} / {n}) END"
    return f"(SELECT manuscript_id, chapter, ord, {cols}, {d.size('ss')} AS lint_sents, {cv} AS cv FROM {sized} z)", list(sums)


def _row(d: Dialect, check: str, severity: str, when: str, n: str, measured: str, low="NULL", high="NULL", item="NULL") -> str:
    num = lambda x: f"CAST({x} AS DOUBLE)"
    return d.struct({"hit": f"coalesce({when}, false)", "check_name": d.lit(check), "severity": d.lit(severity), "item": d.text(item), "n": f"CAST({n} AS BIGINT)", "measured": num(measured), "low": num(low), "high": num(high)})


def _scalar_findings(d: Dialect, rel: str, th: dict[str, float], fails: bool = False) -> str:
    counts, names = _counts(d, rel, fails)
    mono = f"CASE WHEN lint_sents >= {th['sentence_monotony_min_sentences']} AND cv < {th['sentence_cv_min']} THEN 1 ELSE 0 END"
    both = f"""(SELECT manuscript_id, chapter, count(*) AS chs, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in names)}, CAST(sum({mono}) AS BIGINT) AS monotone,
        coalesce(stddev_samp(CAST(words AS DOUBLE)), 0.0) / greatest(avg(words), 1e-9) AS length_cv, avg(CASE WHEN lint_sents > 0 THEN CAST(words AS DOUBLE) / lint_sents ELSE 0.0 END) AS mean_len
        FROM {counts} k GROUP BY GROUPING SETS ((manuscript_id), (manuscript_id, chapter)))"""
    per = lambda n, by, of="words": f"({n} * {by} / greatest({of}, 1))"
    whole, part, mult = "chapter IS NULL AND words > 0", f"chapter IS NOT NULL AND words >= {th['local_density_min_words']}", th["local_density_multiplier"]

    def over(check, severity, scope, n, rate, high, item="NULL"):
        return _row(d, check, severity, f"{scope} AND {rate} > {high}", n, rate, high=str(high), item=item)

    def outside(check, value, low, high):
        return _row(d, check, "warn", f"{whole} AND NOT ({value} BETWEEN {low} AND {high})", "NULL", value, str(low), str(high))

    grade = "(0.39 * (CAST(toks_n AS DOUBLE) / greatest(sents, 1)) + 11.8 * (CAST(syllables AS DOUBLE) / greatest(toks_n, 1)) - 15.59)"
    share = lambda n, of: f"(CAST({n} AS DOUBLE) / greatest({of}, 1))"
    rows = [
        _row(d, "manuscript", "fail", "chapter IS NULL AND words = 0", "chs", "0.0"),
        over("em_dash_density", "fail", whole, "dashes", per("dashes", "1000.0"), th["em_dash_per_1k"]),
        over("not_x_but_y", "fail", whole, "nxby", per("nxby", "10000.0"), th["not_x_but_y_per_10k"]),
        over("explanatory_extension", "fail", whole, "ext", per("ext", "1000.0"), th["explanatory_extension_per_1k"]),
        over("em_dash_density_local", "fail", part, "dashes", per("dashes", "1000.0"), th["em_dash_per_1k"] * mult),
        over("not_x_but_y_local", "fail", part, "nxby", per("nxby", "1000.0"), th["not_x_but_y_per_10k"] * 10 * mult),
        over("adverb_density_local", "warn", part, "adverbs", per("adverbs", "1000.0", "toks_n"), th["adverb_per_1k"] * mult),
        over("maxim_endings", "fail", whole, "maxims", share("maxims", "chs"), th["maxim_ending_share"]),
        _row(d, "length_uniformity", "warn", f"{whole} AND chs >= 3 AND length_cv < {th['length_cv']}", "chs", "length_cv", low=str(th["length_cv"])),
        _row(d, "short_chapter", "warn", f"chapter IS NOT NULL AND words < {th['min_chapter_words']}", "words", "words", low=str(th["min_chapter_words"])),
        _row(d, "sentence_monotony", "warn", f"{whole} AND monotone > 0", "monotone", "monotone", low=str(th["sentence_cv_min"])),
        outside("readability", f"CASE WHEN toks_n = 0 OR sents = 0 THEN 0.0 ELSE {grade} END", th["fk_grade_min"], th["fk_grade_max"]),
        outside("sentence_length", "mean_len", th["sentence_len_min"], th["sentence_len_max"]),
        outside("dialogue_ratio", share("spoken_n", "toks_n"), th["dialogue_ratio_min"], th["dialogue_ratio_max"]),
        over("adverb_density", "warn", whole, "adverbs", per("adverbs", "1000.0", "toks_n"), th["adverb_per_1k"]),
        over("filter_word_density", "warn", whole, "filters", per("filters", "1000.0"), th["filter_word_per_1k"]),
        _row(d, "dialogue_tag_variety", "warn", f"{whole} AND tags >= {th['min_tag_sample']} AND {share('plain_tags', 'tags')} < {th['said_tag_share_min']}", "tags", share("plain_tags", "tags"), low=str(th["said_tag_share_min"])),
    ]
    rows = [r for r in rows if not fails or f"'severity', {d.lit('fail')}" in r]
    found = d.spread(f"(SELECT manuscript_id, chapter, {d.array(rows)} AS fs FROM {both} b)", "manuscript_id, chapter", "fs", "fpos", "f")
    return f"SELECT manuscript_id, chapter, {', '.join(f'f.{k} AS {k}' for k in FIELDS)} FROM {found} g WHERE f.hit"


def _item_findings(d: Dialect, rel: str, th: dict[str, float], fails: bool = False) -> str:
    """Watched phrases, openers, modern words and line defects: each chapter yields only the items that it has.

    One alternation finds all watched phrases and modern words: none of them ends as another begins, so none hides another.
    """
    listed = [("phrase_repetition", w.lower(), w) for w in lx.WATCH_PHRASES] + [("modern_register", w.lower(), w) for w in lx.MODERN_WORDS if not fails]
    opener = " ".join(f"WHEN x LIKE {d.lit(o.lower() + '%')} THEN {d.lit(o)}" for o in lx.OPENERS)
    opens = d.map(d.map(d.paragraphs("low"), "x", d.sub("x", '^["“‘' + chr(39) + r"]+\s*", "")), "x", f"CASE {opener} ELSE '' END")
    item = lambda check, x, n: d.struct({"check_name": d.lit(check), "item": x, "n": f"CAST({n} AS BIGINT)"})
    watched = d.all_of("low", r"\b(?:" + "|".join(key for _, key, _ in listed) + r")\b")
    if d.spark:
        # most texts hold none of them, which a plain search tells; paragraphs are not trimmed, as only their beginnings count
        watched = f"CASE WHEN {' OR '.join(d.contains('low', d.lit(key)) for _, key, _ in listed)} THEN {watched} ELSE CAST(array() AS ARRAY<STRING>) END"
        opens = d.map(d.map(d.whole_parts("low", f"()(?:{PARAGRAPH_END})"), "x", d.sub("x", r'^\s*(?:["“‘' + chr(39) + r"]+\s*)?", "")), "x", f"CASE {opener} ELSE '' END")
    words = d.count("p", LINT_TOKEN) if d.spark else d.size(d.lint_tokens("p"))
    defects = [] if fails else [item("line_defect", d.lit(label), d.count("p", pattern)) for pattern, label in lx.LINE_DEFECTS]
    alone = defects + [item("words", "''", words)]
    arrays = d.flatten(d.array([d.map(watched, "x", item("watched", "x", "1")), d.map(opens, "x", item("opener_monotony", "x", "1")), d.array(alone)]))
    parts = f"(SELECT manuscript_id, p, lower(p) AS low FROM (SELECT manuscript_id, {d.strip_markdown('raw')} AS p FROM {rel} src) t)"
    each = d.spread(f"(SELECT manuscript_id, {arrays} AS fs FROM {parts} q)", "manuscript_id", "fs", "fpos", "f")
    summed = f"(SELECT manuscript_id, f.check_name AS check_name, f.item AS item, CAST(sum(f.n) AS BIGINT) AS n FROM {each} g GROUP BY manuscript_id, f.check_name, f.item)"
    named = f"(SELECT w.manuscript_id, coalesce(l.check_name, w.check_name) AS check_name, coalesce(l.item, w.item) AS item, w.n FROM {summed} w LEFT JOIN {d.values(listed, 'check_name, low_key, item')} l ON w.check_name = 'watched' AND l.low_key = w.item)"
    whole = f"(SELECT *, sum(CASE WHEN check_name = 'words' THEN n END) OVER (PARTITION BY manuscript_id) AS words, CAST(sum(CASE WHEN check_name = 'opener_monotony' THEN n END) OVER (PARTITION BY manuscript_id) AS DOUBLE) AS paras FROM {named} w)"
    rated = f"""(SELECT *, CASE check_name WHEN 'opener_monotony' THEN CAST(n AS DOUBLE) / paras WHEN 'phrase_repetition' THEN CAST(n AS DOUBLE) * 10000.0 / words ELSE CAST(n AS DOUBLE) END AS measured,
        CASE check_name WHEN 'opener_monotony' THEN {th['opener_share']} WHEN 'phrase_repetition' THEN {th['phrase_per_10k']} ELSE 0.0 END AS high FROM {whole} v WHERE check_name <> 'words' AND item <> '' AND words > 0)"""
    return f"""SELECT manuscript_id, {d.text('NULL')} AS chapter, check_name, CASE WHEN check_name IN ('opener_monotony', 'phrase_repetition') THEN 'fail' ELSE 'warn' END AS severity, item, n, CAST(measured AS DOUBLE) AS measured,
        CAST(NULL AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM {rated} r WHERE measured > high"""


def _toks(d: Dialect, rel: str) -> str:
    return f"(SELECT manuscript_id, chapter, {d.tokens(d.strip_markdown('raw'))} AS toks FROM {rel} src)"


def _totals(d: Dialect, rel: str) -> str:
    if d.spark:
        return f"(SELECT manuscript_id, CAST(greatest(sum({d.n_tokens(d.strip_markdown('raw'))}), 1) AS DOUBLE) AS total FROM {rel} tt GROUP BY manuscript_id)"
    return f"(SELECT manuscript_id, CAST(greatest(sum({d.size('toks')}), 1) AS DOUBLE) AS total FROM {_toks(d, rel)} tt GROUP BY manuscript_id)"


def _names(d: Dialect, rel: str) -> str:
    """The cast: the 15 most frequent capitalised words that do not mostly begin a sentence."""
    sents = d.spread(f"(SELECT manuscript_id, {d.sentences(d.strip_markdown('raw'))} AS ss FROM {rel} src)", "manuscript_id", "ss", "spos", "sent")
    words = d.spread(f"(SELECT manuscript_id, {d.all_of('sent', r'[\p{L}\p{N}_](?:[\p{L}\p{N}_' + chr(39) + r'’-]*[\p{L}\p{N}_])?')} AS ws FROM {sents} q)", "manuscript_id", "ws", "pos", "w")
    stop = ", ".join(d.lit(w) for w in lx.FUNCTION_WORDS)
    return f"""(SELECT manuscript_id, lower(w) AS cast_name FROM (SELECT manuscript_id, w, row_number() OVER (PARTITION BY manuscript_id ORDER BY n DESC, w) AS r FROM (SELECT manuscript_id, w, count(*) AS n, count(CASE WHEN pos = 0 THEN 1 END) AS initial
        FROM {words} k WHERE {d.has('w', '^[A-Z]..')} AND lower(w) NOT IN ({stop}) GROUP BY manuscript_id, w HAVING count(*) >= 3) a WHERE initial < 0.85 * n) b WHERE r <= 15)"""


def _echo_findings(d: Dialect, rel: str, th: dict[str, float]) -> str:
    toks = d.spread(_toks(d, rel), "manuscript_id, chapter", "toks", "pos", "tok")
    stop = ", ".join(d.lit(w) for w in lx.FUNCTION_WORDS)
    gaps = f"(SELECT manuscript_id, tok, pos - lag(pos) OVER (PARTITION BY manuscript_id, chapter, tok ORDER BY pos) AS gap FROM {toks} k WHERE length(tok) >= {th['echo_min_word_len']} AND tok NOT IN ({stop}))"
    return f"""SELECT e.manuscript_id, {d.text('NULL')} AS chapter, 'word_echo' AS check_name, 'warn' AS severity, e.tok AS item, e.n, e.n * 10000.0 / t.total AS measured, CAST(NULL AS DOUBLE) AS low, CAST({th['echo_per_10k']} AS DOUBLE) AS high
        FROM (SELECT manuscript_id, tok, count(*) AS n FROM {gaps} g WHERE gap <= {th['echo_window_words']} GROUP BY manuscript_id, tok) e JOIN {_totals(d, rel)} t ON t.manuscript_id = e.manuscript_id
        LEFT JOIN {_names(d, rel)} c ON c.manuscript_id = e.manuscript_id AND c.cast_name = e.tok WHERE c.cast_name IS NULL AND e.n * 10000.0 / t.total > {th['echo_per_10k']}"""


def _run_findings(d: Dialect, rel: str, th: dict[str, float]) -> str:
    paras = d.spread(f"(SELECT manuscript_id, chapter, {d.paragraphs(d.strip_markdown('raw'))} AS ps FROM {rel} src)", "manuscript_id, chapter", "ps", "para", "ptext")
    sents = d.spread(f"(SELECT manuscript_id, chapter, para, {d.sentences('ptext')} AS ss FROM {paras} q)", "manuscript_id, chapter, para", "ss", "pos", "sent")
    over = "OVER (PARTITION BY manuscript_id, chapter, para ORDER BY pos)"
    runs = f"""(SELECT manuscript_id, chapter, opener, count(*) AS run FROM (SELECT *, sum(brk) OVER (PARTITION BY manuscript_id, chapter, para ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM
        (SELECT *, CASE WHEN opener IS NOT NULL AND opener = lag(opener) {over} THEN 0 ELSE 1 END AS brk FROM (SELECT manuscript_id, chapter, para, pos, {d.at(d.tokens('sent'), '1')} AS opener FROM {sents} r) o) m) g
        WHERE opener IS NOT NULL GROUP BY manuscript_id, chapter, para, grp, opener HAVING count(*) >= {th['opener_repeat_run_min']})"""
    return f"SELECT manuscript_id, chapter, 'sentence_opener_repeat' AS check_name, 'warn' AS severity, opener AS item, count(*) AS n, CAST(max(run) AS DOUBLE) AS measured, CAST(NULL AS DOUBLE) AS low, CAST({th['opener_repeat_run_min']} AS DOUBLE) AS high FROM {runs} u GROUP BY manuscript_id, chapter, opener"


def _escalation_findings(d: Dialect, rel: str, th: dict[str, float]) -> str:
    """Watched phrases in the first and last third of six chapters or more."""
    ranks = f"(SELECT manuscript_id, chapter, row_number() OVER (PARTITION BY manuscript_id ORDER BY ord, chapter) AS r, count(*) OVER (PARTITION BY manuscript_id) AS n FROM {rel} src)"
    k = "CAST(floor(r.n / 3.0) AS BIGINT)"
    third = f"CASE WHEN r.r <= {k} THEN 'early' WHEN r.r > r.n - {k} THEN 'late' END"
    hits = ", ".join(f"{d.count('p', _phrase(w))} AS phrase_{i}" for i, w in enumerate(lx.WATCH_PHRASES))
    counted = f"(SELECT manuscript_id, chapter, {d.size(d.lint_tokens('p'))} AS words, {hits} FROM (SELECT manuscript_id, chapter, {d.strip_markdown('raw')} AS p FROM {rel} src) t)"
    if d.spark:
        # most chapters hold none of the phrases in any case: a search for its letters spares the regular expression
        hits = ", ".join(f"CASE WHEN NOT contains(low, {d.lit(w.lower())}) THEN 0L ELSE {d.count('p', _phrase(w))} END AS phrase_{i}" for i, w in enumerate(lx.WATCH_PHRASES))
        counted = f"(SELECT manuscript_id, chapter, {d.count('p', LINT_TOKEN)} AS words, {hits} FROM (SELECT manuscript_id, chapter, p, lower(p) AS low FROM (SELECT manuscript_id, chapter, {d.strip_markdown('raw')} AS p FROM {rel} src) t0) t)"
    sides = ", ".join(f"CAST(sum(CASE WHEN third = '{side}' THEN {c} ELSE 0 END) AS DOUBLE) AS {side}_{c}" for side in ("early", "late") for c in ["words"] + [f"phrase_{i}" for i in range(len(lx.WATCH_PHRASES))])
    both = f"(SELECT manuscript_id, {sides} FROM (SELECT c.*, {third} AS third FROM {counted} c JOIN {ranks} r ON r.manuscript_id = c.manuscript_id AND r.chapter = c.chapter WHERE r.n >= 6) x WHERE third IS NOT NULL GROUP BY manuscript_id)"
    rows = []
    for i, w in enumerate(lx.WATCH_PHRASES):
        early, late = (f"({s}_phrase_{i} * 1000.0 / greatest({s}_words, 1.0))" for s in ("early", "late"))
        when = f"{late} >= {th['escalation_min_last_per_1k']} AND (({early} > 0 AND {late} / {early} >= {th['escalation_ratio']}) OR ({early} = 0 AND late_phrase_{i} >= 2))"
        rows.append(_row(d, "phrase_escalation", "warn", when, f"late_phrase_{i}", late, early, str(th["escalation_ratio"]), d.lit(w)))
    found = d.spread(f"(SELECT manuscript_id, {d.array(rows)} AS fs FROM {both} b)", "manuscript_id", "fs", "fpos", "f")
    return f"SELECT manuscript_id, {d.text('NULL')} AS chapter, {', '.join(f'f.{c} AS {c}' for c in FIELDS)} FROM {found} g WHERE f.hit"


def _voice_findings(d: Dialect, rel: str) -> str:
    """Pairs of speakers whose signatures cannot be told apart, pairs that came to that, and speakers too thin to tell."""
    row = lambda name, severity, item, high: f"manuscript_id, {d.text('NULL')} AS chapter, {name} AS check_name, {severity} AS severity, {item} AS item, CAST(1 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS measured, CAST(NULL AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high"
    thin = "kind = 'insufficient'"
    return f"""SELECT {row("'voice_collision'", "'warn'", "pair", "0")} FROM {collisions(d, rel)} vc
        UNION ALL SELECT {row(f"CASE WHEN {thin} THEN 'voice_drift_insufficient_data' ELSE 'voice_drift' END", f"CASE WHEN {thin} THEN 'info' ELSE 'warn' END", "who", "0")} FROM {drift(d, rel)} vd"""


def repeats(d: Dialect, rel: str, th: dict[str, float]) -> str:
    """Maximal repeats: phrases five times or more in two chapters or more, extended while every occurrence agrees.

    The words that all occurrences of a seed share to the right are the common beginning of the smallest and the largest
    of their right contexts, so two aggregates replace any gathering of occurrences. On Spark, rare runs do not move. Spans
    end at 40 words; a longer repeat shows as spans that overlap. A phrase inside a longer one is dropped.
    """
    stop = ", ".join(d.lit(w) for w in lx.FUNCTION_WORDS)
    if d.spark:
        met = frequent.seeds(d, _toks(d, rel), stop, th["ngram_min_count"], th["ngram_per_10k"], SPAN)
    else:
        # grams are made in each chapter's own array, so no token meets its neighbour in a window
        marked = f"(SELECT manuscript_id, chapter, toks, {d.map('toks', 'w', f'CASE WHEN w IN ({stop}) THEN 0 ELSE 1 END')} AS marks FROM {_toks(d, rel)} m)"
        grams = d.spread(f"(SELECT manuscript_id, chapter, {d.ngrams('toks', 3, 'marks', 2)} AS gs FROM {marked} g)", "manuscript_id, chapter", "gs", "pos", "gram")
        occ = f"(SELECT manuscript_id, chapter, pos + 1 AS place, gram FROM {grams} o WHERE gram IS NOT NULL)"
        seeds = f"(SELECT s.manuscript_id, s.gram FROM (SELECT manuscript_id, gram, count(*) AS n FROM {occ} o GROUP BY manuscript_id, gram HAVING count(*) >= {th['ngram_min_count']} AND count(DISTINCT chapter) >= 2) s JOIN {_totals(d, rel)} t ON t.manuscript_id = s.manuscript_id WHERE s.n * 10000.0 / t.total >= {th['ngram_per_10k']})"
        ctx = f"""(SELECT o.manuscript_id, o.chapter, o.gram, {d.cut('c.toks', 'o.place', f'least(o.place + {SPAN - 1}, {d.size("c.toks")})')} AS ahead, {d.reverse(d.cut('c.toks', f'greatest(o.place - {SPAN - 3}, 1)', 'o.place'))} AS behind
        FROM {occ} o JOIN {seeds} s ON s.manuscript_id = o.manuscript_id AND s.gram = o.gram JOIN {_toks(d, rel)} c ON c.manuscript_id = o.manuscript_id AND c.chapter = o.chapter)"""
        met = f"(SELECT manuscript_id, gram, count(*) AS n, count(DISTINCT chapter) AS chs, min(ahead) AS ahead, max(ahead) AS ahead_max, min(behind) AS behind, max(behind) AS behind_max FROM {ctx} x GROUP BY manuscript_id, gram)"
    ext = f"""(SELECT manuscript_id, gram, n, chs, ahead, behind, {d.shared('ahead', 'ahead_max')} AS n_ahead, {d.shared('behind', 'behind_max')} - 1 AS n_behind FROM
        {met} e)"""
    left = f"{d.reverse(d.cut('behind', '2', f'1 + least(n_behind, {SPAN} - n_ahead)'))}"
    spans = f"(SELECT DISTINCT manuscript_id, {'concat' if d.spark else 'list_concat'}({left}, {d.cut('ahead', '1', 'n_ahead')}) AS span, n, chs FROM {ext} y)"
    named = f"(SELECT manuscript_id, {d.join('span', ' ')} AS phrase, {d.size('span')} AS len, span, n, chs, {d.join(d.cut('span', '2', d.size('span') + ' - 1'), ' ')} AS inner_key FROM {spans} z)"
    # A phrase stands in a longer one only if its inner words are a window of it: the windows are the join key.
    starts = d.spread(f"(SELECT manuscript_id, phrase, span, len, {d.numbers('1', 'len')} AS firsts FROM {named} n1)", "manuscript_id, phrase, span, len", "firsts", "fpos", "first_at")
    ends = d.spread(f"(SELECT manuscript_id, phrase, span, first_at, {d.numbers('first_at', 'len')} AS lasts FROM {starts} n2)", "manuscript_id, phrase, span, first_at", "lasts", "lpos", "last_at")
    windows = f"(SELECT DISTINCT manuscript_id, phrase, {d.join(d.cut('span', 'first_at', 'last_at'), ' ')} AS win FROM {ends} n3)"
    return f"""SELECT manuscript_id, phrase, len, n, chs FROM {named} h WHERE NOT EXISTS (SELECT 1 FROM {windows} v WHERE v.manuscript_id = h.manuscript_id AND v.win = h.inner_key AND length(v.phrase) > length(h.phrase) AND {d.contains('v.phrase', 'h.phrase')})"""


def failures(d: Dialect, rel: str, th: dict[str, float]) -> str:
    """The findings with severity fail, the same rows; what only warns is not reckoned.  Escalation, echoes, runs and voices never fail."""
    return _rounded([_scalar_findings(d, rel, th, True), _item_findings(d, rel, th, True)])


def _rounded(arms: list[str]) -> str:
    return f"SELECT manuscript_id, chapter, check_name, severity, item, n, round(measured, 6) AS measured, low, high FROM ({' UNION ALL '.join(arms)}) all_findings"


def findings(d: Dialect, rel: str, th: dict[str, float]) -> str:
    arms = [_scalar_findings(d, rel, th), _item_findings(d, rel, th), _echo_findings(d, rel, th), _run_findings(d, rel, th), _escalation_findings(d, rel, th), _voice_findings(d, rel)]
    return _rounded(arms)


def _documents(d: Dialect, by: str = "source") -> str:
    return f"(SELECT {by} AS manuscript_id, {d.text('doc_id')} AS chapter, doc_id AS ord, text AS raw FROM documents WHERE text IS NOT NULL)"


@plan("A1 A2 A3 A4 A5 A6 A7 A9 A10 A11 A12 A14 A15 A16 A37 U6 W1 W2 W13 J13 K1")
def lint_findings(d):
    """Findings of all documents, each source a manuscript."""
    return findings(d, _documents(d), thresholds())


@plan("A1 A37 U6 C1")
def lint_chapters(d):
    """Findings of the fixture's chapters under the historical profile."""
    return findings(d, chapters(d), thresholds("historical", {"local_density_min_words": 20}))


@plan("W10 A8 J15 FL2 FL5")
def maximal_repeats(d):
    return repeats(d, _documents(d, 'lang'), thresholds() | {"ngram_per_10k": 1.0})


@plan("O3 W10")
def worst_repeats(d):
    """The 25 repeats with the largest count times squared length."""
    return f"SELECT manuscript_id, phrase, n, n * len * len AS damage FROM ({repeats(d, _documents(d, 'lang'), thresholds() | {'ngram_per_10k': 1.0})}) x ORDER BY n * len * len DESC, manuscript_id, phrase LIMIT 25"
