"""Text expressions written once and rendered for Spark or for DuckDB.

Spark's regular expressions are Java's, DuckDB's are RE2's: word characters, lookbehind and replacement
references differ, so every expression that needs them is rendered here and nowhere else.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
#: A word with inner hyphens and straight apostrophes.
LINT_TOKEN = WORD + r"(?:[\p{L}\p{N}_'-]*" + WORD + ")?"
#: Ends of sentences, with closing quotes and without, and of paragraphs.
END, LINT_END, PARAGRAPH_END = r"""([.!?])["'”’\s]+""", r"([.!?])\s+", r"\n\s*\n"


class Dialect:
    """Renderer of one engine."""

    def __init__(self, spark: bool, given: dict[str, str] | None = None) -> None:
        self.spark = spark
        #: Relations that a caller gives, by the name that plans know them by.
        self.given = given or {}
        #: Relations that a plan asked for, with their columns.
        self.asked: dict[str, str] = {}

    # literals
    def lit(self, text: str) -> str:
        if self.spark:
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + text.replace("'", "''") + "'"

    def values(self, rows: list[tuple], names: str) -> str:
        """An inline relation, the same rows on either engine."""

        def cell(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, str):
                return self.lit(v)
            if isinstance(v, float):
                return f"CAST({v!r} AS DOUBLE)"
            return f"CAST({v} AS BIGINT)"

        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS fixture({names}))"

    def table(self, name: str, rows: list[tuple], names: str) -> str:
        """The relation that the caller gives under ``name``; without one, the inline rows."""
        self.asked[name] = names
        return f"(SELECT {names} FROM {self.given[name]})" if name in self.given else self.values(rows, names)

    # regular expressions
    def all_of(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def bounded(self, x: str) -> str:
        """A text for counting patterns of ASCII letters between word boundaries.

        Java's ``\\b`` knows all letters and digits, and marks above them; RE2's knows those of ASCII alone and would find a
        word inside "ñdollar". For it, the others stand as underscores; a vertical tab, a blank of Java's only, as a blank.
        """
        if self.spark:
            return x
        marked = self.sub(f"replace({x}, chr(11), ' ')", r"([\p{L}\p{Nd}])\p{Mn}+", "\\1_")
        return self.sub(marked, r"[^\P{L}A-Za-z]|[^\P{Nd}0-9]", "_")

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})" if self.spark else f"regexp_matches({x}, {self.lit(pattern)})"

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def sub(self, x: str, pattern: str, replacement: str) -> str:
        """Replaces every match; ``\\1`` refers to a group."""
        if self.spark:
            return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(replacement.replace(chr(92), '$'))})"
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(replacement)}, 'g')"

    # arrays
    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)" if self.spark else f"CAST(len({a}) AS BIGINT)"

    def map(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {var} -> {body})" if self.spark else f"list_transform({a}, lambda {var}: {body})"

    def keep(self, a: str, var: str, body: str) -> str:
        return f"filter({a}, {var} -> {body})" if self.spark else f"list_filter({a}, lambda {var}: {body})"

    def at(self, a: str, i: str) -> str:
        """Element by place from 1 or, if negative, from the end; null outside."""
        return f"try_element_at({a}, CAST({i} AS INT))" if self.spark else f"list_extract({a}, {i})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.lit(by)})" if self.spark else f"array_to_string({a}, {self.lit(by)})"

    def sorted_set(self, x: str) -> str:
        return f"sort_array(collect_set({x}))" if self.spark else f"list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL))"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})" if self.spark else f"list_distinct({x})"

    def spread(self, source: str, keep: str, array: str, pos: str = "pos", val: str = "val") -> str:
        """Rows of an array with their place from 0.

        The outer view keeps the optimizer from inferring a test of the array's size, which it would push down to the
        scan and write out there: texts would be cut into words once for each use of the array in that test.
        """
        if self.spark:
            return f"(SELECT {keep}, CAST({pos} AS BIGINT) AS {pos}, {val} FROM {source} LATERAL VIEW OUTER posexplode({array}) spread_view AS {pos}, {val} WHERE {pos} IS NOT NULL)"
        return f"(SELECT {keep}, CAST(unnest(range(len({array}))) AS BIGINT) AS {pos}, unnest({array}) AS {val} FROM {source})"

    def number(self, x: str, kind: str) -> str:
        return f"TRY_CAST({x} AS {kind})"

    def chars(self, x: str) -> str:
        return f"CAST(length({x}) AS BIGINT)"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def best(self, value: str, by: str, most: bool = True) -> str:
        name = ("max_by" if most else "min_by") if self.spark else ("arg_max" if most else "arg_min")
        return f"{name}({value}, {by})"

    # text: projections
    def strip_comments(self, x: str) -> str:
        return self.sub(x, r"(?s)<!--.*?-->", "")

    def strip_markdown(self, x: str) -> str:
        flags = "(?dm)" if self.spark else "(?m)"
        return self.sub(self.sub(self.strip_comments(x), flags + r"^#.*$", ""), flags + r"^\s*>.*$", "")

    def tokens(self, x: str) -> str:
        """Words with inner hyphens and straight or curly apostrophes, lower-cased.

        Lower case goes letter by letter but for a capital sigma, which looks at its neighbours, and a dotted capital I,
        which becomes two characters: on Spark, only texts that hold one are lower-cased word by word.
        """
        pattern = WORD + r"(?:[\p{L}\p{N}_'’-]*" + WORD + ")?"
        if self.spark:
            return self.let(x, "t", f"CASE WHEN contains(t, 'Σ') OR contains(t, 'İ') THEN {self.map(self.all_of('t', pattern), 'w', 'lower(w)')} ELSE {self.all_of('lower(t)', pattern)} END")
        return self.map(self.all_of(x, pattern), "w", "lower(w)")

    def n_tokens(self, x: str) -> str:
        """How many words ``tokens`` gives: on Spark their case does not matter."""
        return self.count(x, WORD + r"(?:[\p{L}\p{N}_'’-]*" + WORD + ")?") if self.spark else self.size(self.tokens(x))

    def let(self, x: str, name: str, body: str) -> str:
        """Spark's ``body`` with ``name`` for an expression that it uses more than once."""
        return f"element_at(transform(array({x}), {name} -> {body}), 1)"

    def lint_tokens(self, x: str) -> str:
        """Words with inner hyphens and straight apostrophes: a curly one parts a word."""
        return self.all_of(x, LINT_TOKEN)

    def _cut(self, x: str, ends: str) -> str:
        mark = "\x1e"
        parts = f"split({self.sub(x, ends, chr(92) + '1' + mark)}, {self.lit(mark)})" if self.spark else f"string_split({self.sub(x, ends, chr(92) + '1' + mark)}, {self.lit(mark)})"
        return self.keep(self.map(parts, "s", f"{self.trim('s')}"), "s", "s <> ''")

    def whole_parts(self, x: str, ends: str) -> str:
        """Spark: the parts that ``_cut`` gives, not trimmed; a part that is not blank is one that holds anything but blanks."""
        mark = "\x1e"
        return self.keep(f"split({self.sub(x, ends, chr(92) + '1' + mark)}, {self.lit(mark)})", "s", self.has("s", r"\S"))

    def trim(self, x: str) -> str:
        return self.sub(x, r"^\s+|\s+$", "")

    def sentences(self, x: str) -> str:
        """Sentences; closing quotes go with the break."""
        return self._cut(x, END)

    def lint_sentences(self, x: str) -> str:
        return self._cut(x, LINT_END)

    def paragraphs(self, x: str, by: str = PARAGRAPH_END) -> str:
        return self._cut(x, f"()(?:{by})")

    def lines(self, x: str) -> str:
        return f"split({x}, {self.lit(chr(10))})" if self.spark else f"string_split({x}, {self.lit(chr(10))})"

    def syllables(self, w: str) -> str:
        return f"greatest({self.count(w, '[aeiouy]+')} - CASE WHEN {w} LIKE '%e' THEN 1 ELSE 0 END, 1)"

    def line_syllables(self, line: str) -> str:
        """Spark: the sum of ``syllables`` over lower-case words that stand in a line with a blank before, between and behind them.

        All groups of vowels count, less one for each word that ends with e; words that would come to none count one:
        those without vowels, and those whose only vowels are at their end, the last an e.
        """
        ends = f"CAST((length({line}) - length(replace({line}, 'e ', ''))) / 2 AS BIGINT)"
        return f"({self.count(line, '[aeiouy]+')} - {ends} + {self.count(line, ' (?! )[^aeiouy ]*+(?:[aeiouy]*e)?(?= )')})"

    def days(self, x: str) -> str:
        """A duration such as 3d, 2w, 1.5m, 4y or a bare number, in days."""
        number = self.number(self.first(x, r"^(-?[0-9]+(?:\.[0-9]+)?)[dwmy]?$", 1), "DOUBLE")
        return f"({number} * CASE {self.first(x, '[dwmy]$')} WHEN 'w' THEN 7.0 WHEN 'm' THEN 30.44 WHEN 'y' THEN 365.25 ELSE 1.0 END)"

    def field(self, line: str, key: str) -> str:
        """The value of ``key=value`` or ``key="quoted"`` in a flat record, null if absent."""
        pattern = r"(?:^|\s)" + key + r'=(?:"((?:[^"\\]|\\.)*)"|(\S+))'
        return f"nullif(concat({self.first(line, pattern, 1)}, {self.first(line, pattern, 2)}), '')"

    def flatten(self, a: str) -> str:
        return f"flatten({a})"

    def total(self, a: str) -> str:
        """Sum of an array of doubles, 0 if it is empty."""
        return f"aggregate({a}, CAST(0 AS DOUBLE), (acc, x) -> acc + x)" if self.spark else f"coalesce(list_sum({a}), 0)"

    def struct(self, fields: dict[str, str]) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def text(self, x: str) -> str:
        return f"CAST({x} AS {'STRING' if self.spark else 'VARCHAR'})"

    def ngrams(self, a: str, n: int, marks: str = "", least: int = 0) -> str:
        """Runs of ``n`` neighbouring elements joined by blanks; ``a`` names a column of words.

        Where ``marks`` names a column of numbers beside them, a run with a sum under ``least`` is null.
        """
        if self.spark:
            # neighbours stand in one struct: an array indexed inside the lambda could be made anew for every element
            aside = lambda c: [c, *(f"slice({c}, {j + 1}, size({c}))" for j in range(1, n))]
            zipped = f"slice(arrays_zip({', '.join(aside(a) + (aside(marks) if marks else []))}), 1, greatest(size({a}) - {n - 1}, 0))"
            words, numbers = [f"x.`{k}`" for k in (a, *range(1, n))], [f"x.`{k}`" for k in (marks, *range(n + 1, 2 * n))]
        else:
            zipped = f"list_slice({a}, 1, len({a}) - {n - 1})"
            words, numbers = ["x", *(f"{a}[i + {j}]" for j in range(1, n))], [f"{marks}[i + {j}]" for j in range(n)]
        run = "concat(" + ", ' ', ".join(words) + ")"
        if marks:
            run = f"CASE WHEN {' + '.join(numbers)} >= {least} THEN {run} END"
        return f"transform({zipped}, x -> {run})" if self.spark else f"list_transform({zipped}, lambda x, i: {run})"

    def cut(self, a: str, first: str, last: str) -> str:
        """Elements from place ``first`` to ``last``, places from 1, both inside."""
        return f"slice({a}, CAST({first} AS INT), CAST(greatest({last} - ({first}) + 1, 0) AS INT))" if self.spark else f"list_slice({a}, {first}, {last})"

    def reverse(self, a: str) -> str:
        return f"reverse({a})" if self.spark else f"list_reverse({a})"

    def numbers(self, first: str, last: str) -> str:
        """Whole numbers from ``first`` to ``last``, none if ``last`` is less."""
        if self.spark:
            return f"CASE WHEN ({last}) >= ({first}) THEN sequence(CAST({first} AS INT), CAST({last} AS INT)) ELSE CAST(array() AS ARRAY<INT>) END"
        return f"range(CAST({first} AS INT), CAST({last} AS INT) + 1)"

    def shared(self, a: str, b: str) -> str:
        """Length of the common beginning of two arrays."""
        least = f"least({self.size(a)}, {self.size(b)})"
        odd = self.keep(self.numbers("1", least), "i", f"{self.at(a, 'i')} <> {self.at(b, 'i')}")
        return f"coalesce({self.at(odd, '1')} - 1, {least})"


SPARK, DUCK = Dialect(True), Dialect(False)
