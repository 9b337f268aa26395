"""Quality rules: lines are judged first, then what their removal leaves of the document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value of the base rules.
SYMBOLS = "[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]"
#: Page furniture in the corpus's languages and Spanish, as phrases: one of their words alone may stand in prose.
BOILERPLATE = (
    r"(?i)(accept (all )?cookies|uses? cookies|cookie (policy|settings|preferences)|enable javascript|javascript (is|must be) (disabled|required|enabled)"
    r"|all rights reserved|terms of (use|service)|terms and conditions|privacy policy|sign up (now|for|to|here)|log ?in (to|or|here)|subscribe (to|now|here)|click here|read more|skip to (main )?content|back to top|share (this|on) |lorem ipsum"
    r"|alle rechte vorbehalten|datenschutzerklärung|cookie-einstellungen|allgemeine geschäftsbedingungen|nutzungsbedingungen|jetzt (anmelden|registrieren)|hier klicken|mehr lesen|zum seitenanfang"
    r"|tous droits réservés|politique de confidentialité|mentions légales|conditions (générales )?d'utilisation|cliquez ici|lire la suite|inscrivez-vous|retour en haut|accepter les cookies"
    r"|todos los derechos reservados|política de privacidad|aviso legal|haga clic aquí|leer más|iniciar sesión|aceptar (las )?cookies)"
)
SEPARATOR = BLANK + "[|>»·•/]" + BLANK
SENTENCE_MARK = "[.!?:;…。！？]"
RULES = ["navigation", "symbols", "punctuation", "capitals", "repeats", "boilerplate"]


def line_rules(lines: pa.Array, words: common.Words) -> np.ndarray:
    """Which of ``RULES`` (columns) each line breaks; a line without a word breaks none."""
    n = np.diff(words.starts)
    counted = lambda pattern: pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    holds = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    apart, marks = counted(SEPARATOR), counted(SYMBOLS)
    rows = common.rows_of(words.starts)
    pairs = np.unique(rows * np.int64(max(1, len(words.vocab))) + words.codes)
    distinct = np.bincount(pairs // max(1, len(words.vocab)), minlength=len(n))
    shouted = 3 * counted("[!?]") > n
    broken = np.column_stack([
        (apart >= 3) & (6 * apart >= n),
        (marks >= 3) & (4 * marks > n),
        ((n >= 4) & shouted) | ((n >= 20) & ~holds(SENTENCE_MARK)),
        (n >= 4) & holds(r"\p{Lu}") & ~holds(r"\p{Ll}"),
        (n >= 20) & (3 * distinct < n),
        (n <= 20) & holds(BOILERPLATE),
    ])
    return broken & (n > 0)[:, None]


def _measure(batches: Iterator[pa.RecordBatch], most_lost: int) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        texts, m = pc.fill_null(common.as_array(part.column("text")), ""), part.num_rows
        words = common.words_of(texts, common.BLANK_SPLIT)
        n_words, repeats = np.diff(words.starts), _repeat_words(words)
        lists = pc.split_pattern(texts, "\n")
        lines, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        spoken = common.words_of(lines, common.BLANK_SPLIT)
        size, row = np.diff(spoken.starts), common.rows_of(ends.astype(np.int64))
        bad = line_rules(lines, spoken).any(axis=1)
        per_row = lambda values, w=None: np.bincount(values, weights=w, minlength=m).astype(np.int64)
        full = size > 0
        coded = pc.dictionary_encode(lines)
        distinct = np.unique(row[full] * np.int64(max(1, len(coded.dictionary))) + coded.indices.to_numpy()[full])
        n_lines, n_bad, lost = per_row(row[full]), per_row(row[bad]), per_row(row[bad], size[bad])
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        clean = texts.to_pylist()
        for r in np.flatnonzero(n_bad).tolist():
            own = range(ends[r], ends[r + 1])
            clean[r] = "\n".join(lines[i].as_py() for i in own if not bad[i])
        blanks = pc.count_substring_regex(texts, BLANK).to_numpy(zero_copy_only=False)
        made = [
            part.column("doc_id"), pa.array(n_words), pa.array((pc.utf8_length(texts).to_numpy(zero_copy_only=False) - blanks).astype(np.int64)),
            pa.array(pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)),
            pa.array(n_lines - per_row(distinct // max(1, len(coded.dictionary)))), pa.array(repeats), pa.array(failed),
            pa.array(~failed & (100 * lost <= most_lost * n_words)), pa.array(n_lines), pa.array(n_bad), pa.array(lost), pa.array(clean, pa.string()),
        ]
        more = part.schema.names[2:]
        yield pa.RecordBatch.from_arrays([*made, *(part.column(c) for c in more)], names=[*(c.split()[0] for c in COLUMNS.split(", ")), *more])


def _repeat_words(words: common.Words) -> np.ndarray:
    """Words of each row in windows of three words that the row holds twice or more."""
    fits = np.flatnonzero(common.in_row(words.starts, 3))
    rows = common.rows_of(words.starts)
    if not len(fits):
        return np.zeros(len(words.starts) - 1, np.int64)
    c = words.codes
    order = fits[np.lexsort((c[fits + 2], c[fits + 1], c[fits], rows[fits]))]
    a, b = order[:-1], order[1:]
    same = (rows[a] == rows[b]) & (c[a] == c[b]) & (c[a + 1] == c[b + 1]) & (c[a + 2] == c[b + 2])
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    hit = np.zeros(len(c), bool)
    for j in range(3):
        hit[twice + j] = True
    return np.bincount(rows[hit], minlength=len(words.starts) - 1)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_bad_lines long, n_lost_words long, clean_text string"


def judge(docs: DataFrame, most_lost: int = 50) -> DataFrame:
    """Measures whole texts, removes the lines that break a rule, and rejects documents that lose too much.

    Words are runs of anything but space and U+0009-U+000D; lines are what ``\\n`` separates.  A line fails as
    navigation (three separators or more, one for six words), symbols (over one for four words), punctuation (shouted, or
    20 words and more without any sentence mark), capitals, repeats (20 words and more, under a third of them distinct)
    or boilerplate (page furniture in at most 20 words).  ``kept`` is false for ``base_failed`` documents and for those
    that lose over ``most_lost`` per cent of their words.  A null or blank text has no words and fails the base rules;
    repeated rows are rows of their own.  Returns a row for each input row, with doc_id (null stays null), the measures,
    and clean_text: the text without failing lines.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(lambda it: _measure(it, most_lost), COLUMNS)


def clean(docs: DataFrame, most_lost: int = 50) -> DataFrame:
    """Documents that :func:`judge` keeps, less their failing lines, in the columns of ``docs``.

    ``n_chars`` follows the text where the table has it; all other columns pass unchanged.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.rest_of(docs))
    rows = picked.mapInArrow(lambda it: _measure(it, most_lost), common.with_rest(COLUMNS, docs))
    return common.unpacked(rows.where("kept"), docs, text=F.col("clean_text"), n_chars=F.length("clean_text").cast("long"))
