"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_texts import PHRASES, SENTENCES, WHOLE

#: Words of a gram: base phrases may have two words only; so short a gram would let "of the" vote for a license.
PHRASE_GRAM, GRAM = 2, 5
#: Diagonals this far apart belong to one copy of a template; share of its words that a copy must hold, and how much
#: longer than the template it may be.
NEIGHBOURS, SHARE, STRETCH = 3, 0.8, 1.5

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def word_array(text: Column) -> Column:
    return F.filter(F.split(lowered(text), _SEPARATORS), lambda w: w != "")


def template_words(phrases: dict[str, str] = PHRASES, texts: dict[str, str] = SENTENCES | WHOLE) -> list[tuple[int, str, bool, int, list[str]]]:
    """(template, label, base, gram length, words) of the base phrases and of the license texts."""
    split = lambda text: re.findall("[a-z0-9]+", text.lower())
    listed = [(label, True, PHRASE_GRAM, split(p)) for p, label in phrases.items()] + [(label, False, GRAM, split(t)) for label, t in texts.items()]
    return [(i, *row) for i, row in enumerate(listed)]


def template_grams(spark, templates: list[tuple[int, str, bool, int, list[str]]]) -> DataFrame:
    """A row for each gram of a template: as many as the templates have words, whatever the corpus holds."""
    rows = [(t, label, base, k, len(w), p, " ".join(w[p : p + k])) for t, label, base, k, w in templates for p in range(len(w) - k + 1)]
    rows.append((-1, "", False, 0, 0, 0, ""))  # the row that stands for a document
    made = spark.createDataFrame(rows, "template int, label string, base boolean, k int, length int, place int, gram string")
    return made.withColumn("hash", F.xxhash64("k", F.split("gram", " ")))


def scan(docs: DataFrame, templates: list[tuple[int, str, bool, int, list[str]]] | None = None, share: float = SHARE) -> DataFrame:
    """License phrases and texts in whole documents.

    Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII.  Rolling grams of words
    (two for base phrases, five for license texts) are hashed and joined with the templates' grams, and the
    words of equal hashes compared; a match votes for its diagonal, the word's place less the template's.  A
    phrase stands where one diagonal holds all its grams.  A text's neighbouring diagonals are merged, so that
    a few words more or less do not part a copy; the merged span is verified by the distinct template words
    that its matches cover: ``share`` of them at least, within ``STRETCH`` times the template's length.

    A null text is empty; one without words has no hit.  Repeated rows are rows of their own.  Returns a row
    for each input row: doc_id (null stays null), n_words, n_base, first_word, last_word, base_labels,
    labels, score (the best share of a template found) and n_spans.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, template_words() if templates is None else templates)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), word_array(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    # an empty word in front stands for the document, so that one without hits stays; words beside their followers
    lined = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), F.col("words")).alias("line"))
    after = [F.slice("line", j + 1, F.greatest(F.size("line") - j, F.lit(0))).alias(f"w{j}") for j in range(GRAM)]
    placed = lined.select("rid", "doc_id", "n_words", F.posexplode(F.arrays_zip(*after)).alias("pos", "z")).select("rid", "doc_id", "n_words", "pos", "z.*")
    gram = lambda k: F.array(*(F.col(f"w{j}") for j in range(k)))
    kind = lambda k: F.struct(F.lit(k).alias("k"), F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), gram(k))).alias("hash"))
    mark = F.struct(F.lit(0).alias("k"), F.xxhash64(F.lit(0), F.array(F.lit(""))).alias("hash"))
    keys = F.when(F.col("pos") == 0, F.array(mark)).otherwise(F.array(kind(PHRASE_GRAM), kind(GRAM)))
    keyed = placed.select("*", F.explode(keys).alias("key")).select("rid", "doc_id", "n_words", "pos", *(f"w{j}" for j in range(GRAM)), "key.*")
    said = F.when(F.col("k") == GRAM, F.concat_ws(" ", gram(GRAM))).when(F.col("k") == PHRASE_GRAM, F.concat_ws(" ", gram(PHRASE_GRAM))).otherwise(F.lit(""))
    votes = keyed.join(F.broadcast(grams), ["k", "hash"]).where(said == F.col("gram"))
    # on one diagonal each place of the template votes once at most
    names = ["rid", "doc_id", "n_words", "template", "label", "base", "length", "k"]
    diagonals = votes.withColumn("diagonal", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("pos") - 1 - F.col("place")).cast("long")).groupBy(*names, "diagonal").agg(F.collect_list("place").alias("places"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    opens = F.when(F.col("base") | (F.col("k") == 0), F.lit(1)).otherwise((F.col("diagonal") - F.lag("diagonal", 1, -(1 << 40)).over(order) > NEIGHBOURS).cast("int"))
    runs = diagonals.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p, p + F.greatest(F.col("k"), F.lit(1)) - 1)))))
    spans = (
        runs.groupBy(*names, "run")
        .agg(covered.alias("covered"), F.min("diagonal").alias("diagonal"), F.min(F.col("diagonal") + F.array_min("places")).alias("first"), F.max(F.col("diagonal") + F.array_max("places") + F.col("k")).alias("past"))
        .withColumn("held", F.when(F.col("k") > 0, F.col("covered") / F.col("length")).otherwise(F.lit(0.0)))
        .withColumn("good", F.when(F.col("base"), F.col("covered") == F.col("length")).otherwise((F.col("k") > 0) & (F.col("held") >= share) & (F.col("past") - F.col("first") <= STRETCH * F.col("length"))))
    )
    base = F.col("good") & F.col("base")
    joined = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        spans.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("good")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("good"), F.col("held"))), F.lit(0.0)).alias("score"),
            F.count(F.when(F.col("good"), 1)).alias("n_spans"),
        )
        .drop("rid")
    )
