"""Sources: chapters, flat records, two-level YAML, reader evidence, profiles, imports, EPUB archives.

Bad input never raises: it comes back as rows that carry an error. Empty folders of a readable path give empty relations.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANONICAL = r"^chapter-(\d+)\.md$"
PAIR = r'(\w+)=("(?:[^"\\]|\\.)*"|\S+)'


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r'^"(.*)"$', "$1"), r'\\(["\\])', "$1")


def chapters(spark: SparkSession, path: str, glob: str = "*.md", canonical: bool = False) -> DataFrame:
    """One row per file: manuscript_id (its folder), chapter (file name, which is the order), ord, chapter_no, raw.

    ``canonical`` keeps chapter-N.md only. Glob "*.{md,txt}" reads a corpus.
    """
    found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("manuscript_id"), F.col("_metadata.file_name").alias("chapter"), F.col("value").alias("raw")
    )
    found = found.filter(F.col("chapter").rlike(CANONICAL)) if canonical else found
    return found.select("manuscript_id", "chapter", F.col("chapter").alias("ord"), F.expr(f"try_cast(nullif(regexp_extract(chapter, r'{CANONICAL}', 1), '') as int)").alias("chapter_no"), "raw")


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered lines (from 1) of whole texts."""
    return texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("place", "content")).select(key, (F.col("place") + 1).alias("line"), "content")


def records(texts: DataFrame, kinds: dict[str, list[str]], key: str = "chapter", text: str = "raw") -> DataFrame:
    """Flat records ``kind k=v k="quoted"``: key, line, kind, fields (map), error (null: a good row).

    ``kinds`` gives the required fields by kind. Blank lines and lines from # are left out; an unknown kind, a missing
    field and an id that an earlier line of the same kind has are errors. The first of doubled fields counts.
    """
    rows = lines(texts, key, text).filter(~F.col("content").rlike(r"^\s*(#|$)"))
    names, values = (F.regexp_extract_all("content", F.lit(PAIR), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("key"), _unquoted(F.element_at(values, F.array_position(names, k).cast("int"))).alias("value")))
    rows = rows.select(key, "line", F.lower(F.regexp_extract("content", r"^\s*([A-Za-z_-]+)(?:\s|$)", 1)).alias("kind"), F.map_from_entries(pairs).alias("fields"))
    wanted = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]).cast("array<string>"))])
    lacking = F.array_except(F.try_element_at(wanted, F.col("kind")), F.map_keys("fields"))
    ident = F.try_element_at("fields", F.lit("id"))
    # An id may stand once within a file and kind; rows without one are told apart by their line.
    first = F.min("line").over(Window.partitionBy(key, "kind", F.coalesce(ident, F.concat(F.lit("\0"), F.col("line").cast("string")))))
    repeatable = F.col("kind").isin("once")
    error = F.when(F.try_element_at(wanted, F.col("kind")).isNull(), F.concat(F.lit("unknown record: "), F.col("kind"))).when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    error = error.when((F.col("first_line") < F.col("line")) & ~repeatable, F.concat(F.lit("id repeats that of line "), F.col("first_line").cast("string")))
    return rows.withColumn("first_line", first).withColumn("error", error).drop("first_line")


def report_meta(reports: DataFrame, key: str = "chapter", text: str = "raw") -> DataFrame:
    """Fields of the first ``meta k=v`` line of each report; an empty map where there is none."""
    line = F.regexp_extract(text, r"(?m)^\s*meta\s+(.*)$", 1)
    names, values = (F.regexp_extract_all(line, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("key"), _unquoted(F.element_at(values, F.array_position(names, k).cast("int"))).alias("value")))
    return reports.select(key, F.map_from_entries(pairs).alias("meta"))


def yaml_map(texts: DataFrame, key: str = "chapter", text: str = "raw") -> DataFrame:
    """Two-level YAML subset: key, line, block, name, value, is_item (an element of the list ``name``), error.

    Every value is a string. A value before any block and an item without a list are errors.
    """
    rows = lines(texts, key, text).filter(~F.col("content").rlike(r"^\s*(#|$)"))
    body, inner = F.trim("content"), F.col("content").startswith(" ")
    item = inner & body.startswith("- ")
    pair = inner & ~item
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    name, value = F.trim(F.regexp_extract("body", r"^([^:]*)", 1)), _unquoted(F.trim(F.regexp_extract("body", r"^[^:]*:(.*)$", 1)))
    rows = rows.select(key, "line", body.alias("body"), inner.alias("inner"), item.alias("item"), pair.alias("pair"))
    rows = rows.withColumn("block", F.last(F.when(~F.col("inner"), name), ignorenulls=True).over(w))
    opens = F.when(~F.col("inner"), F.lit("")).when(F.col("pair"), F.when(value == "", name).otherwise(F.lit("")))
    rows = rows.withColumn("list_name", F.last(opens, ignorenulls=True).over(w)).filter("inner")
    error = F.when(F.col("block").isNull(), F.lit("value before a block")).when(F.col("item") & (F.coalesce("list_name", F.lit("")) == ""), F.lit("item without a list"))
    error = error.when(F.col("pair") & ~F.col("body").contains(":"), F.lit("no colon"))
    return rows.select(
        key, "line", "block", F.when(F.col("item"), F.col("list_name")).otherwise(name).alias("name"),
        F.when(F.col("item"), _unquoted(F.trim(F.substring("body", 3, 1 << 30)))).otherwise(value).alias("value"), F.col("item").alias("is_item"), error.alias("error"),
    )


def scalar(yaml: DataFrame, path: str, key: str = "chapter") -> DataFrame:
    """Value of ``block.name``, or of the first ``name`` anywhere, in each file."""
    block, _, name = path.rpartition(".")
    hits = yaml.filter((F.col("name") == name) & ~F.col("is_item") & F.col("error").isNull())
    hits = hits.filter(F.col("block") == block) if block else hits
    return hits.groupBy(key).agg(F.min_by("value", "line").alias("value"))


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Reader evidence of CSV files: file, the five columns as text, typed chapter_no and rating_no, and error (null: valid)."""
    schema = "reader_id string, chapter string, rating string, comment string, delayed string"
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').withColumn("file", F.col("_metadata.file_name"))
    rows = rows.withColumn("chapter_no", F.expr("try_cast(trim(chapter) as int)")).withColumn("rating_no", F.expr("try_cast(trim(rating) as int)"))
    error = F.when(F.coalesce(F.trim("reader_id"), F.lit("")) == "", "no reader").when(F.col("chapter_no").isNull(), "no chapter").when(~F.coalesce(F.col("rating_no").between(1, 5), F.lit(False)), "rating not from 1 to 5")
    return rows.withColumn("late", F.lower(F.trim("delayed")).isin("1", "true", "yes")).withColumn("error", error)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Word profiles saved as JSON (name, total_words, frequencies): profile, total_words, word, rate."""
    saved = spark.read.schema("name string, total_words bigint, frequencies map<string,double>").json(path, multiLine=True)
    return saved.select(F.col("name").alias("profile"), "total_words", F.explode("frequencies").alias("word", "rate"))


def imports(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """Files of a folder with size, sha256 and verdict: adopted, wrong suffix, empty (blanks only), or duplicate of an earlier name.

    Spark's readers leave out files of no bytes at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"), (F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s+", " ")) == "").alias("blank"))
    first = F.min("file").over(Window.partitionBy("sha256"))
    fits = F.lower("file").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return files.withColumn("first_name", first).withColumn("verdict", F.when(~fits, "wrong suffix").when(F.col("blank"), "empty").when(F.col("first_name") < F.col("file"), "duplicate").otherwise("adopted")).drop("first_name", "blank")


def _epub_problems(content: bytes) -> list[str]:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names, problems, trees = book.namelist(), [], {}
        if names[:1] != ["mimetype"]:
            problems.append("mimetype is not first")
        elif book.getinfo("mimetype").compress_type != zipfile.ZIP_STORED or book.read("mimetype") != b"application/epub+zip":
            problems.append("mimetype is compressed or wrong")
        for name in (n for n in names if n.endswith((".xhtml", ".opf"))):
            try:
                trees[name] = ElementTree.fromstring(book.read(name))
            except ElementTree.ParseError as bad:
                problems.append(f"{name}: {bad}")
        package = trees.get("OEBPS/content.opf")
        if package is None:
            return [*problems, "no readable OEBPS/content.opf"]
        listed = {x.get("id"): x.get("href") for x in package.iter("{http://www.idpf.org/2007/opf}item")}
        problems += [f"missing file: {h}" for h in sorted(listed.values()) if f"OEBPS/{h}" not in names]
        spine = [x.get("idref") for x in package.iter("{http://www.idpf.org/2007/opf}itemref")]
        return problems + [f"unknown spine id: {i}" for i in spine if i not in listed]
    except (zipfile.BadZipFile, KeyError) as bad:
        return [f"cannot open: {bad}"]


def epub_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problems of each EPUB archive: file, problem; sound archives give no rows."""

    def check(content: pd.Series) -> pd.Series:
        return content.map(_epub_problems)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.explode(F.pandas_udf(check, "array<string>")("content")).alias("problem"))


def packs(spark: SparkSession, path: str) -> DataFrame:
    """Rule packs from CSV files with a header (pack, rule, pattern, most_per_1k): another file in the folder is another pack.

    Rows without a pack, rule or pattern, or with a limit that is no number, are left out.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("pack", "rule", "pattern", F.expr("try_cast(most_per_1k AS DOUBLE)").alias("most_per_1k")).where("pack IS NOT NULL AND rule IS NOT NULL AND pattern IS NOT NULL AND most_per_1k IS NOT NULL")
