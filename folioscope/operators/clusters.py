"""Greedy clusters of spellings: the most frequent spelling claims its neighbours, and a claimed one claims none."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import lexicons as lx

#: Spellings of a manuscript that the first rounds settle among themselves, in one small group each.
PREFIXES = (64, 256, 1024, 4096)
#: Heads up to which the others are held against a manuscript's heads one by one; more heads meet them by their deletions.
FEW = 256

_LOCAL: dict[str, str] = {}


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="folioscope-"))


class _Tables:
    """Tables between rounds in the shared folder: those that later rounds do not read go at once."""

    def __init__(self, like: DataFrame) -> None:
        self.spark, self.folder = like.sparkSession, _folder(like)
        self.paths: dict[str, DataFrame] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/clusters-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[path] = self.spark.read.schema(df.schema).parquet(path)
        return self.paths[path]

    def temporary(self, kept: list[DataFrame]) -> list[str]:
        return [p for p, frame in self.paths.items() if not any(frame is k for k in kept)]

    def drop(self, paths: list[str]) -> None:
        for path in paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):  # what is left over is the folder's cleaner's
                target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
            del self.paths[path]


def _deletions(words: DataFrame, most: int) -> DataFrame:
    """What is left of each spelling when up to ``most`` of its letters go: spellings within the distance share one of them.

    Letters go from the left to the right, one step for each, so a spelling of ``L`` letters has about ``L**most / most!``
    rows; nothing is too short to take part.  No letter goes that equals the one kept before it, so each rest comes once:
    of a run of one letter, whichever of its letters go leaves the same.
    """
    left = words.select("*", F.col("low").alias("rest"), F.lit(0).alias("gone"), F.lit(0).alias("at"))
    layers = [left]
    for _ in range(most):
        left = left.where(F.length("rest") > F.col("at")).select(*words.columns, "rest", "gone", F.explode(F.sequence(F.col("at"), F.length("rest") - 1)).alias("at"))
        left = left.where("at = 0 OR substring(rest, at, 1) <> substring(rest, at + 1, 1)")
        left = left.select(*words.columns, F.expr("concat(substring(rest, 1, at), substring(rest, at + 2))").alias("rest"), (F.col("gone") + 1).alias("gone"), "at")
        layers.append(left)
    whole = layers[0]
    for layer in layers[1:]:
        whole = whole.unionByName(layer)
    return whole.select(*words.columns, "rest")


def _apart(a: str, b: str, most: int):
    return F.levenshtein(F.col(a), F.col(b), most).between(1, most)


def _near(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs of spellings (``low``) and others (``other_low``) of one manuscript within the distance, by their deletions."""
    a = _deletions(left.select("manuscript_id", "low").distinct(), most)
    b = _deletions(right.select("manuscript_id", "low").distinct(), most).select("manuscript_id", F.col("low").alias("other_low"), "rest")
    # a spelling's deletions are many times its size, which estimates made of the spellings do not see: they are never broadcast
    met = a.join(b.hint("merge"), ["manuscript_id", "rest"]).where((F.abs(F.length("low") - F.length("other_low")) <= most)).select("manuscript_id", "low", "other_low").distinct()
    return met.where(_apart("low", "other_low", most))


def _pick(part: pd.DataFrame) -> pd.DataFrame:
    """Heads among the first spellings of a manuscript: those that no head before them claims."""
    near: dict[str, set[str]] = {}
    for low, other in zip(part["low"], part["other_low"], strict=True):
        if other is not None and not pd.isna(other):
            near.setdefault(low, set()).add(other)
    heads: list[tuple] = []
    blocked: set[str] = set()
    for row in part.drop_duplicates("word").sort_values(["n", "word"], ascending=[False, True]).itertuples(index=False):
        if row.low not in blocked:
            heads.append((row.manuscript_id, row.word, row.low, row.n))
            blocked |= near.get(row.low, set())
    return pd.DataFrame(heads, columns=["manuscript_id", "word", "low", "n"])


def greedy_variants(counts: DataFrame, most: int = 3, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """manuscript_id, canonical, variants (sorted map entries of spelling and count), for clusters of two or more.

    ``counts`` has manuscript_id, word, n.  Spellings go by count, then alphabet; each one that is not claimed yet claims all
    unclaimed spellings at distance 1 to ``most``, case aside.  The rule looks like a loop over a manuscript, but its heads
    are the first maximal independent set in that order, and that is found in parallel (Blelloch, Fineman and Shun, 2012):

    * the first spellings of each manuscript, in groups of a fixed size (``prefixes``), are settled among themselves, and the
      heads that this gives claim their neighbours among all others.  Common short spellings, which are near to nearly all
      others, are settled here while the heads are few, so that their pairs are never listed;
    * of what outlives them, all pairs are listed, and every spelling without an earlier undecided neighbour is a head, in
      rounds, until none is left.

    Spellings meet by what is left of them when up to ``most`` letters are deleted; none is too short.  Spellings that differ in
    case alone are distance 0 and never claim each other.  Null words are left out.
    """
    tables = _Tables(counts)
    kinds = {"manuscript_id": "string", "word": "string", "n": "long"}
    rest = tables.write(counts.where("word IS NOT NULL").select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), F.lower("word").alias("low")))
    order = Window.partitionBy("manuscript_id").orderBy(F.desc("n"), "word")
    claimed = []

    def settle(met: DataFrame, heads: DataFrame) -> None:
        """Claimed spellings with their heads, and the heads that claimed any."""
        own = heads.join(met.select("manuscript_id", F.col("head").alias("word")).distinct(), ["manuscript_id", "word"], "left_semi").select("manuscript_id", "word", "n", F.col("word").alias("head"))
        claimed.append(tables.write(met.select("manuscript_id", "word", "n", "head").unionByName(own)))

    for reach in prefixes:
        if rest.isEmpty():
            break
        before = tables.temporary(claimed)
        first = tables.write(rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= reach).drop("place"))
        heads = tables.write(first.join(_near(first, first, most), ["manuscript_id", "low"], "left").groupBy("manuscript_id").applyInPandas(_pick, "manuscript_id string, word string, low string, n long"))
        others = rest.join(heads.select("manuscript_id", "word"), ["manuscript_id", "word"], "left_anti")
        if reach <= FEW:
            listed = heads.groupBy("manuscript_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word"), F.col("low")))).alias("heads"))
            near_head = F.get(F.filter("heads", lambda h: F.levenshtein(F.col("low"), h["low"], most).between(1, most)), 0)["word"]
            met = others.join(listed, "manuscript_id").withColumn("head", near_head).where("head IS NOT NULL").drop("heads")
        else:
            near = _near(others, heads, most)
            rank = F.struct((-F.col("n")).alias("less"), F.col("word"))
            best = near.join(heads.select("manuscript_id", F.col("low").alias("other_low"), "word", "n"), ["manuscript_id", "other_low"]).groupBy("manuscript_id", "low").agg(F.min(rank)["word"].alias("head"))
            met = others.join(best.hint("merge"), ["manuscript_id", "low"])
        met = tables.write(met.select("manuscript_id", "word", "n", "head"))
        settle(met, heads)
        rest = tables.write(others.join(met.select("manuscript_id", "word").hint("merge"), ["manuscript_id", "word"], "left_anti"))
        tables.drop(before)
    if not rest.isEmpty():
        near = _near(rest, rest, most)
        a, b = rest.select("manuscript_id", "low", "word", "n"), rest.select("manuscript_id", F.col("low").alias("other_low"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        earlier = (F.col("other_n") > F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other") < F.col("word")))
        edges = tables.write(near.join(a.hint("merge"), ["manuscript_id", "low"]).join(b.hint("merge"), ["manuscript_id", "other_low"]).where(earlier).select("manuscript_id", "word", "n", "other", "other_n"))
        left, lost = edges.select("manuscript_id", "word", "other"), []
        while not left.isEmpty():
            before = tables.temporary([*claimed, *lost, edges, rest])
            waiting = left.select("manuscript_id", "word").distinct()
            heads = left.select("manuscript_id", "other").distinct().join(waiting.withColumnRenamed("word", "other"), ["manuscript_id", "other"], "left_anti")
            gone = tables.write(left.join(heads, ["manuscript_id", "other"]).select("manuscript_id", "word").distinct())
            lost.append(gone)
            # what is claimed makes nobody wait any longer; by whom it is claimed is seen when all heads are known
            left = tables.write(left.join(gone, ["manuscript_id", "word"], "left_anti").join(gone.withColumnRenamed("word", "other"), ["manuscript_id", "other"], "left_anti").select("manuscript_id", "word", "other"))
            tables.drop(before)
        if lost:
            gone = lost[0]
            for more in lost[1:]:
                gone = gone.unionByName(more)
            by_heads = edges.join(gone.withColumnRenamed("word", "other"), ["manuscript_id", "other"], "left_anti")
            settle(by_heads.groupBy("manuscript_id", "word", "n").agg(F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))["other"].alias("head")), rest)
    if not claimed:
        return counts.sparkSession.createDataFrame([], "manuscript_id string, canonical string, variants string")
    whole = claimed[0]
    for part in claimed[1:]:
        whole = whole.unionByName(part)
    shown = F.struct("word", F.concat("word", F.lit(":"), F.col("n").cast("string")).alias("shown"))
    return whole.groupBy("manuscript_id", F.col("head").alias("canonical")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["shown"]), ",").alias("variants"))


def capitalised(chapters: DataFrame, least: int = 3) -> DataFrame:
    """Counts of capitalised words, ``least`` times or more in a manuscript, comments and headings left out."""
    text = F.regexp_replace(F.regexp_replace("raw", r"(?s)<!--.*?-->", ""), r"(?m)^#.*$", "")
    found = chapters.select("manuscript_id", F.explode(F.regexp_extract_all(text, F.lit(r"\b([A-Z][\p{L}'’-]{2,})"), F.lit(1))).alias("word"))
    return found.groupBy("manuscript_id", "word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & ~F.lower("word").isin(lx.FUNCTION_WORDS))
