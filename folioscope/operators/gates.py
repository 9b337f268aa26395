"""Gates: the checks that a manifest names are run over relations, and their results decide what a gate says.

Every check is a builder in ``CHECKS``: it takes the relations and what was asked of it, and gives statuses for all
manuscripts at once.  A check that fails to run becomes rows with status error and hides nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import lexicons as lx
from folioscope.functions.dialect import SPARK
from folioscope.operators import audits, markup
from folioscope.operators.clusters import _folder
from folioscope.operators.lint import over_frames
from folioscope.plans import checks as check_plans
from folioscope.plans import lint as lint_plans
from folioscope.plans import voices


@dataclass
class Relations:
    """What checks read; a relation that is not given is empty."""

    #: manuscript_id, chapter, ord, raw
    chapters: DataFrame
    #: manuscript_id, key, value: project.language, project.lint_profile, project.word_count_target, project.skip_human_pass
    settings: DataFrame | None = None
    #: manuscript_id, lineno, line: chronology and texture bank
    records: DataFrame | None = None
    bank: DataFrame | None = None
    #: manuscript_id, chapter_no, line: the chapters' own reports
    reports: DataFrame | None = None
    #: manuscript_id, who, never_say
    lexicon: DataFrame | None = None
    #: manuscript_id, name, raw: evaluation reports
    evaluations: DataFrame | None = None
    #: manuscript_id, title, author, language
    metas: DataFrame | None = None
    #: manuscript_id: those with a worksheet of the human pass
    worksheets: DataFrame | None = None

    def __post_init__(self) -> None:
        spark = self.chapters.sparkSession
        empty = {
            "settings": "manuscript_id string, key string, value string", "records": "manuscript_id string, lineno long, line string", "bank": "manuscript_id string, lineno long, line string", "reports": "manuscript_id string, chapter_no long, line string",
            "lexicon": "manuscript_id string, who string, never_say string", "evaluations": "manuscript_id string, name string, raw string", "metas": "manuscript_id string, title string, author string, language string", "worksheets": "manuscript_id string",
        }
        for f in fields(self)[1:]:
            if getattr(self, f.name) is None:
                setattr(self, f.name, spark.createDataFrame([], empty[f.name]))
        self.chapters = self.chapters.where("raw IS NOT NULL").select("manuscript_id", "chapter", "ord", "raw")
        self.counts = self.chapters.groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("chapters"))

    def setting(self, key: str, name: str) -> DataFrame:
        return self.settings.where(F.col("key") == key).groupBy("manuscript_id").agg(F.max(F.trim("value")).alias(name))


#: manuscript_id and args (array) in; manuscript_id, args, status and summary out.
Check = Callable[[Relations, DataFrame], DataFrame]
CHECKS: dict[str, Check] = {}


def check(run: Check) -> Check:
    CHECKS[run.__name__.removeprefix("check_")] = run
    return run


def _by(asked: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        asked = asked.join(part, "manuscript_id", "left")
    return asked


def _told(rows: DataFrame, *cases: tuple, rest: str = "pass") -> DataFrame:
    """The first case that holds: (condition, status, summary)."""
    status = summary = None
    for when, name, text in cases:
        told = F.struct(F.lit(name).alias("status"), (text if not isinstance(text, str) else F.lit(text)).cast("string").alias("summary"))
        status = F.when(when, told) if status is None else status.when(when, told)
    done = status.otherwise(F.struct(F.lit(rest).alias("status"), F.lit("").alias("summary")))
    return rows.withColumn("told", done).select("manuscript_id", "args", "told.status", "told.summary")


def _fails(found: DataFrame, only: str = "severity = 'fail'") -> DataFrame:
    return found.where(only).groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("n"))


def _none() -> tuple:
    return (F.col("chapters").isNull(), "skip", "no chapters")


def _foreign() -> tuple:
    return (~F.coalesce(F.lower("language"), F.lit("")).startswith("en") & (F.coalesce("language", F.lit("")) != ""), "skip", F.concat(F.lit("English only, not "), "language"))


def _failed(what: str) -> tuple:
    return (F.coalesce("n", F.lit(0)) > 0, "fail", F.concat(F.col("n").cast("string"), F.lit(f" {what}")))


@check
def check_timeline(r: Relations, asked: DataFrame) -> DataFrame:
    held = r.records.groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("lines"))
    rows = _by(asked, held, _fails(audits.timeline(r.records)))
    missing = F.col("lines").isNull()
    return _told(rows, (missing & F.array_contains("args", "required"), "fail", "no chronology"), (missing, "skip", "no chronology"), _failed("contradictions"))


@check
def check_lint(r: Relations, asked: DataFrame) -> DataFrame:
    """Each profile that is asked for, from the token, else from the settings, is run over its manuscripts; there are few profiles."""
    wanted = _by(asked.select("manuscript_id", "args"), r.setting("project.lint_profile", "set_profile"))
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(F.when(F.get("args", 0) != "", F.get("args", 0)), "set_profile", F.lit("")))), " fiction$", "")
    wanted = wanted.withColumn("profile", F.when(name.isin(list(lx.PROFILES)), name).otherwise(""))
    found = None
    # at most one row for each profile that there is
    for profile in sorted(p.profile for p in wanted.select("profile").distinct().collect()):
        # names of manuscripts, which are few beside their texts: those stay where they are read
        mine = r.chapters.join(F.broadcast(wanted.where(F.col("profile") == profile).select("manuscript_id").distinct()), "manuscript_id", "left_semi")
        one = _fails(over_frames(lint_plans.failures(SPARK, "chapters_to_check", lint_plans.thresholds(profile)), chapters=mine)).withColumn("profile", F.lit(profile))
        found = one if found is None else found.unionByName(one)
    rows = _by(wanted, r.counts, r.setting("project.language", "language"))
    rows = rows.withColumn("n", F.lit(None).cast("long")) if found is None else rows.join(found, ["manuscript_id", "profile"], "left")
    return _told(rows, _none(), _foreign(), _failed("lint failures"))


@check
def check_chapter_order(r: Relations, asked: DataFrame) -> DataFrame:
    number = F.expr("try_cast(nullif(regexp_extract(chapter, '([0-9]+)', 1), '') AS BIGINT)")
    order = Window.partitionBy("manuscript_id").orderBy("chapter")
    named = r.chapters.select("manuscript_id", "chapter", number.alias("no"))
    bare = named.where("no IS NULL").groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("bare"))
    late = named.withColumn("before", F.lag("no").over(order)).where("no <= before").groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("n"))
    return _told(_by(asked, r.counts, bare, late), _none(), (F.col("bare") > 0, "fail", F.concat("bare", F.lit(" names without a number"))), _failed("chapters out of order"))


@check
def check_wordcount(r: Relations, asked: DataFrame) -> DataFrame:
    words = r.chapters.groupBy("manuscript_id").agg(F.expr(f"sum({SPARK.n_tokens(SPARK.strip_comments('raw'))})").alias("words"))
    rows = _by(asked, r.counts, words, r.setting("project.word_count_target", "target")).withColumn("target", F.expr("try_cast(target AS DOUBLE)"))
    share = lambda i, usual: F.coalesce(F.when(F.get("args", i) != "", F.get("args", i)).cast("double"), F.lit(usual))
    off = ~F.col("words").between(F.col("target") * share(0, 0.85), F.col("target") * share(1, 1.25))
    return _told(rows, (F.coalesce("target", F.lit(0.0)) <= 0, "skip", "no target"), _none(), (off, "fail", F.concat(F.col("words").cast("string"), F.lit(" words"))))


@check
def check_proof(r: Relations, asked: DataFrame) -> DataFrame:
    return _told(_by(asked, r.counts, _fails(audits.proof(r.chapters))), _none(), _failed("typographic defects"))


@check
def check_macro(r: Relations, asked: DataFrame) -> DataFrame:
    few = (F.col("chapters") < lx.MACRO_CHAPTERS, "skip", "too few chapters")
    return _told(_by(asked, r.counts, r.setting("project.language", "language"), _fails(audits.macro(r.chapters), "true")), _none(), _foreign(), few, _failed("shared shapes"))


@check
def check_texture(r: Relations, asked: DataFrame) -> DataFrame:
    held = r.bank.groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("lines"))
    rows = _by(asked, held, _fails(audits.texture(r.bank, r.chapters), "true"))
    return _told(rows, (F.col("lines").isNull(), "skip", "no texture bank"), _failed("findings of the bank"))


@check
def check_human_pass(r: Relations, asked: DataFrame) -> DataFrame:
    spans = r.chapters.groupBy("manuscript_id").agg(F.sum(F.regexp_count("raw", F.lit(r"(?s)<!-- hp:start -->.*?<!-- hp:end -->"))).alias("spans"))
    sheet = r.worksheets.select("manuscript_id", F.lit(True).alias("sheet")).distinct()
    rows = _by(asked, r.counts, spans, sheet, r.setting("project.skip_human_pass", "skips"))
    wanted = F.coalesce(F.when(F.get("args", 0) != "", F.get("args", 0)).cast("double"), F.greatest(F.lit(1.0), F.ceil(F.col("chapters") / 4).cast("double")))
    return _told(rows, _none(), (F.lower("skips").isin("true", "1", "yes"), "pass", "skipped by the project"), (F.col("sheet").isNull(), "fail", "no worksheet"), (F.col("spans") < wanted, "fail", F.concat(F.col("spans").cast("string"), F.lit(" protected spans"))))


@check
def check_voice_lexicon(r: Relations, asked: DataFrame) -> DataFrame:
    listed = r.lexicon.groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("listed"))
    lines = over_frames(f"SELECT manuscript_id, lower(speaker) AS who, {SPARK.tokens('line')} AS ws FROM {voices.dialogue(SPARK, 'chapters_to_check')} s", chapters=r.chapters)
    words = lines.select("manuscript_id", "who", F.explode("ws").alias("never_say"))
    said = words.join(r.lexicon.select("manuscript_id", F.lower("who").alias("who"), F.lower("never_say").alias("never_say")).distinct(), ["manuscript_id", "who", "never_say"], "left_semi")
    return _told(_by(asked, listed, _fails(said, "true")), (F.col("listed").isNull(), "skip", "no lexicon"), _failed("words that a speaker never says"))


@check
def check_structure_variety(r: Relations, asked: DataFrame) -> DataFrame:
    """Neighbouring chapters with one structure, and from six on structures over 40 % of the chapters; chapters without a record tell nothing."""
    number = F.expr("try_cast(nullif(regexp_extract(chapter, '^chapter-([0-9]+)[.]md$', 1), '') AS BIGINT)")
    told = r.reports.select("manuscript_id", "chapter_no", F.expr(SPARK.field("line", "structure")).alias("structure")).where("structure IS NOT NULL")
    known = r.chapters.select("manuscript_id", "chapter", number.alias("chapter_no")).join(told, ["manuscript_id", "chapter_no"])
    order = Window.partitionBy("manuscript_id").orderBy("chapter")
    again = known.withColumn("before", F.lag("structure").over(order)).groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("known"), F.count(F.when(F.col("structure") == F.col("before"), 1)).alias("again"))
    share = known.groupBy("manuscript_id", "structure").agg(F.count(F.lit(1)).alias("k")).join(again, "manuscript_id").where("known >= 6 AND k > 0.40 * known").groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("wide"))
    rows = _by(asked, r.counts, again, share).withColumn("n", F.coalesce("again", F.lit(0)) + F.coalesce("wide", F.lit(0)))
    return _told(rows, _none(), (F.coalesce("known", F.lit(0)) < 2, "skip", "fewer than two records"), _failed("violations"))


@check
def check_dynamic_range(r: Relations, asked: DataFrame) -> DataFrame:
    floor = F.expr(f"try_cast(nullif(regexp_extract(raw, {SPARK.lit(check_plans.FLOOR_HEADLINE)}, 1), '') AS DOUBLE)")
    scores = r.evaluations.where(F.col("name").rlike(r"^eval-chapter-[^/]*[.]md$")).groupBy("manuscript_id").agg(F.count(floor).alias("scores"), F.coalesce(F.stddev_pop(floor) / F.avg(floor), F.lit(0.0)).alias("cv"))
    least = F.coalesce(F.when(F.get("args", 0) != "", F.get("args", 0)).cast("double"), F.lit(0.02))
    return _told(_by(asked, scores), (F.coalesce("scores", F.lit(0)) < 6, "skip", "fewer than six scores"), (F.col("cv") < least, "fail", "flat scores"))


def _lacking(r: Relations, asked: DataFrame) -> DataFrame:
    empty = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} is missing"))
    rows = asked.join(r.metas.dropDuplicates(["manuscript_id"]), "manuscript_id", "left")
    return rows.withColumn("lacks", F.concat_ws(", ", empty("title"), empty("author"), empty("language")))


@check
def check_book_meta(r: Relations, asked: DataFrame) -> DataFrame:
    return _told(_lacking(r, asked), (F.col("lacks") != "", "fail", F.col("lacks")))


@check
def check_epub(r: Relations, asked: DataFrame) -> DataFrame:
    """Metadata and the pages of the chapters, each on its own: a book fails by what its parts lack, and none is bound here."""
    pages = markup.compile_chapters(r.chapters).where(F.size("errors") > 0).groupBy("manuscript_id").agg(F.count(F.lit(1)).alias("n"))
    return _told(_by(_lacking(r, asked), r.counts, pages), (F.col("chapters").isNull(), "fail", "no chapters"), (F.col("lacks") != "", "fail", F.col("lacks")), _failed("chapters that are no page"))


def run(manifest: DataFrame, relations: Relations, registry: dict[str, Check] | None = None) -> DataFrame:
    """gate, manuscript_id, token, name, status, summary and advisory for each row of ``manifest`` (gate, manuscript_id, token).

    A token is a check's name and its arguments, parted by colons.  Each check runs once for all manuscripts that ask for it,
    and its rows are written to the shared folder: if it raises, there or in a task, its rows say so and the others stand.
    An unknown name is an error and never advisory.
    """
    known = CHECKS if registry is None else registry
    parts = F.split("token", ":")
    asked = manifest.select("gate", "manuscript_id", "token", F.get(parts, 0).alias("name"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("args"))
    out = asked.where(~F.coalesce(F.col("name").isin(list(known)), F.lit(False))).select("gate", "manuscript_id", "token", "name", F.lit("error").alias("status"), F.concat(F.lit("unknown check "), F.coalesce("name", F.lit("null"))).alias("summary"), F.lit(False).alias("advisory"))
    folder, spark = _folder(manifest), manifest.sparkSession
    wanted = {r.name for r in asked.select("name").where(F.col("name").isin(list(known))).distinct().collect()}
    for name in (n for n in known if n in wanted):
        mine = asked.where(F.col("name") == name)
        each = mine.select("manuscript_id", "args").distinct()
        path = f"{folder}/gates-{uuid.uuid4().hex}"
        try:
            known[name](relations, each).select("manuscript_id", "args", "status", "summary").write.parquet(path)
            done = spark.read.schema("manuscript_id string, args array<string>, status string, summary string").parquet(path)
        except Exception as wrong:  # whatever a check raises is its own result
            reason = str(wrong).strip().split("\n")[0][:200]
            done = each.select("manuscript_id", "args", F.lit("error").alias("status"), F.lit(f"check raised {type(wrong).__name__}: {reason}").alias("summary"))
        done = done.select(F.col("manuscript_id").alias("of"), F.col("args").alias("given"), "status", "summary")
        told = mine.join(done, F.col("manuscript_id").eqNullSafe(F.col("of")) & (F.col("args") == F.col("given")))
        out = out.unionByName(told.select("gate", "manuscript_id", "token", "name", "status", "summary", F.lit(name in lx.ADVISORY_CHECKS).alias("advisory")))
    return out


def verdicts(results: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """gate, ok, pending, blocking and advised (names, sorted) from the results of :func:`run`; pending outputs (gate, path) shut a gate."""
    bad = F.col("status").isin("fail", "error")
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.coalesce("name", F.lit("null"))))), ",")
    told = results.groupBy("gate").agg(names(bad & ~F.col("advisory")).alias("blocking"), names(bad & F.col("advisory")).alias("advised"))
    if pending is None:
        pending = results.select("gate", F.lit("").alias("path")).limit(0)
    told = told.join(pending.groupBy("gate").agg(F.count(F.lit(1)).alias("pending")), "gate", "left").withColumn("pending", F.coalesce("pending", F.lit(0)).cast("long"))
    shut = F.col("pending") > 0
    return told.select("gate", (~shut & (F.col("blocking") == "")).alias("ok"), "pending", F.when(shut, "").otherwise(F.col("blocking")).alias("blocking"), F.when(shut, "").otherwise(F.col("advised")).alias("advised"))
