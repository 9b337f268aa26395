"""Secret scans with multipart linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base kinds in their order, with pattern, judged group and least length.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Weak parts, reported only with complementary parts nearby: pattern, judged group, least and greatest length, and what the
#: judged text must hold.  The part is the judged text, which ends with the match.
WEAK = {
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.%-]*", 0, 1, 1 << 30, ()),
    "weak_id": (r"(^|[^A-Za-z0-9])((?:user(?:name)?|login|client_?id|account)\x20*[:=]\x20*[A-Za-z0-9._@-]{3,64})", 2, 1, 1 << 30, ()),
    "weak_secret": (r"[A-Za-z0-9+/]{40,}", 0, 40, 40, ("[0-9]", "[A-Z]")),
}
#: Code points within which parts of one credential stand.
SCOPE = 400


#: A hex run under 24 characters fails anyway; only longer ones are listed.  The same runs result.
_LISTED = {"hex": r"[0-9a-f]{24,}"}


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, most: int = 1 << 30, holds: tuple = ()) -> Column:
    """Matches as (kind, start, end), from the texts between them; failing ones dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        first = end - F.length(x["value"]) if kind in WEAK else start
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def fits(x: Column) -> Column:
        good = F.length(x["value"]).between(least, most)
        for one in holds:
            good = good & F.rlike(x["value"], F.lit(one))
        return good

    zipped = F.transform(found, lambda hit, i: F.struct(F.get(between, i).alias("gap"), hit.alias("hit"), F.get(judged, i).alias("value")))
    placed = F.filter(F.aggregate(zipped, blank, step)["out"], fits)
    shown = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.rlike(text, F.lit(pattern)), shown).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


ORDER = [*BASE, *WEAK]


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets in whole texts, with weak parts where they complete one another.

    Base kinds are found by their patterns, leftmost and not overlapping, failing matches dropped, and
    always reported.  Access identifiers, secrets and endpoints then form multipart credentials: parts of
    one document are joined by interval (starts in the same or a neighbouring stretch of ``scope`` code
    points, not further apart than ``scope``).  A weak part (an endpoint, a user name, a high-entropy string
    of 40 characters) is reported only when parts of the two other roles, or a strong part of another role,
    stand in its scope.

    A null text is empty.  Repeated rows are rows of their own.  Returns a row for each input row: doc_id
    (null stays null), n_assign, n_access, n_hex, base_sha256, spans and n_linked (weak parts reported).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lists = [_spans(F.col("text"), k, _LISTED.get(k, p), g, n) for k, (p, g, n) in BASE.items()] + [_spans(F.col("text"), k, *rule) for k, rule in WEAK.items()]
    parts = common.stored(rows.select("rid", "doc_id", F.concat(*lists).alias("parts")))
    # the document itself is a part of rank -1, so that one without secrets stays
    mark = F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("rank"), F.lit(-1).alias("end"), F.lit("").alias("kind")))
    each = parts.select("rid", "doc_id", F.explode(F.concat(mark, "parts")).alias("p")).select("rid", "doc_id", "p.*")
    role = F.when(F.col("kind").isin("access", "weak_id"), "id").when(F.col("kind").isin("assign", "hex", "weak_secret"), "secret").when(F.col("kind") == "endpoint", "endpoint")
    each = each.withColumn("role", role).withColumn("weak", F.col("kind").isin(*WEAK)).withColumn("stretch", F.floor(F.col("start") / scope))
    # what stands in each stretch is summed up first, so that many parts in one scope make no pairs
    weak = each.where("weak")
    reach = each.where("rank >= 0").select("rid", "start", "role", "weak", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    summed = reach.groupBy("rid", "stretch", "role", "weak").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    near = F.exists("starts", lambda s: F.abs(s - F.col("start")) <= scope)
    other = summed.select("rid", "stretch", F.col("role").alias("other_role"), F.col("weak").alias("other_weak"), "starts")
    linked = (
        weak.join(other, ["rid", "stretch"]).where((F.col("role") != F.col("other_role")) & near)
        .groupBy("rid", "start", "rank").agg(F.count_distinct("other_role").alias("roles"), F.bool_or(~F.col("other_weak")).alias("strong"))
        .where("roles >= 2 or strong").select("rid", "start", "rank", F.lit(True).alias("linked"))
    )
    told = each.join(linked, ["rid", "start", "rank"], "left").where("not weak or linked")
    span = F.concat_ws(":", "kind", "start", "end")
    base = F.col("rank").between(0, len(BASE) - 1)
    listed = lambda which: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(which, F.struct("start", "rank", span.alias("shown"))))), lambda x: x["shown"]), ",")
    return (
        told.groupBy("rid", "doc_id")
        .agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("rank") >= 0).alias("spans"), F.count(F.when(F.col("linked"), 1)).alias("n_linked"))
        .drop("rid")
    )
