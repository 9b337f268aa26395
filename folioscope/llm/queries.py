"""Queries of the training-data operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, licenses, lines, mixing, near, oracles, quality, repair, resample, secrets, substrings, tokens

#: Tools that the conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op3_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(_table(spark, sf_dir, "documents"), vocabulary_file(), full=False).drop("ids", "decoded")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("clean_text")


def tool_turns(conversations: DataFrame) -> DataFrame:
    """Conversations with tool calls made of their own turns, as the table holds none.

    Each user turn is also a search call of the assistant for its text; each assistant turn also comes as the answer
    to the turn before it, last ones first and after all other turns, as results of parallel calls do.
    """
    turn, text = F.col("turn").cast("long"), F.col("text").cast("string")
    name = lambda t: F.concat(F.lit("turn-"), t)
    row = lambda t, role, shown: ("conv_id", t.alias("turn"), role.alias("role"), shown.alias("text"))
    call = F.struct(name(turn).alias("id"), F.lit("search").alias("name"), F.struct(text.alias("query")).alias("arguments"))
    plain = conversations.select(*row(2 * turn, F.col("role"), text))
    calls = conversations.where("role = 'user'").select(*row(2 * turn + 1, F.lit("assistant"), F.to_json(F.struct(F.array(call).alias("tool_calls")))))
    answers = conversations.where("role = 'assistant'").select(*row(1_000_000_000 - turn, F.lit("tool"), F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content")))))
    return plain.union(calls).union(answers)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(tool_turns(_table(spark, sf_dir, "conversations")), TOOLS)


def op6_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_bpe_tokens, op4_quality_rules, op5_chat_format, op6_quality_resample, op7_line_dedup, op8_secret_scan, op9_near_dedup, op10_decontaminate, op11_source_mix, op12_centroid_clusters, op13_conversation_repair)}

#: Merges of a vocabulary, hashed n-gram models, banded edit distances, random draws and cheapest edits are beyond SQL: the
#: tests hold those operators against brute force.
ORACLES: dict[str, str] = {"op1_license_scan": oracles.OP1, "op2_substring_dedup": oracles.OP2, "op4_quality_rules": oracles.OP4, "op5_chat_format": oracles.OP5, "op8_secret_scan": oracles.OP8, "op9_near_dedup": oracles.OP9, "op10_decontaminate": oracles.OP10, "op12_centroid_clusters": oracles.OP12}
