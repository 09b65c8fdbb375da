"""The pN_ queries on text, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.llm import conversations, leakage, readability, runs, tokenize
from opstrata.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = conversations.replay(spark, f"{sf_dir}/transcript.parquet", table(spark, sf_dir, "hook_events"))
    return conversations.validated_turns(lines)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("session_id", "turn_no", "uuid")


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns per kept conversation, by role."""
    n = lambda r, a: F.count_if(F.col("role") == r).alias(a)
    return _turns(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), n(conversations.USER, "user_turns"), n(conversations.ASSISTANT, "assistant_turns"), n(conversations.SYSTEM, "system_turns"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = table(spark, sf_dir, "hook_events").filter("event_type = 'PostToolUse'")
    return runs.collapse_runs(post, "session_id", "sequence_number", "id", F.col("tool_name"), F.col("duration_ms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("n_events >= 2").select(F.col("entity").alias("session_id"), "first_sequence", "last_sequence")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("entity").alias("session_id"), F.col("key").alias("tool_key"), "first_sequence", "last_sequence", "n_events", "duration_ms")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, sf_dir, "documents"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks with their tiles and how much of the item they cover."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).filter(F.col("longest") >= leakage.LEAST).select("doc_id", "item_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).select("doc_id", "reading_level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_conversations": p1_conversations, "p4_found": p4_found, "p4_runs": p4_runs, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_levels": p9_levels}
_KEY = r"lower(regexp_replace(tool_name, '[^\p{L}\p{N}]', '', 'g'))"
_RUNS = f"""
with e as (select distinct session_id, sequence_number as s, id, {_KEY} as k, greatest(coalesce(duration_ms, 0), 0) as ms from hook_events where event_type = 'PostToolUse'),
b as (select *, case when k = lag(k) over (partition by session_id order by s, id) then 0 else 1 end as begins from e),
r as (select *, sum(begins) over (partition by session_id order by s, id rows unbounded preceding) as run from b)
select session_id, min(k) as tool_key, min(s) as first_sequence, max(s) as last_sequence, count(*) as n_events, cast(sum(ms) as bigint) as duration_ms from r group by session_id, run"""
ORACLES: dict[str, str] = {
    "p4_found": f"select session_id, first_sequence, last_sequence from ({_RUNS}) where n_events >= 2",
    "p4_runs": _RUNS,
}
