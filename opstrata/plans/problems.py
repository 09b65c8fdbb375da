"""The pN_ queries of the core: nested records, repeated deliveries, feature table, timestamps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.operators import delivery, features, instants, nested
from opstrata.sources.tables import table

NESTED = (("hook_events", "id", "metadata"), ("transcript", "line_id", "message"), ("code_quality_cache", "id", "complexity_metrics_json"))
TIMES = (("hook_events", "id", "timestamp"), ("qpe_leaderboard", "id", "measured_at"), ("schema_migrations", "ledger_id", "applied_at"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _nested(want: str, columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _union([nested.flatten_json(table(spark, sf_dir, t), i, c, want, columns).select(F.lit(t).alias("source_table"), "record_id", *columns) for t, i, c in NESTED])

    return query


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.surplus_deliveries(table(spark, sf_dir, "message_updated")).select("delivery_id")


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.kept_deliveries(table(spark, sf_dir, "message_updated")).select("delivery_id", "session_id", F.col("tokens.input").alias("input"), F.col("tokens.output").alias("output"), "cost")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = features.long_table(table(spark, sf_dir, "hook_events"))
    types = features.type_list(long)
    wide = features.wide_blocks(long, types, ("last_sequence",))
    return features.unpivot_blocks(wide, types, "last_sequence").select(F.col("entity").alias("session_id"), F.col("type").alias("tool_key"), "last_sequence")


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = features.long_table(table(spark, sf_dir, "hook_events"))
    types = [r[0] for r in features.type_list(long).select("type").orderBy("type").limit(features.MOST_TYPES + 1).collect()]
    return features.feature_table(long, types).withColumnRenamed("entity", "session_id")


def p5_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.long_table(table(spark, sf_dir, "hook_events")).withColumnsRenamed({"entity": "session_id", "type": "tool_key"})


def _times(skip: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hosts = table(spark, sf_dir, "agent_hosts")
        return _union([instants.normalise(table(spark, sf_dir, t), hosts, i, c, skip_canonical=skip).select(F.lit(t).alias("source_table"), "record_id", "utc_micros") for t, i, c in TIMES])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": _nested("array_objects", ("path",)),
    "p2_objects": _nested("objects", ("path", "parent_path", "ordinal")),
    "p2_values": _nested("values", ("path", "parent_path", "ordinal", "kind", "value")),
    "p3_found": p3_found,
    "p3_kept": p3_kept,
    "p5_found": p5_found,
    "p5_features": p5_features,
    "p5_long": p5_long,
    "p6_found": _times(True),
    "p6_instants": _times(False),
}

_KEY = r"lower(regexp_replace(tool_name, '[^\p{L}\p{N}]', '', 'g'))"
_MSG = r"lower(regexp_replace(message_id, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g'))"
_RANKED = f"""select *, row_number() over (partition by session_id, {_MSG} order by tokens.input + tokens.output + tokens.reasoning desc nulls last, delivery_id) as rn from message_updated"""
_LONG = f"""
with e as (select session_id, {_KEY} as tool_key, id, max(sequence_number) as s, max(duration_ms) as ms, max(exit_code) as c from hook_events where tool_name is not null and session_id is not null group by 1, 2, 3)
select session_id, tool_key, count(*) as n, max(s) as last_sequence, cast(coalesce(sum(greatest(ms, 0)) filter (where ms is not null), 0) as bigint) as total_ms, count(*) filter (where c <> 0) as failures from e group by 1, 2"""
ORACLES = {
    "p3_found": f"select delivery_id from ({_RANKED}) where rn > 1",
    "p3_kept": f"select delivery_id, session_id, tokens.input as input, tokens.output as output, cost from ({_RANKED}) where rn = 1",
    "p5_found": f"select session_id, {_KEY} as tool_key, max(sequence_number) as last_sequence from hook_events where tool_name is not null group by 1, 2",
    "p5_long": _LONG,
}
