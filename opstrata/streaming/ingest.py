"""Raw hook payloads to event rows: parsed, told apart by their fields, enriched, appended; what can't be read is set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opstrata.functions.events import at, event_kind, plugin_event_type, readable, tool_type


def normalise(raw: DataFrame, payload: str = "value", received: str = "received_at") -> DataFrame:
    """Event rows of payloads, on a stream or a table. ``event_type`` is null where the payload can't be read or told; such rows belong into quarantine.

    Payloads of the plugin name their event in ``event``; others are told by which fields they have. Duration, exit code and error come from a response that is an object,
    or for the plugin from the payload itself.
    """
    v = readable(F.col(payload))
    keys = F.json_object_keys(F.when(v.isNotNull(), F.col(payload)))
    plugin = plugin_event_type(at(v, "$.event"))
    name = F.coalesce(at(v, "$.tool_name"), at(v, "$.tool"))
    response = "$.tool_response"
    return raw.select(
        F.col(payload).alias("metadata"), F.col(received).alias("received_at"), at(v, "$.session_id").alias("session_id"),
        F.coalesce(plugin, event_kind(keys, F.coalesce(at(v, "$.stop_hook_active", "boolean"), F.lit(False)))).alias("event_type"), F.when(plugin.isNotNull(), "opencode").otherwise("claude_code").alias("source"),
        name.alias("tool_name"), tool_type(name).alias("tool_type"), F.coalesce(at(v, f"{response}.duration_ms", "int"), at(v, "$.duration_ms", "int")).alias("duration_ms"),
        at(v, f"{response}.exit_code", "int").alias("exit_code"), at(v, f"{response}.error").alias("error_message"), at(v, "$.transcript_path").alias("transcript_path"), at(v, "$.parent_id").alias("parent_session_id"),
    )


def sound(events: DataFrame) -> DataFrame:
    return events.filter("event_type is not null and session_id is not null")


def unsound(events: DataFrame) -> DataFrame:
    return events.filter("event_type is null or session_id is null").select("metadata", "received_at")


def append_events(stream: DataFrame, table: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """SNK-01, SS-01: appends the sound events of a normalised stream by source and day, the rest to quarantine. A batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for part, path in ((sound(batch).withColumn("day", F.to_date("received_at")), table), (unsound(batch), quarantine)):
            keys = [k for k in ("source", "day") if k in part.columns]
            part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *keys).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
