"""Streaming queries, run to the end of a table; each gives what its batch form gives."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.operators.sessions import latest
from opstrata.plans.registry import registry
from opstrata.sources.tables import shared_dir, stream
from opstrata.streaming import state as S

QUERIES, ORACLES, query = registry()
#: Event time of the row that ends a replay and so closes every window.
END = datetime(2262, 1, 1)


def _finish(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    base = shared_dir(spark, purpose)
    S.run_to_end(df, f"{base}/rows", f"{base}/progress")
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream with instants, and the mark that ends it, which has no user."""
    base = shared_dir(spark, "mark")
    spark.createDataFrame([(None, None, None, END)], "event_id bigint, user_id bigint, event_type string, ts timestamp").write.parquet(base)
    mark = spark.readStream.schema("event_id bigint, user_id bigint, event_type string, ts timestamp").parquet(base)
    return stream(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).unionByName(mark)


@query("select event_id, user_id, row_number() over (partition by user_id order by event_id) as sequence_number from events")
def ss02_stream_sequences(spark, sf):
    return _finish(spark, S.number_events(stream(spark, sf, "events"), "user_id", "event_id"), "sequences")


@query("""select v.user_id, v.event_id as first_id, p.event_id as second_id from events v join events p on v.user_id = p.user_id and p.ts between v.ts and v.ts + interval 2 hour where v.event_type = 'view' and p.event_type = 'purchase'""")
def ss04_stream_pairs(spark, sf):
    e = lambda kind: stream(spark, sf, "events").filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return _finish(spark, S.pair_events(e("view"), e("purchase"), ["user_id"], "ts", "2 hours"), "pairs").select("user_id", "first_id", "second_id")


@query("select user_id, count(*) as n_events, count(*) filter (where event_type = 'error') as n_errors, min(event_id) as first_event, max(event_id) as last_event from events group by 1")
def ss07_running_sessions(spark, sf):
    aggregates = [F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")]
    df = S.running(stream(spark, sf, "events").filter("user_id is not null"), "user_id", *aggregates)
    base = shared_dir(spark, "running")
    S.keep_latest(df, f"{base}/rows", f"{base}/progress").awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    return latest(rows, ["user_id"], F.desc("batch_id")).drop("batch_id")


@query("""select date_trunc('day', ts) as day, event_type, count(*) as n from events where user_id is not null group by 1, 2""")
def ss09_tumbling_windows(spark, sf):
    df = S.windowed(_closed(spark, sf), "ts", "1 hour", F.window("ts", "1 day"), ["event_type"], [F.count("user_id").alias("n")])
    rows = _finish(spark, df, "tumbling").filter("n > 0")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as begins from events window w as (partition by user_id order by ts)), s as (select *, sum(begins) over (partition by user_id order by ts rows unbounded preceding) as s from g)
 select user_id, min(ts) as first_time, count(*) as n from s group by user_id, s""")
def ss09_session_windows(spark, sf):
    df = S.windowed(_closed(spark, sf), "ts", "1 hour", F.session_window("ts", "6 hours"), ["user_id"], [F.count("user_id").alias("n")])
    rows = _finish(spark, df, "session-windows").filter("user_id is not null")
    return rows.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("first_time"), "n")
