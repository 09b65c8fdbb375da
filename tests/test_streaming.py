"""Streams against their batch forms, over several micro-batches."""

import datetime
import json

from pyspark.sql import functions as F

from opstrata.operators.sessions import latest
from opstrata.streaming import ingest, state


def parts(spark, path, schema, *batches):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_numbers_go_on_over_batches(spark, tmp_path):
    s = parts(spark, f"{tmp_path}/in", "user string, id long", [("a", 2), ("a", 1), ("b", 9)], [("a", 3), ("c", 1)], [("b", 10), ("a", 4)])
    state.run_to_end(state.number_events(s, "user", "id"), f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    by = {}
    for r in rows:
        by.setdefault(r.user, []).append(r.sequence_number)
    assert {k: sorted(v) for k, v in by.items()} == {"a": [1, 2, 3, 4], "b": [1, 2], "c": [1]}


def test_feedback_is_given_once(spark, tmp_path):
    s = parts(spark, f"{tmp_path}/in", "project string, feedback_key string, seq int", [("p", "k1", 1), ("p", "k1", 2), ("q", "k1", 1)], [("p", "k1", 3), ("p", "k2", 4)], [("p", "k1", 5)])
    state.run_to_end(state.fresh_feedback(s), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.project, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    first = {("p", 1), ("q", 1)}
    assert first <= got and got <= first | {("p", 3), ("p", 4), ("p", 5)} and len([x for x in got if x[0] == "p"]) in (3,)


def test_pairs_and_running_figures(spark, tmp_path):
    t = lambda m: datetime.datetime(2025, 1, 1, 0, m)
    rows = [[("s", "c1", 1, "pre", t(0)), ("s", "c2", 2, "pre", t(1))], [("s", "c1", 3, "post", t(2)), ("s", "c9", 4, "post", t(3))], [("s", "c2", 5, "post", t(59))]]
    schema = "session string, call string, id long, kind string, ts timestamp"
    s = parts(spark, f"{tmp_path}/in", schema, *rows)
    e = lambda k: s.filter(F.col("kind") == k).select("session", "call", "id", "ts")
    state.run_to_end(state.pair_events(e("pre"), e("post"), ["session", "call"], "ts", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [(r.first_id, r.second_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 3)]
    state.keep_latest(state.running(s, "session", F.count(F.lit(1)).alias("n"), F.max("id").alias("last")), f"{tmp_path}/r", f"{tmp_path}/cp2").awaitTermination()
    assert latest(spark.read.parquet(f"{tmp_path}/r"), ["session"], F.desc("batch_id")).select("session", "n", "last").collect()[0][:] == ("s", 5, 5)


def test_ingestion_sets_bad_rows_aside(spark, tmp_path):
    day = datetime.datetime(2025, 3, 4, 5)
    good = [{"session_id": "s", "tool_name": "Bash", "tool_input": {}, "tool_response": {"duration_ms": 5, "exit_code": 1, "error": "e"}}, {"session_id": "s", "event": "todo", "todos": []}, {"session_id": "s", "message": "m"}]
    raw = [(json.dumps(g), day) for g in good] + [("{bad", day), (None, day), ('{"tool_name":"x","tool_input":{}}', day)]
    s = parts(spark, f"{tmp_path}/in", "value string, received_at timestamp", raw[:3], raw[3:])
    ingest.append_events(ingest.normalise(s), f"{tmp_path}/t", f"{tmp_path}/q", f"{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/t").collect()
    assert sorted((r.event_type, r.source, r.duration_ms) for r in rows) == [("Notification", "claude_code", None), ("PostToolUse", "claude_code", 5), ("TodoUpdated", "opencode", None)]
    assert {str(r.day) for r in rows} == {"2025-03-04"} and spark.read.parquet(f"{tmp_path}/q").count() == 3


def test_echo_of_feedback_is_dropped(spark, tmp_path):
    s = parts(spark, f"{tmp_path}/in", "session_id string, kind string, seq int", [("a", "idle", 1), ("a", "feedback", 2)], [("a", "idle", 3), ("a", "idle", 4), ("b", "idle", 1)])
    state.run_to_end(state.without_echo(s), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.session_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("a", 2) in got and ("b", 1) in got and len(got) == 4 and (("a", 3) not in got or ("a", 1) not in got)
