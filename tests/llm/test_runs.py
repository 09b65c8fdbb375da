"""Runs of consecutive events against brute force, hot sessions, edge cases and SQL."""

import random

import pyarrow as pa
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from opstrata.llm import queries, runs


def test_runs_against_brute_force_with_small_chunks(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for s in ("a", "b", None):
        for q in sorted(rng.sample(range(400), 200)):
            i += 1
            r = (i, s, q, rng.choice(["Bash", "bash ", "BASH!", "Read", None, "--"]), rng.choice([None, -4, 10]))
            rows += [r] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "id long, session_id string, sequence_number int, tool_name string, duration_ms int").withColumn("key", F.lit(1))
    want = []
    for s in ("a", "b"):
        last = object()
        for _, _, q, n, ms in sorted({r for r in rows if r[1] == s}, key=lambda r: r[2]):
            k = None if n is None else "".join(c for c in n if c.isalnum()).lower()
            if k is None or k != last:
                want.append([s, k, q, q, 0, 0])
            want[-1][3], want[-1][4], want[-1][5] = q, want[-1][4] + 1, want[-1][5] + max(ms or 0, 0)
            last = k
    for chunk in (7, 64, 4096):
        got = runs.collapse_runs(df.repartition(5), "session_id", "sequence_number", "id", F.col("tool_name"), F.col("duration_ms"), chunk).collect()
        assert sorted(map(str, map(list, got))) == sorted(map(str, want))
    assert runs.collapse_runs(df.limit(0), "session_id", "sequence_number", "id", F.col("tool_name")).count() == 0


def test_batches_are_cut_at_chunk_borders():
    b = pa.record_batch([["a"] * 6, [0, 0, 0, 0, 1, 1], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], ["x", "x", "x", "y", "y", "y"], [1] * 6], ["entity", "chunk", "seq", "event_id", "key", "duration_ms"])
    for k in range(1, 6):
        out = pa.Table.from_batches(list(runs._collapse_batches(iter([b.slice(0, k), b.slice(k)])))).to_pylist()
        assert [(r["first_sequence"], r["last_sequence"], r["at_start"], r["at_end"]) for r in out] == [(1, 3, True, False), (4, 4, False, True), (5, 6, True, True)]


@pytest.mark.parametrize("name", ["p4_found", "p4_runs"])
def test_queries_are_their_sql(spark, sf, name):
    got, want, diff = differences(queries.QUERIES[name](spark, sf), queries.ORACLES[name], duck(sf))
    assert not diff and got == want > 0
