"""Sessions, transcripts and plans on small cases with known results."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opstrata.functions import events as E
from opstrata.operators import running, sessions, todo_plans, transcripts

LINES = "session_id string, line long, type string, message string, tool_use_result string, subtype string, uuid string, parent_uuid string, is_compact_summary boolean, compact_metadata string"


def lines(spark, rows):
    names = [f.split()[0] for f in LINES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, "s" if n == "session_id" else None) for n in names) for r in rows], LINES)


def turn(line, tokens, out, tools=(), **more):
    content = [{"type": "tool_use", "name": t, "id": f"t{line}{k}"} for k, t in enumerate(tools)] if not isinstance(tools, str) else tools
    return {"line": line, "type": "assistant", "message": json.dumps({"usage": {"input_tokens": tokens, "output_tokens": out}, "content": content}), **more}


def total(spark, rows, read=transcripts.turns_a):
    return transcripts.usage(read(lines(spark, rows))).first()


def test_incremental_input(spark):
    u = total(spark, [turn(1, 50_000, 5000), turn(2, 120_000, 3000), turn(3, 200_000, 4000)])
    assert (u.input_tokens, u.output_tokens, u.final_context) == (200_000, 12_000, 200_000)


@pytest.mark.parametrize("chunk", [2, 20_000])
def test_compaction_clamps(spark, monkeypatch, chunk):
    monkeypatch.setattr(transcripts, "CHUNK", chunk)
    u = total(spark, [turn(1, 100_000, 5000), turn(2, 200_000, 5000), turn(3, 80_000, 2000), turn(4, 120_000, 2000), turn(5, 0, 0)])
    assert (u.input_tokens, u.output_tokens, u.final_context) == (240_000, 14_000, 120_000)


def test_split_by_activity(spark):
    u = total(spark, [turn(1, 50_000, 10, ["Read"]), turn(2, 120_000, 10, ["Edit"])])
    assert (u.explore_input, u.implement_input) == (50_000, 70_000)
    u = total(spark, [turn(1, 101, 3, ["Read", "Edit"])])
    assert (u.explore_input, u.implement_input, u.explore_output, u.implement_output) == (50, 50, 1, 1)
    u = total(spark, [turn(1, 100, 3, "a text"), {"line": 2, "type": "assistant", "message": '{"usage": {"input_to'}])
    assert (u.turns, u.implement_input) == (1, 100)


def test_dialect_b(spark):
    b = lambda n, i, o, r=0, tools=(), agent=None: {"line": n, "message": json.dumps({"role": "assistant", "agent": agent, "tokens": {"input": i, "output": o, "reasoning": r}, "parts": [{"type": "tool", "tool": t} for t in tools]})}
    u = total(spark, [b(1, 100_000, 2000, 1000, ["Read", "edit"])], transcripts.turns_b)
    assert (u.explore_input, u.implement_input, u.output_tokens) == (50_000, 50_000, 3000)
    u = total(spark, [b(1, 100_000, 10), b(2, 50_000, 10), b(3, 80_000, 10)], transcripts.turns_b)
    assert u.input_tokens == 130_000
    assert total(spark, [b(1, 100, 10, 0, ["edit"], "explore")], transcripts.turns_b).explore_input == 100


def test_subagent_tokens(spark):
    use = lambda n, i, kind: {"line": n, "type": "assistant", "message": json.dumps({"content": [{"type": "tool_use", "id": i, "name": "Task", "input": {"subagent_type": kind}}]})}
    res = lambda n, i, t: {"line": n, "type": "user", "message": json.dumps({"content": [{"type": "tool_result", "tool_use_id": i}]}), "tool_use_result": json.dumps({"totalTokens": t})}
    rows = [use(1, "a", "Explore"), use(2, "b", "Bash"), res(3, "a", 100_000), res(4, "b", 50_000), res(5, "zzz", 30_000), use(7, "late", "Explore"), res(6, "late", 1), {"line": 8, "type": "user", "message": "{}", "tool_use_result": '"text"'}]
    assert {r.kind: r.tokens for r in transcripts.subagent_tokens(lines(spark, rows)).collect()} == {"explore": 100_000, "other": 80_001}


def test_compactions(spark):
    rows = [
        {"line": 1, "type": "system", "subtype": "compact_boundary", "uuid": "u", "compact_metadata": '{"trigger":"manual","preTokens":50000}'}, {"line": 2, "type": "user", "is_compact_summary": True, "parent_uuid": "u"},
        {"line": 3, "type": "user", "is_compact_summary": True, "parent_uuid": "u"}, {"line": 4, "type": "system", "subtype": "compact_boundary", "uuid": "v"}, {"line": 5, "type": "user", "is_compact_summary": True, "parent_uuid": "none"},
        {"line": 7, "type": "system", "subtype": "compact_boundary", "uuid": "w"}, {"line": 6, "type": "user", "is_compact_summary": True, "parent_uuid": "w"},
    ]
    assert [r[1:] for r in transcripts.compactions(lines(spark, rows)).collect()] == [(1, 2, "manual", 50_000)]


def test_nearest_before(spark):
    left = spark.createDataFrame([("s", 10), ("s", 200), ("s", 51), ("t", 5)], "e string, p long")
    right = spark.createDataFrame([("s", p) for p in (1, 3, 9, 10, 149, 150)], "e string, p long")
    assert {(r.e, r.p): r.found for r in transcripts.nearest_before(left, right, "e", "p", 50).collect()} == {("s", 10): 9, ("s", 200): 150, ("s", 51): 10, ("t", 5): None}


def todo(i, seq, todos, kind="TodoUpdated", session="s"):
    m = {"todos": todos} if kind == "TodoUpdated" else {"tool_input": {"todos": todos}}
    return (i, session, seq, kind, None if kind == "TodoUpdated" else "TodoWrite", json.dumps(m))


def tool(i, seq, name, session="s", **args):
    return (i, session, seq, "PostToolUse", name, json.dumps({"tool_input": args}))


def test_plan_evolution(spark):
    t = lambda c, s="pending": {"content": c, "status": s}
    rows = [
        tool(1, 1, "Read"), tool(2, 2, "Task", subagent_type="Explore"), tool(3, 3, "Edit"), todo(4, 4, [t("a"), t("b")], "PostToolUse"), tool(5, 5, "Grep"), todo(6, 6, [t("a", "completed"), t("c")], "PostToolUse"), todo(7, 7, [], "PostToolUse", "x"),
        todo(8, 1, [t("m")], "TodoUpdated", "y"), todo(9, 2, [t("ignored")], "PostToolUse", "y"), (10, "s", 8, "PostToolUse", "TodoWrite", "{cut"), (4, "s", 4, "PostToolUse", "TodoWrite", "{cut off"), tool(11, 9, "Bash"),
    ]
    h = spark.createDataFrame(rows, "id long, session_id string, sequence_number int, event_type string, tool_name string, metadata string")
    s = {(r.session_id, r.step): r for r in todo_plans.steps(h).collect()}
    assert set(s) == {("s", 1), ("s", 2), ("y", 1)}
    assert (s["s", 1].events, s["s", 1].search, s["s", 1].implementation) == (3, 2, 1) and s["s", 1].added == ["a", "b"]
    assert (s["s", 2].added, s["s", 2].removed, s["s", 2].changed, s["s", 2].completed, s["s", 2].events) == (["c"], ["b"], ["a"], ["a"], 1)
    e = {r.session_id: r for r in todo_plans.evolution(todo_plans.steps(h)).collect()}
    assert (e["s"].n_steps, e["s"].n_created, e["s"].n_completed, e["s"].events_per_step) == (2, 3, 1, 2.0) and e["s"].exploration_percent == 75.0
    assert todo_plans.steps(h.limit(0)).count() == 0


def test_plan_files_and_task_lists(spark):
    h = spark.createDataFrame([tool(1, 1, "Write", file_path="/x/.claude/plans/a.md"), tool(2, 2, "Write", file_path="/x/.claude/plans/a.md"), tool(3, 3, "write", file_path="C:\\x\\.claude\\plans\\b-1.md"), tool(4, 4, "Write", file_path="main.py")], "id long, session_id string, sequence_number int, event_type string, tool_name string, metadata string")
    assert todo_plans.plan_files(h).count() == 2
    c = spark.createDataFrame([("s", 1, "create", "1", "a", None), ("s", 2, "create", None, "b", None), ("s", 3, "update", "1", None, "completed"), ("s", 4, "update", "9", None, "x"), ("s", 5, "update", "b", None, "deleted")], "session_id string, seq int, kind string, task_id string, subject string, status string")
    rows = todo_plans.task_lists(c).orderBy("seq").collect()
    assert [[(t.content, t.status) for t in r.todos] for r in rows] == [[("a", "pending")], [("a", "pending"), ("b", "pending")], [("a", "completed"), ("b", "pending")], [("a", "completed"), ("b", "pending")], [("a", "completed")]]


def test_running_over_chunks(spark):
    import random

    rng = random.Random(7)
    rows = [(e, p, rng.randrange(-5, 9)) for e in ("a", "b", None) for p in rng.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "e string, p int, v int")
    pdf = pd.DataFrame(rows, columns=["e", "p", "v"]).sort_values("p")
    for chunk in (1, 7, 1000):
        got = {(r.e, r.p): (r.s, r.prev) for r in running.previous(running.running_sum(df, "e", "p", F.col("v"), "s", chunk), "e", "p", "v", "prev", chunk).collect()}
        for e in ("a", "b", None):
            g = pdf[pdf.e.isna() if e is None else pdf.e == e]
            want = {(e, p): (s, None if pd.isna(v) else v) for p, s, v in zip(g.p, g.v.cumsum(), g.v.shift(), strict=True)}
            assert {k: v for k, v in got.items() if k[0] == e} == want


def test_session_lists_and_null_tools(spark):
    rows = [(i, f"session-{i // 3:03d}", "PostToolUse", None if i % 3 == 0 else f"T{i % 2}", f"2025-01-01T00:{i // 3:02d}:00.000000Z", "p", "git", None) for i in range(30)]
    e = sessions.distinct_events(spark.createDataFrame(rows, "id long, session_id string, event_type string, tool_type string, timestamp string, project_name string, project_source string, source string"), "session_id", "tool_type", "timestamp", "project_name", "project_source", "source")
    assert [r.session_id for r in sessions.recent(e, 3).collect()] == ["session-009", "session-008", "session-007"]
    s = sessions.summaries(e).orderBy("session_id").first()
    assert (s.n_events, s.n_tools, s.source) == (3, 2, "claude_code")
    assert sessions.counts_by(e, "tool_type").agg(F.sum("n_events")).first()[0] == 20
    assert sessions.headers(spark.createDataFrame([], "session_id string, sequence_number int, duration_ms int, error_message string, timestamp string")).count() == 0


def test_event_kinds(spark):
    payloads = ['{"tool_name":"x","tool_input":{}}', '{"tool_name":"x","tool_input":{},"tool_response":"t"}', '{"message":"m"}', '{"stop_hook_active":true}', '{"stop_hook_active":false}', '{"session_id":"s","transcript_path":"p"}', "{}", "[1]", "{bad", None]
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    v = E.readable(F.col("p"))
    k = F.json_object_keys(F.when(v.isNotNull(), F.col("p")))
    got = [r[0] for r in df.select(E.event_kind(k, F.coalesce(E.at(v, "$.stop_hook_active", "boolean"), F.lit(False)))).collect()]
    assert got == ["PreToolUse", "PostToolUse", "Notification", "SubagentStop", "Stop", "Stop", None, None, None, None]
    names = spark.createDataFrame([("Bash",), ("mcp__x__y",), ("Foo",), (None,), ("Task",)], "n string")
    assert [tuple(r) for r in names.select(E.tool_type(F.col("n")), E.tool_category(F.col("n"), F.lit("my Explorer"))).collect()] == [("bash", "implementation"), ("mcp__other", None), ("other", None), (None, None), ("task", "search")]
