"""Queries whose SQL says less than the whole job, against brute force and small cases."""

import json
from collections import defaultdict
from datetime import datetime, timedelta

from compare import duck
from pyspark.sql import functions as F
from test_problems import by_hand

from opstrata.operators import history, sessions, transcripts
from opstrata.plans import catalogue

QUERIES = catalogue.queries()


def times(sf, where="true"):
    """First and last instant of each session, read one by one by the standard library; None where no event has one."""
    out = defaultdict(list)
    for s, text, zone in duck(sf).execute(f"select session_id, \"timestamp\", zone_name from hook_events left join agent_hosts using (host_id) where session_id is not null and {where}").fetchall():
        out[s] += [] if (u := by_hand(text, zone)) is None else [datetime(1970, 1, 1) + timedelta(microseconds=u)]
    return {s: (min(x, default=None), max(x, default=None)) for s, x in out.items()}


def test_session_times_of_any_form(spark, sf):
    want = times(sf)
    for name in ("agg01_session_header", "cp01_session_statistics"):
        df = QUERIES[name](spark, sf)
        assert {r.session_id: (r.first_time, r.last_time) for r in df.collect()} == want
        assert dict(df.dtypes)["first_time"] == dict(df.dtypes)["last_time"] == "timestamp_ntz"


def test_recent_sessions_of_any_form(spark, sf):
    for name, where in (("agg05_recent_sessions", "true"), ("agg05_recent_in_directory", "working_directory = (select min(working_directory) from hook_events)")):
        first = {s: a for s, (a, _) in times(sf, where).items()}
        want = sorted(first.items(), key=lambda x: (x[1] is None, (datetime(2100, 1, 1) - x[1]) if x[1] else timedelta(0), x[0]))[:20]
        assert [(r.session_id, r.first_time) for r in QUERIES[name](spark, sf).collect()] == want


def test_calls_meet_their_results_by_id_or_name(spark):
    rows = [
        (1, "s", 1, "PreToolUse", "Read", "Read", None, None), (2, "s", 2, "PostToolUse", " read", None, 5, None), (3, "s", 3, "PreToolUse", "mcp__a__run", "mcp__other", None, None),
        (4, "s", 4, "PostToolUse", "mcp__a__run", "mcp__a__run", 6, None), (5, "s", 5, "PreToolUse", "mcp__a__run", "mcp__other", None, None), (6, "s", 6, "PostToolUse", "mcp__b__run", "mcp__other", 7, None),
        (7, "s", 7, "PreToolUse", None, "Edit", None, None), (8, "s", 8, "PostToolUse", "Edit", "Edit", 8, None), (9, "t", 1, "PreToolUse", "Bash", "Bash", None, "x"), (10, "t", 2, "PreToolUse", "Bash", "Bash", None, "y"),
        (11, "t", 3, "PostToolUse", "Bash", "Bash", 9, "x"), (12, "t", 4, "PostToolUse", "Bash", "Bash", 10, "y"), (2, "s", 2, "PostToolUse", " read", None, 5, None), (13, "t", 5, "PreToolUse", "Grep", "Grep", None, "z"),
        (14, "t", 6, "PostToolUse", "Grep", "Grep", 11, "q"), (15, "u", 7, "PostToolUse", "Bash", "Bash", 1, "x"), (9, "t", 1, "PreToolUse", "Bash", "Bash", None, None),
    ]
    e = spark.createDataFrame(rows, "id long, session_id string, sequence_number int, event_type string, tool_name string, tool_type string, duration_ms int, call_id string")
    assert sorted(tuple(r) for r in sessions.pre_post_pairs(e).collect()) == [(1, 2, 5), (3, 4, 6), (7, 8, 8), (9, 11, 9), (10, 12, 10), (13, 14, 11)]


def test_pre_post_pairs_against_brute_force(spark, sf):
    plain = lambda t: t and "".join(c for c in t if c.isalnum()).lower()
    rows = duck(sf).execute("select distinct id, session_id, sequence_number, event_type, tool_name, tool_type from hook_events where session_id is not null and event_type in ('PreToolUse', 'PostToolUse')").fetchall()
    post = {(r[1], r[2]): r for r in rows if r[3] == "PostToolUse"}
    want = set()
    for r in rows:
        if r[3] == "PreToolUse" and (p := post.get((r[1], r[2] + 1))):
            a, b = (plain(r[4]), plain(p[4])) if r[4] and p[4] else (r[5], p[5])
            if a is not None and a == b:
                want.add((r[0], p[0]))
    assert {(r.pre_id, r.post_id) for r in QUERIES["jn21_pre_post_pairs"](spark, sf).collect()} == want


def followed(rows):
    """{root: (depth, commits)} by going from child to parent, one edge at a time."""
    parent, last = {}, {}
    for repo, k in sorted(rows):
        parent[k], last[repo] = last.get(repo), k
    out = defaultdict(list)
    for k in parent:
        depth, at = 0, k
        while parent[at] is not None:
            depth, at = depth + 1, parent[at]
        out[at].append(depth)
    return {k: (max(d), len(d)) for k, d in out.items()}


def test_ancestry_of_all_commits(spark, sf, monkeypatch):
    want = followed(duck(sf).execute("select o_custkey, o_orderkey from orders").fetchall())
    got = QUERIES["jn23_ancestry"](spark, sf)
    assert {r.root: (r.depth, r.n) for r in got.collect()} == want and sum(n for _, n in want.values()) == duck(sf).execute("select count(*) from orders").fetchone()[0]
    monkeypatch.setattr(history, "CHUNK", 7)
    long = [(repo, k * 3 + repo) for repo in (0, 1, 2) for k in range(40 + repo)]
    d = history.ancestry(spark.createDataFrame(long, "repo long, k long"), "repo", "k").groupBy("root").agg({"depth": "max", "k": "count"})
    assert {r[0]: (r["max(depth)"], r["count(k)"]) for r in d.collect()} == followed(long) == {0: (39, 40), 1: (40, 41), 2: (41, 42)}


def test_ancestry_deeper_than_recursion_goes(spark):
    d = history.ancestry(spark.range(12_000).selectExpr("1 as repo", "id as k"), "repo", "k").agg({"depth": "max", "root": "max"}).first()
    assert (d["max(depth)"], d["max(root)"]) == (11_999, 0)


def strategies(rows, sample=200):
    out = defaultdict(list)
    for repo, _, merge in sorted(rows, reverse=True):
        if len(out[repo]) < sample:
            out[repo].append(merge)
    return {r: (len(m), sum(m), "merge_anchored" if sum(m) / len(m) > 0.15 else "time_sampled") for r, m in out.items()}


def test_strategy_of_each_repository(spark, sf, monkeypatch):
    want = strategies(duck(sf).execute("select o_custkey, o_orderkey, o_orderstatus = 'F' from orders").fetchall())
    assert {r.repo: (r.n, r.merges, r.strategy) for r in QUERIES["agg23_strategy"](spark, sf).collect()} == want
    monkeypatch.setattr(history, "CHUNK", 64)
    rows = [(repo, k, k % 7 == 0 if k >= 50 else repo == 1) for repo in (1, 2) for k in range(250)] + [(3, k, k < 3) for k in range(20)]
    d = history.strategy(spark.createDataFrame(rows, "r long, k long, m boolean"), F.when(F.col("m"), 2).otherwise(1), "r", "k")
    assert {r.repo: (r.n, r.merges, r.strategy) for r in d.collect()} == strategies(rows) == {1: (200, 28, "time_sampled"), 2: (200, 28, "time_sampled"), 3: (20, 3, "time_sampled")}


def test_compact_instructions(spark, sf):
    user = lambda line, content, kind="user", s="s": (s, line, kind, json.dumps({"role": "user", "content": content}), None)
    edge = lambda line, s="s": (s, line, "system", None, "compact_boundary")
    rows = [
        user(1, "/COMPACT keep the plan"), user(2, "an ordinary line"), user(3, [{"type": "text", "text": "/compact in a list"}]), ("s", 4, "user", '{"content": "/compact cut', None), ("s", 5, "assistant", '{"content": "/compact"}', None), edge(6),
        user(7, "please /compact now", " Human "), edge(8), user(1, "an ordinary line", s="t"), edge(2, "t"), user(1, "/compact far", s="u"), *[user(k, "x", s="u") for k in range(2, 51)], edge(51, "u"), edge(52, "u"), user(53, "/compact later", s="u"),
        user(1, {"/compact": "/compact"}, s="v"), ("v", 2, "user", "{}", None), edge(3, "v"),
    ]
    d = transcripts.compact_instructions(spark.createDataFrame(rows, "session_id string, line long, type string, message string, subtype string"))
    assert {(r.session_id, r.line): (r.found, r.instructions) for r in d.collect()} == {
        ("s", 6): (1, "/COMPACT keep the plan"), ("s", 8): (7, "please /compact now"), ("t", 2): (None, None), ("u", 51): (1, "/compact far"), ("u", 52): (None, None), ("v", 3): (None, None),
    }
    assert QUERIES["jn05_nearest_user_line"](spark, sf).filter("found is not null").count() == 0  # the tables have no such text


def test_outputs_keep_ten_thousand_characters(spark, tmp_path):
    rows = [(n, "PostToolUse", json.dumps({"output": "a" * (n - 1) + "z"})) for n in (500, 501, 10_000, 10_001)]
    spark.createDataFrame(rows, "id long, event_type string, metadata string").write.parquet(str(tmp_path / "hook_events.parquet"))
    got = {r.id: (len(r.output), r.output[-1], r.n) for r in QUERIES["src27_shaped_output"](spark, str(tmp_path)).collect()}
    assert got == {500: (500, "z", 500), 501: (501, "z", 501), 10_000: (10_000, "z", 10_000), 10_001: (10_000, "a", 10_001)}


def wrapped(doc, times):
    text = json.dumps(doc)
    for _ in range(times):
        text = json.dumps(text)
    return text


def test_call_ids_in_wrapped_payloads(spark, tmp_path):
    call = lambda id, place, kind, name, types, metadata, ms=None: (id, "s", place, kind, name, types, ms, metadata)
    rows = [
        call(1, 1, "PreToolUse", "Bash", "Bash", wrapped({"call_id": "x"}, 1)), call(2, 2, "PreToolUse", "Bash", "Bash", json.dumps({"call_id": "y"})), call(3, 3, "PreToolUse", "Read", "Read", " \t" + wrapped({"call_id": "z"}, 12)),
        call(4, 4, "PostToolUse", "Bash", "Bash", json.dumps({"call_id": "x"}), 5), call(5, 5, "PostToolUse", "Bash", "Bash", wrapped({"call_id": "y"}, 2), 6), call(6, 6, "PostToolUse", "Read", "Read", wrapped({"call_id": "z"}, 1), 7),
        call(7, 8, "PreToolUse", "Grep", "Grep", wrapped({"call_id": "w"}, 1)[:-9]), call(8, 9, "PostToolUse", "Grep", "Grep", '"', 8), call(9, 10, "PreToolUse", " ", "Edit", ""), call(10, 11, "PostToolUse", "_", "Glob", None, 9),
        call(11, 12, "PreToolUse", " ", "Edit", "{}"), call(12, 13, "PostToolUse", "Edit", "Edit", "{}", 10),
    ]
    spark.createDataFrame(rows, "id long, session_id string, sequence_number int, event_type string, tool_name string, tool_type string, duration_ms int, metadata string").write.parquet(str(tmp_path / "hook_events.parquet"))
    assert sorted(tuple(r) for r in QUERIES["jn21_pre_post_pairs"](spark, str(tmp_path)).collect()) == [(1, 4, 5), (2, 5, 6), (3, 6, 7), (7, 8, 8), (11, 12, 10)]


def test_compact_instructions_in_wrapped_messages(spark):
    rows = [
        ("s", 1, "user", wrapped({"content": "/compact once"}, 1), None), ("s", 2, "system", None, "compact_boundary"), ("s", 3, "user", wrapped({"content": "/compact \"deep\" \\ é"}, 10), None), ("s", 4, "user", '"/compact"', None),
        ("s", 5, "user", wrapped({"content": ["/compact"]}, 2), None), ("s", 6, "user", wrapped({"content": "/compact cut"}, 1)[:-3], None), ("s", 7, "system", wrapped({"content": "x"}, 1), "compact_boundary"),
    ]
    d = transcripts.compact_instructions(spark.createDataFrame(rows, "session_id string, line long, type string, message string, subtype string"))
    assert {r.line: (r.found, r.instructions) for r in d.collect()} == {2: (1, "/compact once"), 7: (3, "/compact \"deep\" \\ é")}
