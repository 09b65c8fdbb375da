"""Queries on sessions and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions import events as E
from opstrata.functions.timestamps import CANONICAL
from opstrata.operators import sessions as S
from opstrata.operators.running import running_sum
from opstrata.plans.registry import registry
from opstrata.sources.tables import table

QUERIES, ORACLES, query = registry()


def _events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return S.distinct_events(table(spark, sf, "hook_events"), "session_id", *columns)


def _times(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_times(table(spark, sf, "hook_events"), table(spark, sf, "agent_hosts"))


_E = "(select distinct {} from hook_events where session_id is not null)"
_TIME = f"case when regexp_matches(\"timestamp\", '{CANONICAL}') then cast(rtrim(\"timestamp\", 'Z') as timestamp) end"
_HEADER = f"""count(*) as n_events, min(sequence_number) as first_sequence, max(sequence_number) as last_sequence, min({_TIME}) as first_time, max({_TIME}) as last_time,
 count(*) filter (where error_message is not null and error_message <> '') as n_errors, cast(coalesce(sum(duration_ms), 0) as bigint) as total_duration_ms,
 coalesce(sum(duration_ms), 0) / count(*) as avg_duration_all_events, coalesce(avg(duration_ms), 0) as avg_duration_ms"""
_ALL = "id, session_id, sequence_number, event_type, tool_type, duration_ms, error_message, \"timestamp\", source, git_state, working_directory, project_name, project_source, transcript_path"
_GIT = """case when gf.is_git_repo and gl.is_git_repo then greatest(gl.commit_count - gf.commit_count, 0) else 0 end"""


@query(f"""select id, session_id, sequence_number, event_type, tool_type, coalesce(source, 'claude_code') as source, coalesce(json_valid(metadata), false) as readable
 from hook_events where session_id is not null group by all""")
def src01_session_events(spark, sf):
    """SRC-01: all events decoded; unreadable JSON doesn't fail the scan."""
    e = table(spark, sf, "hook_events").filter("session_id is not null")
    return e.select("id", "session_id", "sequence_number", "event_type", "tool_type", F.coalesce("source", F.lit(E.DEFAULT_SOURCE)).alias("source"), E.readable(F.col("metadata")).isNotNull().alias("readable")).distinct()


@query(f"select session_id, {_HEADER} from {_E.format(_ALL)} group by session_id")
def agg01_session_header(spark, sf):
    """AGG-01; times from timestamps of any form, which the SQL can't read: it takes canonical ones only."""
    return S.headers(_events(spark, sf, *S.HEADER), _times(spark, sf))


@query("select session_id, event_type, count(distinct id) as n_events from hook_events where event_type is not null group by 1, 2")
def agg02_events_by_type(spark, sf):
    return S.counts_by(_events(spark, sf, "event_type"), "event_type")


@query("select session_id, tool_type, count(distinct id) as n_events from hook_events where tool_type is not null group by 1, 2")
def agg03_tool_usage(spark, sf):
    return S.counts_by(_events(spark, sf, "tool_type"), "tool_type")


@query("""select session_id, project_name, project_source, count(distinct id) as n_events, count(distinct tool_type) as n_tools, coalesce(max(source), 'claude_code') as source
 from hook_events group by 1, 2, 3""")
def agg04_session_summary(spark, sf):
    return S.summaries(_events(spark, sf, "project_name", "project_source", "tool_type", "source"))


@query(f"select session_id, min({_TIME}) as first_time from hook_events group by 1 order by first_time desc nulls last, session_id limit 20")
def agg05_recent_sessions(spark, sf):
    """AGG-05 by timestamps of any form; the SQL takes canonical ones only."""
    return S.recent(table(spark, sf, "hook_events").filter("session_id is not null"), 20, hosts=table(spark, sf, "agent_hosts"))


@query(f"""select session_id, min({_TIME}) as first_time from hook_events where working_directory = (select min(working_directory) from hook_events) group by 1 order by first_time desc nulls last, session_id limit 20""")
def agg05_recent_in_directory(spark, sf):
    """AGG-05 by timestamps of any form; the SQL takes canonical ones only."""
    e = table(spark, sf, "hook_events").filter("session_id is not null")
    return S.recent(e, 20, e.agg(F.min("working_directory")).first()[0], table(spark, sf, "agent_hosts"))


@query("select session_id, min(sequence_number) as first_sequence, count(distinct id) as n_events from hook_events group by 1 having count(*) > 0")
def agg06_session_basics(spark, sf):
    return _events(spark, sf, "sequence_number").groupBy("session_id").agg(F.min("sequence_number").alias("first_sequence"), F.count(F.lit(1)).alias("n_events"))


@query("select count(*) as n_entries, count(distinct repository_path) as n_repositories, count(distinct commit_sha) as n_commits from code_quality_cache")
def agg08_cache_statistics(spark, sf):
    return table(spark, sf, "code_quality_cache").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("repository_path").alias("n_repositories"), F.count_distinct("commit_sha").alias("n_commits"))


@query("select event_id, user_id, row_number() over (partition by user_id order by event_id) as sequence_number from events")
def wn01_sequence_numbers(spark, sf):
    """WN-01 in batch: numbers from 1 in order of arrival, chunk by chunk."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    return running_sum(e, "user_id", "event_id", F.lit(1), "sequence_number", 1_000_000)


@query(f"""select session_id, gf.commit_count as first_commit_count, gl.commit_count as last_commit_count, gl.current_branch as last_branch, coalesce({_GIT}, 0) as commits_made from
 (select session_id, arg_min(git_state, sequence_number) filter (where git_state is not null) as gf, arg_max(git_state, sequence_number) filter (where git_state is not null) as gl from hook_events group by 1)""")
def wn04_git_states(spark, sf):
    return _events(spark, sf, "sequence_number", "git_state").groupBy("session_id").agg(*S.git_states())


_FIRST = """select session_id, coalesce(working_directory, 'Unknown') as working_directory, project_name, case when project_name is not null then project_source end as project_source, transcript_path from
 (select *, row_number() over (partition by session_id order by sequence_number) as rn from hook_events) where rn = 1"""


@query(_FIRST)
def wn05_first_attributes(spark, sf):
    return _events(spark, sf, "sequence_number", "working_directory", "project_name", "project_source", "transcript_path").groupBy("session_id").agg(*S.first_attributes())


@query(f"""with e as {_E.format(_ALL)}, a as (select session_id, {_HEADER}, arg_min(git_state, sequence_number) filter (where git_state is not null) as gf, arg_max(git_state, sequence_number) filter (where git_state is not null) as gl,
 count(distinct tool_type) as n_tools, count(*) filter (where event_type = 'PreToolUse') as n_pre, count(*) filter (where event_type = 'PostToolUse') as n_post, count(*) filter (where event_type = 'Stop') as n_stop from e group by session_id)
 select a.* exclude (gf, gl), gf.commit_count as first_commit_count, gl.commit_count as last_commit_count, gl.current_branch as last_branch, coalesce({_GIT}, 0) as commits_made, f.* exclude (session_id)
 from a join ({_FIRST}) f using (session_id)""")
def cp01_session_statistics(spark, sf):
    """CP-01; times as in ``agg01_session_header``."""
    return S.statistics(_events(spark, sf, "sequence_number", "event_type", "tool_type", "duration_ms", "error_message", "git_state", "working_directory", "project_name", "project_source", "transcript_path"), _times(spark, sf))


@query("""select session_id, arg_max(id, sequence_number) as event_id, max(sequence_number) as sequence_number from hook_events where event_type = 'Stop' group by 1""")
def wn16_latest_stop(spark, sf):
    return table(spark, sf, "hook_events").filter("event_type = 'Stop' and session_id is not null").groupBy("session_id").agg(F.max_by("id", "sequence_number").alias("event_id"), F.max("sequence_number").alias("sequence_number"))


@query("""with k as (select id, json_keys(metadata) as k, json_extract_string(metadata, '$.stop_hook_active') as s from (select id, case when json_valid(metadata) then metadata end as metadata from hook_events) where json_type(metadata) = 'OBJECT')
 select kind, count(distinct id) as n_events from (select id, case when list_contains(k, 'tool_name') and list_contains(k, 'tool_input') then case when list_contains(k, 'tool_response') then 'PostToolUse' else 'PreToolUse' end
 when list_contains(k, 'message') then 'Notification' when list_contains(k, 'stop_hook_active') then case when s = 'true' then 'SubagentStop' else 'Stop' end
 when list_contains(k, 'session_id') and list_contains(k, 'transcript_path') then 'Stop' end as kind from k) group by 1""")
def pf01_event_kinds(spark, sf):
    m = F.when(E.readable(F.col("metadata")).isNotNull(), F.col("metadata"))
    d = table(spark, sf, "hook_events").select("id", F.json_object_keys(m).alias("keys"), (F.get_json_object(m, "$.stop_hook_active") == "true").alias("active")).filter("keys is not null")
    return d.groupBy(E.event_kind(F.col("keys"), F.coalesce("active", F.lit(False))).alias("kind")).agg(F.count_distinct("id").alias("n_events"))


@query("""select id, session_id from hook_events where session_id is not null and (event_type in ('Stop', 'SubagentStop') or (sequence_number = 1 and event_type in ('PreToolUse', 'SubagentStart'))) group by all""")
def pf03_git_capture(spark, sf):
    return _events(spark, sf, "event_type", "sequence_number").filter(E.captures_git(F.col("event_type"), F.col("sequence_number"))).select("id", "session_id")


@query("""with m as (select distinct id, case when json_valid(metadata) then metadata end as m from hook_events where event_type = 'PostToolUse')
 select distinct id, try_cast(json_extract_string(m, '$.tool_response.duration_ms') as bigint) as response_ms, try_cast(json_extract_string(m, '$.tool_response.exit_code') as bigint) as response_exit_code,
 json_extract_string(m, '$.tool_response.error') as response_error from m where json_type(m, '$.tool_response') = 'OBJECT'""")
def pf04_post_tool_response(spark, sf):
    """PF-04: duration, exit code and error of a response, where it is an object."""
    v = table(spark, sf, "hook_events").filter("event_type = 'PostToolUse'").select("id", E.readable(F.col("metadata")).alias("v"))
    d = v.filter(F.schema_of_variant(F.try_variant_get("v", "$.tool_response", "variant")).startswith("OBJECT"))
    return d.select("id", E.at(F.col("v"), "$.tool_response.duration_ms", "bigint").alias("response_ms"), E.at(F.col("v"), "$.tool_response.exit_code", "bigint").alias("response_exit_code"), E.at(F.col("v"), "$.tool_response.error").alias("response_error")).distinct()


@query("select distinct id, session_id from hook_events where event_type in ('Stop', 'SubagentStop') and git_state is not null and sequence_number between 1 and 40 and project_name is not null")
def pf05_predicates(spark, sf):
    return table(spark, sf, "hook_events").filter("event_type in ('Stop', 'SubagentStop') and git_state is not null and sequence_number between 1 and 40 and project_name is not null").select("id", "session_id").distinct()


@query("with s as (select distinct session_id from hook_events) select left(session_id, 6) as prefix, min(session_id) as session_id from s group by 1 having count(*) = 1")
def pf07_unique_prefix(spark, sf):
    return S.unique_prefix(table(spark, sf, "hook_events").filter("session_id is not null"), "session_id", 6)


@query("select distinct session_id from hook_events where starts_with(session_id, 'ses_a')")
def pf08_completion(spark, sf):
    return table(spark, sf, "hook_events").filter(F.col("session_id").startswith("ses_a")).select("session_id").distinct()


@query("""select a.id as probe_id, max(b.id) as hit_id from code_quality_cache a left join code_quality_cache b on a.session_id = b.session_id and a.repository_path = b.repository_path and a.commit_sha = b.commit_sha
 and a.working_tree_hash is not distinct from b.working_tree_hash and a.calculator_version is not distinct from b.calculator_version group by 1""")
def pf09_null_safe_probe(spark, sf):
    """PF-09, CP-20: a cache entry for the same key, null tree hashes and versions being equal to each other; no pairs are made."""
    c = table(spark, sf, "code_quality_cache").select("id", "session_id", "repository_path", "commit_sha", "working_tree_hash", "calculator_version")
    key = ["session_id", "repository_path", "commit_sha", "working_tree_hash", "calculator_version"]
    hits = c.dropna(subset=key[:3]).groupBy(*key).agg(F.max("id").alias("hit_id")).select(*[F.col(k).alias(f"_{k}") for k in key], "hit_id")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k in key[3:] else F.col(k) == F.col(f"_{k}") for k in key]
    return c.join(hits, on, "left").select(F.col("id").alias("probe_id"), "hit_id")


@query("""select id, session_id, repository_path, commit_sha, working_tree_hash, calculator_version from
 (select *, row_number() over (partition by session_id, repository_path, commit_sha, working_tree_hash, calculator_version order by id desc) as rn from code_quality_cache) where rn = 1""")
def snk04_latest_view(spark, sf):
    c = table(spark, sf, "code_quality_cache").select("id", "session_id", "repository_path", "commit_sha", "working_tree_hash", "calculator_version")
    return S.latest(c, ["session_id", "repository_path", "commit_sha", "working_tree_hash", "calculator_version"], F.desc("id"))


@query("""select count(distinct session_id) as n_entities, count(*) as n_rows from message_updated where received_at < timestamp '2025-01-01'""")
def snk10_retention(spark, sf):
    return S.before_cutoff(table(spark, sf, "message_updated"), "received_at", "2025-01-01 00:00:00", "session_id")


@query("select delivery_id, session_id from message_updated where received_at is null or received_at >= timestamp '2025-01-01'")
def snk10_kept(spark, sf):
    return S.kept_after(table(spark, sf, "message_updated"), "received_at", "2025-01-01 00:00:00").select("delivery_id", "session_id")


@query("""with s as (select session_id, min(parent_session_id) as parent_session_id, count(distinct id) as n_events from hook_events group by 1)
 select p.session_id, count(c.session_id) as n_children, cast(coalesce(sum(c.n_events), 0) as bigint) as child_events from s p left join s c on c.parent_session_id = p.session_id group by 1""")
def jn22_parent_child(spark, sf):
    """JN-22: sessions with their sub-sessions; children are added up before they meet their parents."""
    s = _events(spark, sf, "parent_session_id").groupBy("session_id").agg(F.min("parent_session_id").alias("parent_session_id"), F.count(F.lit(1)).alias("n_events"))
    c = s.filter("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("p")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_events").alias("child_events"))
    return s.join(c, F.col("session_id") == F.col("p"), "left").select("session_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("child_events", F.lit(0)).alias("child_events"))


_BEFORE_POST = """select a.id as pre_id, b.id as post_id, b.duration_ms from {e} a join {e} b on a.session_id = b.session_id and b.sequence_number = a.sequence_number + 1 and a.tool_type = b.tool_type
 where a.event_type = 'PreToolUse' and b.event_type = 'PostToolUse'"""


@query(_BEFORE_POST.format(e=_E.format("id, session_id, sequence_number, event_type, tool_type, duration_ms")))
def jn21_pre_post_pairs(spark, sf):
    """JN-21 in batch, see ``sessions.pre_post_pairs``.

    The SQL joins neighbours by tool type only, which leaves out those whose type is dirty on one side and joins different tools of one type.
    """
    e = table(spark, sf, "hook_events").filter("session_id is not null and event_type in ('PreToolUse', 'PostToolUse')")
    call = E.at(E.opened(F.col("metadata")), "$.call_id")
    return S.pre_post_pairs(e.select("id", "session_id", "sequence_number", "event_type", "tool_name", "tool_type", "duration_ms", call.alias("call_id"))).select("pre_id", "post_id", "duration_ms")


@query("""select session_id, sum(tokens.input)::bigint as input, sum(tokens.output)::bigint as output, sum(tokens.reasoning)::bigint as reasoning, sum(tokens.cache_read)::bigint as cache_read,
 sum(tokens.cache_write)::bigint as cache_write, sum(cast(round(cost * 100000) as bigint)) / 100000 as cost from message_updated group by 1""")
def agg18_session_totals(spark, sf):
    """AGG-18; costs are added in whole hundred-thousandths, so the order of rows can't change a sum."""
    m = table(spark, sf, "message_updated")
    cost = F.sum(F.round(F.col("cost") * 100000).cast("bigint")) / 100000
    return m.groupBy("session_id").agg(*[F.sum(f"tokens.{c}").alias(c) for c in ("input", "output", "reasoning", "cache_read", "cache_write")], cost.alias("cost"))


@query("""select lower(tool_name) as tool_name, case when lower(tool_name) in ({s}) then 'search' when lower(tool_name) in ({i}) then 'implementation' end as category, count(*) as n_rows from hook_events where tool_name is not null group by 1, 2""".format(
    s=", ".join(f"'{t}'" for t in E.SEARCH_TOOLS), i=", ".join(f"'{t}'" for t in E.IMPLEMENTATION_TOOLS)))
def sf29_tool_categories(spark, sf):
    return table(spark, sf, "hook_events").filter("tool_name is not null").groupBy(F.lower("tool_name").alias("tool_name"), E.tool_category(F.col("tool_name")).alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("""select id, session_id, k from (select distinct id, session_id, cast(json_extract_string(case when json_valid(metadata) then metadata end, '$.tool_input.file_path') as varchar) as a,
 json_extract_string(case when json_valid(metadata) then metadata end, '$.args.file_path') as b from hook_events where event_type = 'PostToolUse'), lateral (select coalesce(a, b) as k) where k is not null""")
def sf27_json_alternates(spark, sf):
    v = table(spark, sf, "hook_events").filter("event_type = 'PostToolUse'").select("id", "session_id", E.readable(F.col("metadata")).alias("v"))
    return v.select("id", "session_id", F.coalesce(E.at(F.col("v"), "$.tool_input.file_path"), E.at(F.col("v"), "$.args.file_path")).alias("k")).filter("k is not null").distinct()


@query("select event_type, count(*) as n, sum(cast(round(value * 10000) as bigint)) / 10000 as total from events group by 1 order by n desc, event_type limit 5")
def so01_top_types(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("value") * 10000).cast("bigint")) / 10000).alias("total")).orderBy(F.desc("n"), "event_type").limit(5)


@query("""select user_id, max(case when e.gap then 1 else 0 end) as split, count(*) as n, sum(case when e.gap then 1 else 0 end) as n_gaps from
 (select user_id, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hour, false) as gap from events) e group by 1""", n_gaps="bigint")
def ss09_session_gaps(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours"), F.lit(False))
    return table(spark, sf, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.max(F.col("gap").cast("int")).alias("split"), F.count(F.lit(1)).alias("n"), F.count_if("gap").alias("n_gaps"))
