"""Queries on transcripts and todo plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.functions import events as E
from opstrata.operators import todo_plans as P
from opstrata.operators import transcripts as T
from opstrata.plans.registry import registry
from opstrata.sources.tables import table

QUERIES, ORACLES, query = registry()


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return T.session_lines(table(spark, sf, "transcript"), table(spark, sf, "hook_events"), *columns)


def _list(names) -> str:
    return ", ".join(f"'{t}'" for t in names)


_CAT = f"case when lower({{n}}) = 'task' then case when contains(lower(coalesce({{s}}, '')), 'explore') then 'search' else 'implementation' end when lower({{n}}) in ({_list(E.SEARCH_TOOLS)}) then 'search' when lower({{n}}) in ({_list(E.IMPLEMENTATION_TOOLS)}) then 'implementation' end"
_L = "l as (select t.line_id as line, e.session_id, t.type, case when json_valid(t.message) then t.message end as m, t.* exclude (line_id, session_id, type) from transcript t join (select distinct id, session_id from hook_events where session_id is not null) e on t.event_id = e.id)"
_ELEMENTS = "(select line, session_id, unnest(from_json(json_extract(m, '$.{f}'), '[\"json\"]')) as c from l where json_type(m, '$.{f}') = 'ARRAY')"
_TURNS_A = f"""tools as (select line, count(*) as n_tools, count(*) filter (where {_CAT.format(n="json_extract_string(c, '$.name')", s="json_extract_string(c, '$.input.subagent_type')")} = 'search') as n_explore
 from {_ELEMENTS.format(f="content")} where json_extract_string(c, '$.type') = 'tool_use' group by 1),
 t as (select session_id, line, input, output, coalesce(n_tools, 0) as n_tools, coalesce(n_explore, 0) as n_explore from
 (select session_id, line, coalesce(cast(json_extract_string(m, '$.usage.input_tokens') as bigint), 0) as input, coalesce(cast(json_extract_string(m, '$.usage.output_tokens') as bigint), 0) as output from l
 where lower(trim(type)) = 'assistant' and json_type(m, '$.usage') = 'OBJECT') left join tools using (line) where input > 0 or output > 0)"""
_TURNS_B = f"""tools as (select line, count(*) as n_tools, count(*) filter (where {_CAT.format(n="json_extract_string(c, '$.tool')", s="''")} = 'search' and lower(json_extract_string(c, '$.tool')) <> 'task') as n_explore
 from {_ELEMENTS.format(f="parts")} where json_extract_string(c, '$.type') = 'tool' group by 1),
 t as (select session_id, line, input, output, case when explorer then 1 else coalesce(n_tools, 0) end as n_tools, case when explorer then 1 else coalesce(n_explore, 0) end as n_explore from
 (select session_id, line, coalesce(cast(json_extract_string(m, '$.tokens.input') as bigint), 0) as input, coalesce(cast(json_extract_string(m, '$.tokens.output') as bigint), 0) + coalesce(cast(json_extract_string(m, '$.tokens.reasoning') as bigint), 0) as output,
 coalesce(lower(json_extract_string(m, '$.agent')) in ('explore', 'search'), false) as explorer from l where type is null and json_type(m, '$.tokens') = 'OBJECT' and lower(trim(json_extract_string(m, '$.role'))) = 'assistant') left join tools using (line))"""
_ADDED = "a as (select *, greatest(input - coalesce(lag(input) over (partition by session_id order by line), 0), 0) as added from t)"
_PART = "sum(case when n_tools = 0 or n_explore = 0 then {z} when n_explore = n_tools then {f} else cast(floor({x} * {r}) as bigint) end)::bigint"
_SHARE = "(n_explore / n_tools)"
_USAGE = f"""select session_id, count(*) as turns, sum(added)::bigint as input_tokens, sum(output)::bigint as output_tokens,
 {_PART.format(x="added", z="0", f="added", r=_SHARE)} as explore_input, {_PART.format(x="added", z="added", f="0", r=f"(1 - {_SHARE})")} as implement_input,
 {_PART.format(x="output", z="0", f="output", r=_SHARE)} as explore_output, {_PART.format(x="output", z="output", f="0", r=f"(1 - {_SHARE})")} as implement_output, arg_max(input, line) as final_context from a group by 1"""


@query(f"with {_L}, {_TURNS_A}, {_ADDED} select session_id, line, input, output, added from a")
def wn02_incremental_tokens(spark, sf):
    return T.incremental(T.turns_a(_lines(spark, sf, "type", "message"))).select("session_id", "line", "input", "output", "added")


@query(f"with {_L}, {_TURNS_A}, {_ADDED} {_USAGE}")
def cp03_token_usage_a(spark, sf):
    return T.usage(T.turns_a(_lines(spark, sf, "type", "message")))


@query(f"with {_L}, {_TURNS_B}, {_ADDED} {_USAGE}")
def cp03_token_usage_b(spark, sf):
    return T.usage(T.turns_b(_lines(spark, sf, "type", "message")))


@query(f"""with {_L}, c as {_ELEMENTS.format(f="content")}, u as (select session_id, tool_id, arg_min(category, line) as category, min(line) as use_line from (select session_id, line, json_extract_string(c, '$.id') as tool_id,
 coalesce({_CAT.format(n="json_extract_string(c, '$.name')", s="json_extract_string(c, '$.input.subagent_type')")}, 'implementation') as category from c where json_extract_string(c, '$.type') = 'tool_use') where tool_id is not null group by 1, 2),
 r as (select session_id, line, json_extract_string(list_filter(from_json(json_extract(m, '$.content'), '["json"]'), lambda x: json_extract_string(x, '$.type') = 'tool_result')[1], '$.tool_use_id') as tool_id,
 try_cast(json_extract_string(case when json_valid(tool_use_result) then tool_use_result end, '$.totalTokens') as bigint) as tokens from l where tool_use_result is not null and json_type(m, '$.content') = 'ARRAY')
 select r.session_id, case when u.category = 'search' and u.use_line < r.line then 'explore' else 'other' end as kind, count(*) as results, sum(tokens)::bigint as tokens from r left join u using (session_id, tool_id)
 where tokens is not null and tool_id is not null group by 1, 2""")
def jn06_subagent_tokens(spark, sf):
    return T.subagent_tokens(_lines(spark, sf, "type", "message", "tool_use_result"))


@query(f"""with {_L}, p as (select b.session_id, b.uuid, s.line as summary_line, max(b.line) as line, arg_max(b.compact_metadata, b.line) as cm from l b join l s on b.session_id = s.session_id and b.uuid = s.parent_uuid and b.line < s.line
 where lower(trim(b.type)) = 'system' and b.subtype = 'compact_boundary' and s.is_compact_summary group by 1, 2, 3)
 select session_id, line, min(summary_line) as summary_line, coalesce(json_extract_string(min(cm), '$.trigger'), 'unknown') as trigger, coalesce(cast(json_extract_string(min(cm), '$.preTokens') as bigint), 0) as pre_tokens from p group by 1, 2""")
def cp04_compactions(spark, sf):
    return T.compactions(_lines(spark, sf, "type", "subtype", "uuid", "parent_uuid", "is_compact_summary", "compact_metadata"))


@query(f"""with {_L}, n as (select *, row_number() over (partition by session_id order by line) as n from l)
 select b.session_id, b.line, max(u.n) as found from n b left join n u on b.session_id = u.session_id and u.n between b.n - 50 and b.n - 1 and lower(trim(u.type)) in ('user', 'human') where b.subtype = 'compact_boundary' group by 1, 2""")
def jn05_nearest_user_line(spark, sf):
    """JN-05, CP-04: the nearest user line with /compact at most 50 lines before a boundary, and its text. The SQL takes any user line and has no text."""
    return T.compact_instructions(_lines(spark, sf, "type", "subtype", "message"))


@query(f"""with {_L} select session_id, arg_min(version, line) filter (where version is not null) as version, arg_min(git_branch, line) filter (where git_branch is not null) as git_branch,
 arg_min(model, line) filter (where model is not null) as model, count(*) as lines from (select *, case when lower(trim(type)) = 'assistant' then json_extract_string(m, '$.model') end as model from l) group by 1""")
def src04_transcript_metadata(spark, sf):
    return T.metadata(_lines(spark, sf, "type", "message", "version", "git_branch"))


@query(f"""with {_L} select session_id, count(*) as lines, count(*) filter (where message is not null and m is null) as unreadable from l group by 1""")
def src03_line_scan(spark, sf):
    """SRC-03: lines per session, unreadable ones counted instead of failing."""
    bad = F.col("message").isNotNull() & E.readable(F.col("message")).isNull()
    return _lines(spark, sf, "message").groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("unreadable"))


@query("""with s as (select session_id, arg_max(m, sequence_number) as m from (select id, session_id, sequence_number, max(case when json_valid(metadata) then metadata end) as m from hook_events where event_type = 'Stop' and source = 'opencode' group by 1, 2, 3) where m is not null group by 1)
 select session_id, generate_subscripts(x, 1) - 1 as pos, json_extract_string(unnest(x), '$.role') as role from (select session_id, from_json(json_extract(m, '$.transcript'), '["json"]') as x from s where json_type(m, '$.transcript') = 'ARRAY')""", pos="int")
def src05_embedded_transcripts(spark, sf):
    """SRC-05: the transcript inside the last readable stop event of a session, a row per message."""
    e = P._once(table(spark, sf, "hook_events"), "event_type = 'Stop' and source = 'opencode'").filter("metadata is not null")
    last = e.groupBy("session_id").agg(F.max_by("metadata", "sequence_number").alias("m"))
    return last.select("session_id", F.posexplode(F.from_json("m", "transcript array<struct<role:string>>")["transcript"]).alias("pos", "x")).select("session_id", "pos", F.col("x.role").alias("role"))


_READS = """with m as (select id, session_id, sequence_number as seq, lower(tool_name) as tool, max(case when json_valid(metadata) then metadata end) as m from hook_events where event_type = 'PostToolUse' and lower(tool_name) in ('read', 'edit', 'write', 'multiedit') group by 1, 2, 3, 4),
 f as (select session_id, seq, tool = 'read' as is_read, coalesce(json_extract_string(m, '$.tool_input.file_path'), json_extract_string(m, '$.args.file_path')) as path from m),
 g as (select session_id, path, min(seq) filter (where is_read) as first_read, min(seq) filter (where not is_read) as first_edit from f where ends_with(path, '.py') group by 1, 2)"""


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    e = P._once(table(spark, sf, "hook_events"), "event_type = 'PostToolUse' and lower(tool_name) in ('read', 'edit', 'write', 'multiedit')", "tool_name")
    v = E.readable(F.col("metadata"))
    path = F.coalesce(E.at(v, "$.tool_input.file_path"), E.at(v, "$.args.file_path"))
    f = e.select("session_id", F.col("sequence_number").alias("seq"), (F.lower("tool_name") == "read").alias("is_read"), path.alias("path")).filter("endswith(path, '.py')")
    return f.groupBy("session_id", "path").agg(F.min(F.when(F.col("is_read"), F.col("seq"))).alias("first_read"), F.min(F.when(~F.col("is_read"), F.col("seq"))).alias("first_edit"))


@query(f"{_READS} select session_id, path, first_read, first_edit, coalesce(first_read < first_edit, false) as read_before from g where first_edit is not null")
def jn07_read_before_edit(spark, sf):
    """WN-10, JN-07: edited files with their first read and edit; read before means strictly earlier."""
    return _reads(spark, sf).filter("first_edit is not null").withColumn("read_before", F.coalesce(F.col("first_read") < F.col("first_edit"), F.lit(False)))


@query(f"{_READS} select session_id, count(*) filter (where first_edit is not null) as n_edited, count(*) filter (where first_read is not null) as n_read, coalesce(avg(case when first_edit is not null then case when first_read < first_edit then 1.0 else 0.0 end end), 1.0) as read_ratio from g group by 1")
def agg17_read_ratio(spark, sf):
    """AGG-17: the share of edited files that were read before; 1 without edits."""
    ratio = F.avg(F.when(F.col("first_edit").isNotNull(), F.when(F.col("first_read") < F.col("first_edit"), 1.0).otherwise(0.0)))
    return _reads(spark, sf).groupBy("session_id").agg(F.count("first_edit").alias("n_edited"), F.count("first_read").alias("n_read"), F.coalesce(ratio, F.lit(1.0)).alias("read_ratio"))


_SNAPS = f"""with e as (select id, session_id, sequence_number as seq, event_type, max(case when json_valid(metadata) then metadata end) as m from hook_events where event_type = 'TodoUpdated' or (event_type = 'PostToolUse' and lower(tool_name) = 'todowrite') group by 1, 2, 3, 4),
 j as (select session_id, seq, event_type, max(case when event_type = 'TodoUpdated' then 1 else 0 end) over (partition by session_id) as own, case when event_type = 'TodoUpdated' then case when json_type(m, '$.todos') = 'ARRAY' then json_extract(m, '$.todos') end
  else coalesce(case when json_type(m, '$.tool_input.todos') = 'ARRAY' then json_extract(m, '$.tool_input.todos') end, case when json_type(m, '$.args.todos') = 'ARRAY' then json_extract(m, '$.args.todos') end) end as t from e),
 k as (select session_id, seq, t, json_array_length(t) as n from j where t is not null and (own = 1) = (event_type = 'TodoUpdated') and not (event_type = 'TodoUpdated' and json_array_length(t) = 0)),
 s as (select session_id, seq, t, row_number() over (partition by session_id order by seq) as step from (select *, lag(n, 1, 0) over (partition by session_id order by seq) as pn from k) where n > 0 or pn > 0),
 r as (select session_id, step, json_extract_string(c, '$.content') as content, arg_max(json_extract_string(c, '$.status'), pos) as status from (select session_id, step, unnest(from_json(t, '["json"]')) as c, generate_subscripts(from_json(t, '["json"]'), 1) as pos from s) where json_extract_string(c, '$.content') is not null group by 1, 2, 3),
 d as (select coalesce(a.session_id, b.session_id) as session_id, coalesce(a.step, b.step + 1) as step, coalesce(a.content, b.content) as content, case when b.content is null then 'added' when a.content is null then 'removed' when a.status is distinct from b.status then 'changed' else 'same' end as what, a.status
  from r a full join r b on a.session_id = b.session_id and a.step = b.step + 1 and a.content = b.content),
 c as (select s.session_id, s.step, s.seq, count(*) filter (where what in ('added', 'changed', 'same')) as n_todos, count(*) filter (where what = 'added') as n_added, count(*) filter (where what = 'removed') as n_removed, count(*) filter (where what = 'changed') as n_changed,
  count(*) filter (where what = 'changed' and status = 'completed') as n_completed from s left join d using (session_id, step) group by 1, 2, 3)"""
_TOOLS = f""", x as (select id, session_id, sequence_number as seq, tool_name, max(case when json_valid(metadata) then metadata end) as m from hook_events where event_type = 'PostToolUse' and lower(tool_name) not in ({_list(P.NOT_COUNTED)}) group by 1, 2, 3, 4),
 y as (select x.session_id, x.seq, {_CAT.format(n="tool_name", s="coalesce(json_extract_string(m, '$.tool_input.subagent_type'), json_extract_string(m, '$.args.subagent_type'))")} as category, (select min(step) from s where s.session_id = x.session_id and s.seq > x.seq) as step from x),
 z as (select session_id, step, count(*) as events, count(*) filter (where category = 'search') as search, count(*) filter (where category = 'implementation') as implementation from y where step is not null group by 1, 2)"""


@query(f"{_SNAPS} select * from c", step="int", n_todos="int", n_added="int", n_removed="int", n_changed="int", n_completed="int")
def wn06_todo_differences(spark, sf):
    d = P.differences(P.snapshots(table(spark, sf, "hook_events")))
    return d.select("session_id", "step", "seq", F.size("todos").alias("n_todos"), *[F.size(c).alias(f"n_{c}") for c in ("added", "removed", "changed", "completed")])


@query(f"{_SNAPS}{_TOOLS} select s.session_id, s.step, coalesce(events, 0) as events, coalesce(search, 0) as search, coalesce(implementation, 0) as implementation from s left join z using (session_id, step)", step="int")
def wn07_plan_islands(spark, sf):
    return P.steps(table(spark, sf, "hook_events")).select("session_id", "step", "events", "search", "implementation")


@query(f"""{_SNAPS}{_TOOLS}, l as (select session_id, max(step) as step from s group by 1), q as (select s.session_id, count(*) as n_steps, sum(coalesce(events, 0)) as ev, sum(coalesce(search, 0)) as se, sum(coalesce(implementation, 0)) as im from s left join z using (session_id, step) group by 1),
 o as (select session_id, count(distinct content) filter (where what in ('added', 'changed')) as n_created, count(distinct content) filter (where (what = 'changed' and status = 'completed') or (status = 'completed' and step = ls)) as n_completed
  from (select d.*, l.step as ls from d join l using (session_id) where d.step <= l.step) group by 1)
 select session_id, n_steps, coalesce(n_created, 0) as n_created, coalesce(n_completed, 0) as n_completed, coalesce(n_completed / nullif(n_created, 0), 0) as efficiency, ev / n_steps as events_per_step, coalesce(se * 100 / nullif(se + im, 0), 0) as exploration_percent
 from q left join o using (session_id)""")
def cp02_plan_evolution(spark, sf):
    return P.evolution(P.steps(table(spark, sf, "hook_events")))


@query("""select session_id, count(*) filter (where event_type = 'TodoUpdated') > 0 as own_todos, count(distinct id) as n from hook_events where event_type = 'TodoUpdated' or lower(tool_name) = 'todowrite' group by 1""")
def wn09_source_precedence(spark, sf):
    e = table(spark, sf, "hook_events").filter("session_id is not null and (event_type = 'TodoUpdated' or lower(tool_name) = 'todowrite')").select("id", "session_id", "event_type").distinct()
    return e.groupBy("session_id").agg((F.count_if(F.col("event_type") == "TodoUpdated") > 0).alias("own_todos"), F.count_distinct("id").alias("n"))
