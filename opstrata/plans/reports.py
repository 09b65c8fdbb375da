"""Queries that join sessions, files and histories into reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions import scoring
from opstrata.operators import code as C
from opstrata.operators import metrics as M
from opstrata.operators import sessions as S
from opstrata.operators import transcripts as T
from opstrata.plans import code as code_plans
from opstrata.plans import commits as commit_plans
from opstrata.plans import metrics as metric_plans
from opstrata.plans import transcripts as transcript_plans
from opstrata.plans.registry import registry
from opstrata.sources.sinks import pending_migrations
from opstrata.sources.tables import table

QUERIES, ORACLES, query = registry()


#: Fixed value: characters kept of a tool's output.
OUTPUT_CHARACTERS = 10_000
_READS, _PATHS = transcript_plans._READS, code_plans._PATHS
_SNAP = ", ".join((metric_plans._S, metric_plans._F))


def _snaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.snapshots(table(spark, sf, "code_quality_cache"))


@query("""with s as (select session_id, arg_max(m, sequence_number) as m from (select id, session_id, sequence_number, max(case when json_valid(metadata) then metadata end) as m from hook_events where event_type = 'Stop' and source = 'opencode' group by 1, 2, 3) where m is not null group by 1),
 x as (select session_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as v from (select session_id, from_json(json_extract(m, '$.transcript'), '["json"]') as a from s where json_type(m, '$.transcript') = 'ARRAY')),
 l as (select session_id, pos, v, lead(v) over (partition by session_id order by pos) as n from x)
 select session_id, pos, case when p->>'$.auto' = 'true' then 'auto' else 'manual' end as trigger, coalesce(try_cast(n->>'$.tokens.input' as bigint), 0) as pre_tokens from
 (select *, list_filter(from_json(json_extract(v, '$.parts'), '["json"]'), lambda p: p->>'$.type' = 'compaction')[1] as p from l where json_type(v, '$.parts') = 'ARRAY') where p is not null and v->>'$.role' = 'user' and n->>'$.role' = 'assistant' and n->>'$.agent' = 'compaction'""", pos="int")
def jn04_compactions_b(spark, sf):
    """JN-04, CP-04 of dialect B."""
    e = transcript_plans.P._once(table(spark, sf, "hook_events"), "event_type = 'Stop' and source = 'opencode'").filter("metadata is not null")
    return T.compactions_b(e.groupBy("session_id").agg(F.max_by("metadata", "sequence_number").alias("m")))


@query(f"""select session_id, count(*) as n, sum(pre_tokens)::bigint as pre_tokens from ({transcript_plans.ORACLES["cp04_compactions"]}) group by 1""")
def agg20_pre_compaction_tokens(spark, sf):
    return transcript_plans.cp04_compactions(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pre_tokens").alias("pre_tokens"))


@query(f"""{_READS}, {_SNAP}, k as (select path, max(tokens) as tokens from f where path is not null group by 1), e as (select session_id, path from g where first_edit is not null)
 select session_id, count(*) as n_edited, count(k.path) as n_known, sum(coalesce(tokens, 0))::bigint as tokens from e left join k using (path) group by 1""".replace("f as (select session_id, seq", "ff as (select session_id, seq").replace("from f where ends_with", "from ff where ends_with"))
def jn12_edited_tokens(spark, sf):
    """JN-12/13: the files that a session edited, how many of them were measured, and their tokens, 0 where unknown."""
    known = M.file_rows(_snaps(spark, sf)).filter("path is not null").groupBy("path").agg(F.max("tokens").alias("tokens"), F.lit(1).alias("known"))
    e = transcript_plans._reads(spark, sf).filter("first_edit is not null").select("session_id", "path")
    return e.join(known, "path", "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_edited"), F.count("known").alias("n_known"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


@query(f"""{_READS}, {_PATHS}, {code_plans._TESTS.split(", t as")[0].replace("from p)", "from (select distinct path from g where first_edit is not null))")}, t as{code_plans._TESTS.split(", t as")[1]}
 select distinct g.session_id, test from g join s using (path) join t on starts_with(test, 'tests/') and contains(test, 'test_' || name) where first_edit is not null and not exists (select 1 from g h where h.session_id = g.session_id and regexp_replace(h.path, '^tests/', 'tests/test_') = test and h.first_read is not null)""")
def jn15_unread_tests(spark, sf):
    """JN-15: tests of edited files that the session didn't read."""
    r = transcript_plans._reads(spark, sf)
    e = r.filter("first_edit is not null").select("session_id", "path")
    tests = code_plans.tests_of(e, code_plans._paths(spark, sf))
    read = r.filter("first_read is not null").select("session_id", F.regexp_replace("path", "^tests/", "tests/test_").alias("test"))
    return e.join(tests, "path").select("session_id", "test").distinct().join(read, ["session_id", "test"], "left_anti")


@query("""with g as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem), e as (select distinct o_custkey as session_id, 'o' || o_orderkey as path from orders), r as (select distinct o_custkey as session_id, 'p' || l_partkey as path from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R')
 select e.session_id, e.path, count(g.dst) as imports, count(r.path) as imports_read, count(g.dst) - count(r.path) as n_blind from e left join g on e.path = g.src left join r on r.session_id = e.session_id and r.path = g.dst group by 1, 2""", n_blind="int")
def cp05_context_coverage(spark, sf):
    """CP-05, JN-08, ST-04; orders stand for edited files, their parts for imports, returned parts for files read."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "l_returnflag")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    graph = lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), "dst").distinct()
    read = orders.join(lines.filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select("session_id", F.col("dst").alias("path"))
    tests = spark.createDataFrame([], "path string, test string")
    d = C.coverage(orders.select("session_id", "path"), read, graph, tests)
    return d.select("session_id", "path", "imports", "imports_read", F.size("blind_spots").alias("n_blind"))


@query("""select project_path, max(id) as id, arg_max(qpe_score, id) as latest, max(qpe_score) as best, count(*) as n from (select distinct id, project_path, qpe_score from qpe_leaderboard) group by 1""")
def jn19_latest_progress(spark, sf):
    """JN-19: each run with its latest and best progress."""
    b = table(spark, sf, "qpe_leaderboard").select("id", "project_path", "qpe_score").distinct()
    return b.groupBy("project_path").agg(F.max("id").alias("id"), F.max_by("qpe_score", "id").alias("latest"), F.max("qpe_score").alias("best"), F.count(F.lit(1)).alias("n"))


@query("""select 'message_updated' as child, count(*) as n_orphans from message_updated m where not exists (select 1 from hook_events h where h.session_id = m.session_id)
 union all select 'code_quality_cache', count(*) from code_quality_cache m where not exists (select 1 from hook_events h where h.session_id = m.session_id) union all select 'transcript', count(*) from transcript t where not exists (select 1 from hook_events h where h.id = t.event_id)""")
def jn25_integrity(spark, sf):
    """JN-25: rows whose parent is missing."""
    h = table(spark, sf, "hook_events")
    count = lambda name, d: d.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("child"), "n_orphans")
    by_session = [count(t, table(spark, sf, t).select("session_id").join(h.select("session_id").distinct(), "session_id", "left_anti")) for t in ("message_updated", "code_quality_cache")]
    lines = table(spark, sf, "transcript").select(F.col("event_id").alias("id")).join(h.select("id").distinct(), "id", "left_anti")
    return by_session[0].unionByName(by_session[1]).unionByName(count("transcript", lines))


@query("""select session_id, bool_or(logged) as logged, bool_or(told) as told from (select session_id, true as logged, false as told from hook_events where session_id is not null union all select session_id, false, true from transcript where session_id is not null) group by 1""")
def jn24_session_union(spark, sf):
    """JN-24, ST-02: the union of the sessions that two sources know, and which of them does."""
    one = lambda t, a, b: table(spark, sf, t).filter("session_id is not null").select("session_id", F.lit(a).alias("logged"), F.lit(b).alias("told")).distinct()
    return one("hook_events", True, False).unionByName(one("transcript", False, True)).groupBy("session_id").agg(F.bool_or("logged").alias("logged"), F.bool_or("told").alias("told"))


@query("""select c_custkey, count(o_orderkey) as n, coalesce(sum(cast(o_totalprice as decimal(18,2))), 0)::double as total, count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as n_high from customer left join orders on c_custkey = o_custkey group by 1""")
def agg22_objective_totals(spark, sf):
    """AGG-22: parents with number, total and urgent ones of their children; children are added up before the join."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_high"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", zero("n").alias("n"), zero("total").cast("double").alias("total"), zero("n_high").alias("n_high"))


@query("""select project_name, string_agg(kind, ',' order by kind) as kinds, count(*) as n_kinds from (select distinct project_name, kind from documents where kind is not null) group by 1""", n_kinds="int")
def agg24_distinct_sets(spark, sf):
    """AGG-24, SO-08: the sorted set of kinds of each project."""
    d = table(spark, sf, "documents").filter("kind is not null").groupBy("project_name").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    return d.select("project_name", F.array_join("k", ",").alias("kinds"), F.size("k").alias("n_kinds"))


@query("""select session_id, strftime(min(received_at), '%Y-%m-%d %H:%M') as started, case when count(*) > 1 then (epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1000000 end as seconds from message_updated group by 1""")
def wn17_durations(spark, sf):
    """WN-17, SF-26: start as text and duration of each session; null while there is only one message."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    a, b = F.min("received_at"), F.max("received_at")
    return table(spark, sf, "message_updated").groupBy("session_id").agg(F.date_format(a, "yyyy-MM-dd HH:mm").alias("started"), F.when(F.count(F.lit(1)) > 1, (us(b) - us(a)) / 1_000_000).alias("seconds"))


@query("""select project_path, id, qpe_score, row_number() over (partition by project_path order by id desc) as position from (select distinct id, project_path, qpe_score from qpe_leaderboard)""", position="int")
def so02_project_history(spark, sf):
    b = table(spark, sf, "qpe_leaderboard").select("id", "project_path", "qpe_score").distinct()
    return b.withColumn("position", F.row_number().over(W.partitionBy("project_path").orderBy(F.desc("id"))))


@query("""select id, project_path, smell_penalty from (select distinct id, project_path, smell_penalty from qpe_leaderboard) order by abs(smell_penalty - 0.2) desc, project_path, id limit 25""")
def so03_multi_key_sort(spark, sf):
    return table(spark, sf, "qpe_leaderboard").select("id", "project_path", "smell_penalty").distinct().orderBy(F.desc(F.abs(F.col("smell_penalty") - 0.2)), "project_path", "id").limit(25)


@query("""select session_id, array_to_string(t[1:3], ',') as first_tools, greatest(len(t) - 3, 0) as more from (select session_id, list_sort(list(distinct tool_type)) as t from hook_events where tool_type is not null group by 1)""", more="int")
def so06_first_tools(spark, sf):
    """SO-06/08: the first three of each session's sorted tools and how many more there are."""
    t = table(spark, sf, "hook_events").filter("tool_type is not null and session_id is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("tool_type")).alias("t"))
    return t.select("session_id", F.array_join(F.slice("t", 1, 3), ",").alias("first_tools"), F.greatest(F.size("t") - 3, F.lit(0)).alias("more"))


@query(f"with {metric_plans._REG} select smell, category, weight::double as weight, row_number() over (partition by category order by weight desc, smell) as rank from reg", rank="int")
def so09_registry(spark, sf):
    return M.registry(spark).withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(F.desc("weight"), "smell")))


@query("""with a as (select distinct session_id, tool_type from hook_events where event_type = 'PreToolUse' and tool_type is not null), b as (select distinct session_id, tool_type from hook_events where event_type = 'PostToolUse' and tool_type is not null)
 select session_id, tool_type, 'called only' as what from (select * from a except select * from b) union all select session_id, tool_type, 'both' from (select * from a intersect select * from b) union all select session_id, tool_type, 'answered only' from (select * from b except select * from a)""")
def st01_set_operations(spark, sf):
    """ST-01/03/05: differences and intersection of two sets, in one aggregation instead of three set operations."""
    e = table(spark, sf, "hook_events").filter("tool_type is not null and session_id is not null and event_type in ('PreToolUse', 'PostToolUse')")
    d = e.groupBy("session_id", "tool_type").agg(F.bool_or(F.col("event_type") == "PreToolUse").alias("a"), F.bool_or(F.col("event_type") == "PostToolUse").alias("b"))
    return d.select("session_id", "tool_type", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "called only").otherwise("answered only").alias("what"))


@query(f"""with {_PATHS} select path, '^(from|import)\\s+' || replace(m, '.', '\\.') || '(\\s|$|,)' as pattern from (select path, replace(regexp_replace(regexp_replace(path, '^src/', ''), '(/__init__)?\\.py$', ''), '/', '.') as m from p) where m <> ''""")
def sf06_import_patterns(spark, sf):
    """SF-06: the pattern of lines that import a file."""
    m = F.replace(F.regexp_replace(F.regexp_replace("path", "^src/", ""), r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    d = code_plans._paths(spark, sf).select("path", m.alias("m")).filter("m <> ''")
    return d.select("path", F.concat(F.lit(r"^(from|import)\s+"), F.replace("m", F.lit("."), F.lit(r"\.")), F.lit(r"(\s|$|,)")).alias("pattern"))


@query("""select id, sha256(concat_ws(':', coalesce(commit_sha, 'unknown'), coalesce(working_tree_hash, 'clean'), repository_path, calculator_version)) as key from code_quality_cache""")
def sf08_feedback_key(spark, sf):
    """SF-08: one key of what a feedback depends on."""
    return table(spark, sf, "code_quality_cache").select("id", F.sha2(F.concat_ws(":", F.coalesce("commit_sha", F.lit("unknown")), F.coalesce("working_tree_hash", F.lit("clean")), "repository_path", "calculator_version"), 256).alias("key"))


@query("""with b as (select distinct id, project_path, qpe_weight_version, metrics_json from qpe_leaderboard) select id, coalesce(metrics_json is not null and qpe_weight_version = (select max(qpe_weight_version) from b), false) as valid from b""")
def pf10_validity(spark, sf):
    """PF-10: whether a stored result may be used again."""
    b = table(spark, sf, "qpe_leaderboard").select("id", "project_path", "qpe_weight_version", "metrics_json").distinct()
    newest = b.agg(F.max("qpe_weight_version").alias("newest"))
    return b.select("id", F.coalesce(F.col("metrics_json").isNotNull() & (F.col("qpe_weight_version") == newest.scalar()), F.lit(False)).alias("valid"))


@query(f"select session_id, read_ratio < 1.0 as has_gaps from ({transcript_plans.ORACLES['agg17_read_ratio']})")
def pf16_has_gaps(spark, sf):
    return transcript_plans.agg17_read_ratio(spark, sf).select("session_id", (F.col("read_ratio") < 1.0).alias("has_gaps"))


@query("""select distinct line_id, unnest(regexp_extract_all(message, 'plans/([a-z0-9-]+\\.md)', 1)) as plan from transcript where contains(message, 'plans/')""")
def src24_plan_names(spark, sf):
    return table(spark, sf, "transcript").filter(F.col("message").contains("plans/")).select("line_id", F.explode(F.regexp_extract_all("message", F.lit(r"plans/([a-z0-9-]+\.md)"), F.lit(1))).alias("plan")).distinct()


@query("""select distinct id, left(json_extract_string(m, '$.output'), 500) as output, length(json_extract_string(m, '$.output')) as n from (select id, case when json_valid(metadata) then metadata end as m from hook_events where event_type = 'PostToolUse') where json_extract_string(m, '$.output') is not null""", n="int")
def src27_shaped_output(spark, sf):
    """SRC-27: texts of tool results, bounded at 10,000 characters. The SQL cuts at 500, the bound of message texts; no output of the test tables is longer."""
    o = F.try_variant_get(F.try_parse_json("metadata"), "$.output", "string")
    return table(spark, sf, "hook_events").filter("event_type = 'PostToolUse'").select("id", o.alias("o")).filter("o is not null").select("id", F.left("o", F.lit(OUTPUT_CHARACTERS)).alias("output"), F.length("o").alias("n")).distinct()


@query(f"""select id, to_json({{'id': id, 'n_added': n_added, 'n_removed': n_removed, 'n_changed': n_changed, 'complexity_change': complexity_change}})::varchar as summary from ({metric_plans.ORACLES["cp07_snapshot_delta"]})""")
def snk13_json_summary(spark, sf):
    """SNK-13: a compact summary for machines."""
    return metric_plans.cp07_snapshot_delta(spark, sf).select("id", F.to_json(F.struct("id", "n_added", "n_removed", "n_changed", "complexity_change")).alias("summary"))


@query(f"""with d as ({metric_plans.ORACLES["cp07_snapshot_delta"]}), c as ({metric_plans.ORACLES["jn01_file_changes"]}), {_SNAP}, k as (select c.id, sum(coalesce(f.tokens, 0))::bigint as changed_tokens, count(*) as n_changed_files from c left join f on f.id = c.id and f.path = c.path where what in ('added', 'changed') group by 1)
 select d.id, d.complexity_change, coalesce(n_changed_files, 0) as n_changed_files, coalesce(changed_tokens, 0) as changed_tokens, case when d.complexity_change < 0 then 'down' when d.complexity_change > 0 then 'up' else 'same' end as direction from d left join k using (id)""")
def cp10_current_impact(spark, sf):
    """CP-10: a snapshot against the one before it, with the tokens of the files it changed."""
    s = _snaps(spark, sf)
    files, pair = M.file_rows(s), M.pairs(s)
    ch = M.file_changes(files, pair)
    k = ch.filter("what in ('added', 'changed')").join(files.select("id", "path", "tokens"), ["id", "path"], "left").groupBy("id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("changed_tokens"), F.count(F.lit(1)).alias("n_changed_files"))
    d = M.delta(ch).join(k, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    direction = F.when(F.col("complexity_change") < 0, "down").when(F.col("complexity_change") > 0, "up").otherwise("same")
    return d.select("id", "complexity_change", zero("n_changed_files"), zero("changed_tokens"), direction.alias("direction"))


@query(f"""with {_SNAP}, t as (select id, avg(mi::double) filter (where starts_with(path, 'src/')) / 100 as a, avg(mi::double) filter (where starts_with(path, 'lib/')) / 100 as b from f group by 1)
 select id, round(a, 10) as a, round(b, 10) as b, case when abs(b - a) < 0.01 then 'tie' when b > a then 'B' else 'A' end as winner from t where a is not null and b is not null""")
def cp13_subtree_comparison(spark, sf):
    """CP-13: two sub-trees of a snapshot by their maintainability, with a dead band."""
    mean = lambda p: F.avg(F.when(F.col("path").startswith(p), F.col("mi").cast("double"))) / 100
    t = M.file_rows(_snaps(spark, sf)).groupBy("id").agg(mean("src/").alias("a"), mean("lib/").alias("b")).filter("a is not null and b is not null")
    return t.select("id", F.round("a", 10).alias("a"), F.round("b", 10).alias("b"), scoring.winner(F.col("a"), F.col("b")).alias("winner"))


@query("""select distinct id, round(case when r <= 1 then r else 1 - 2 * (r - 1) end, 8) as score from (select id, total_effort / greatest(100000, 1.0) as r from qpe_leaderboard)""")
def sf17_completion(spark, sf):
    """SF-17, CP-15: how far each run has come to a target effort."""
    return table(spark, sf, "qpe_leaderboard").select("id", F.round(scoring.completion(F.col("total_effort"), F.lit(100000.0)), 8).alias("score")).distinct()


@query(f"""with f as (select c.id, c.repository_path, coalesce(sum(n_related), 0)::bigint as n from code_quality_cache c left join ({metric_plans.ORACLES["cp16_scoped_smells"]}) k using (id) group by 1, 2), l as (select *, lag(n) over (partition by repository_path order by id) as last from f)
 select id, case when n > 0 then 'block' else 'pass' end as decision, n as n_blocking from l where n is distinct from last""")
def cp17_stop_feedback(spark, sf):
    """CP-17, SNK-14, PF-14: a decision for each snapshot whose finding differs from the one before of its repository."""
    scoped = metric_plans.cp16_scoped_smells(spark, sf).groupBy("id").agg(F.sum("n_related").alias("n"))
    f = table(spark, sf, "code_quality_cache").select("id", "repository_path").join(scoped, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = f.withColumn("last", F.lag("n").over(W.partitionBy("repository_path").orderBy("id"))).filter(~F.col("n").eqNullSafe(F.col("last")))
    return d.select("id", F.when(F.col("n") > 0, "block").otherwise("pass").alias("decision"), F.col("n").alias("n_blocking"))


@query("""select o_custkey as repo, base, o_orderkey as head from (select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as base from orders where o_orderstatus = 'F') where base is not null""")
def cp18_feature_boundaries(spark, sf):
    """CP-18: from each merge to the next one of its repository; finished orders stand for merges."""
    merges = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("head"))
    d = commit_plans.previous(merges, "repo", "head", "head", "base", commit_plans.H.CHUNK)
    return d.filter("base is not null").select("repo", "base", "head")


@query("""select distinct session_id from hook_events h where event_type = 'Stop' and session_id is not null and not exists (select 1 from code_quality_cache c where c.session_id = h.session_id)""")
def cp20_cache_misses(spark, sf):
    """CP-20: sessions whose metrics have yet to be computed."""
    stops = table(spark, sf, "hook_events").filter("event_type = 'Stop' and session_id is not null").select("session_id").distinct()
    return stops.join(table(spark, sf, "code_quality_cache").select("session_id").distinct(), "session_id", "left_anti")


@query(f"""select repo, trend, case when abs(trend) < 0.01 then 'flat' else case when trend > 0 then 'up ' else 'down ' end || case when trend < 0 then 'good' else 'bad' end end as arrow, case when sd <= 20 then 'green' when sd <= 60 then 'yellow' else 'red' end as spread from ({commit_plans.ORACLES["agg13_baseline"]})""")
def sf22_trend_labels(spark, sf):
    """SF-21/22: how a trend and a spread read."""
    b = commit_plans.agg13_baseline(spark, sf)
    return b.select("repo", "trend", scoring.trend_arrow(F.col("trend"), True).alias("arrow"), scoring.ladder(F.col("sd"), 20, 60, lower_is_better=True).alias("spread"))


@query("""select database_id, count(distinct version) as n_versions, max(version) as last_version, count(distinct ledger_id) as n_applied from schema_migrations group by 1""")
def snk16_migration_status(spark, sf):
    """SNK-16: what each database has applied, repeated ledger rows once."""
    return table(spark, sf, "schema_migrations").groupBy("database_id").agg(F.count_distinct("version").alias("n_versions"), F.max("version").alias("last_version"), F.count_distinct("ledger_id").alias("n_applied"))


@query("""with k as (select distinct version from schema_migrations), d as (select distinct database_id from schema_migrations) select database_id, version from d, k except select database_id, version from schema_migrations""")
def snk16_pending_migrations(spark, sf):
    """SNK-16: migrations that some database has and others lack."""
    ledger = table(spark, sf, "schema_migrations")
    return pending_migrations(ledger, ledger.select("version"))


@query("""select session_id, round(avg(n), 6) as events_per_project from (select session_id, project_name, count(distinct id) as n from hook_events group by 1, 2) group by 1""")
def q09_project_changes(spark, sf):
    """Sessions that change their project, by events in each."""
    return S.distinct_events(table(spark, sf, "hook_events"), "session_id", "project_name").groupBy("session_id", "project_name").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(F.round(F.avg("n"), 6).alias("events_per_project"))
