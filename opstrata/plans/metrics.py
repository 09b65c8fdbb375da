"""Queries on code metrics: snapshots of repositories, their smells, scores and differences, and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions import scoring
from opstrata.operators import metrics as M
from opstrata.operators.sessions import latest
from opstrata.plans.registry import registry
from opstrata.sources.tables import table

QUERIES, ORACLES, query = registry()


def _snaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.snapshots(table(spark, sf, "code_quality_cache"))


_S = """s as (select id, repository_path, doc from (select id, repository_path, case when json_type(m) = 'VARCHAR' then m->>'$' else m end as doc from (select id, repository_path, case when json_valid(complexity_metrics_json) then complexity_metrics_json end as m from code_quality_cache)) where json_valid(doc))"""
_DEC = "try_cast(json_extract_string(f, '$.{c}') as decimal(18,4)) as {c}"
_F = f"""f as (select id, repository_path, json_extract_string(f, '$.path') as path, try_cast(json_extract_string(f, '$.complexity') as bigint) as complexity, {_DEC.format(c="mi")}, {_DEC.format(c="volume")}, {_DEC.format(c="effort")},
 try_cast(json_extract_string(f, '$.tokens') as bigint) as tokens, case when json_type(f, '$.tokens') = 'OBJECT' then json_extract_string(f, '$.tokens.error') end as token_error
 from (select id, repository_path, unnest(from_json(json_extract(doc, '$.files'), '["json"]')) as f from s where json_type(doc, '$.files') = 'ARRAY'))"""
_MEAN = "coalesce(cast(sum({c}) as double) / count(*), 0) as avg_{c}"
_T = f"""select id, count(*) as n_files, sum(complexity)::bigint as total_complexity, {_MEAN.format(c="complexity")}, max(complexity) as max_complexity, min(complexity) as min_complexity, coalesce(sum(volume), 0)::double as total_volume,
 coalesce(sum(effort), 0)::double as total_effort, {_MEAN.format(c="effort")}, {_MEAN.format(c="mi")}, sum(mi)::double as total_mi, coalesce(sum(tokens), 0)::bigint as total_tokens, count(token_error) as n_token_errors from f group by 1"""
_REG = "reg(smell, category, weight) as (values " + ", ".join(f"('{s}', '{c}', {w})" for s, c, w in M.SMELLS) + ")"
_SM = """sm as (select * from (select s.id, s.repository_path, reg.smell, try_cast(json_extract_string(doc, '$.' || reg.smell || '_count') as bigint) as n, json_extract(doc, '$.' || reg.smell || '_files') as files from s, reg) where n is not null)"""
_W = "w as (select id, sum(n * cast(round(weight * 10000) as bigint)) / 10000 as weighted_smells, sum(n)::bigint as n_smells from sm join reg using (smell) group by 1)"
_P = "p as (select * from (select id, lag(id) over (partition by repository_path order by id) as base_id from s) where base_id is not null)"
_C = """c as (select coalesce(a.id, b.id) as id, coalesce(a.path, b.path) as path, case when b.id is null then 'added' when a.id is null then 'removed' when coalesce(a.complexity, 0) <> coalesce(b.complexity, 0) then 'changed' else 'same' end as what,
 coalesce(a.complexity, 0) - coalesce(b.complexity, 0) as complexity_change, coalesce(a.effort, 0) - coalesce(b.effort, 0) as effort_change, coalesce(a.mi, 0) - coalesce(b.mi, 0) as mi_change, coalesce(a.volume, 0) - coalesce(b.volume, 0) as volume_change,
 coalesce(a.tokens, 0) - coalesce(b.tokens, 0) as tokens_change from (select f.* from f join p using (id)) a full join (select p.id, f.* exclude (id) from f join p on f.id = p.base_id) b on a.id = b.id and a.path = b.path)"""
_Q = f"""q as (select id, avg_mi / 100 as mi_normalized, {M.MOST_PENALTY} * (1 - exp(-(coalesce(weighted_smells, 0) / greatest(n_files, 1)) * {M.STEEPNESS})) as smell_penalty,
 {" + ".join(f"case when try_cast(json_extract_string(doc, '$.{c}') as double) >= {x} then {b} else 0.0 end" for c, x, b in M.BONUSES)} as bonus from s join ({_T}) t using (id) left join w using (id))"""


@query(f"with {_S}, {_F} select id, repository_path, path, complexity, mi::double as mi, volume::double as volume, effort::double as effort, tokens, token_error from f")
def cp06_file_metrics(spark, sf):
    double = [F.col(c).cast("double").alias(c) for c in ("mi", "volume", "effort")]
    return M.file_rows(_snaps(spark, sf)).select("id", "repository_path", "path", "complexity", *double, "tokens", "token_error")


@query(f"with {_S}, {_F} {_T}")
def agg09_repo_metrics(spark, sf):
    return M.totals(M.file_rows(_snaps(spark, sf)), "id")


@query(f"with {_S}, {_F} select id, string_agg(path || '=' || complexity, ',' order by path, complexity) as complexity_by_file from f where complexity is not null group by 1")
def agg10_complexity_by_file(spark, sf):
    """AGG-10: the map of path to value, as sorted text; per snapshot, so bounded by its files."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "complexity")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p.path, F.lit("="), p.complexity.cast("string"))), ",")
    return M.file_rows(_snaps(spark, sf)).filter("complexity is not null").groupBy("id").agg(text.alias("complexity_by_file"))


@query(f"""with {_S} select id, coalesce(try_cast(json_extract_string(doc, '$.type_hint_coverage') as double), 0) as type_hint_coverage, coalesce(try_cast(json_extract_string(doc, '$.test_coverage_percent') as double), 0) as test_coverage,
 coalesce(try_cast(json_extract_string(doc, '$.total_complexity') as double) / nullif(try_cast(json_extract_string(doc, '$.total_files_analyzed') as double), 0), 0) as complexity_per_file from s""")
def agg12_guarded_ratios(spark, sf):
    m = _snaps(spark, sf).select("id", F.from_json("doc", "type_hint_coverage double, test_coverage_percent double, total_complexity double, total_files_analyzed double").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select("id", zero("m.type_hint_coverage").alias("type_hint_coverage"), zero("m.test_coverage_percent").alias("test_coverage"), zero(F.try_divide("m.total_complexity", "m.total_files_analyzed")).alias("complexity_per_file"))


@query(f"with {_S}, {_REG}, {_SM} select id, smell, n, case when json_type(files) = 'ARRAY' then json_array_length(files) else -1 end as n_files from sm", n_files="int")
def sf33_smell_rows(spark, sf):
    return M.smell_rows(_snaps(spark, sf)).select("id", "smell", "n", F.coalesce(F.size("files"), F.lit(-1)).alias("n_files"))


@query(f"with {_S}, {_REG}, {_SM}, {_W} select * from w")
def agg26_weighted_smells(spark, sf):
    return M.weighted(M.smell_rows(_snaps(spark, sf)), M.registry(spark))


@query(f"""with {_S}, {_REG}, {_SM}, x as (select distinct repository_path, smell, unnest(from_json(files, '["varchar"]')) as path from sm where json_type(files) = 'ARRAY')
 select path, count(distinct smell) as n_smells, count(distinct repository_path) as n_repositories from x group by 1 order by n_smells desc, n_repositories desc, path limit 10""")
def agg19_smell_offenders(spark, sf):
    x = M.smell_rows(_snaps(spark, sf)).select("repository_path", "smell", F.explode("files").alias("path"))
    return x.groupBy("path").agg(F.count_distinct("smell").alias("n_smells"), F.count_distinct("repository_path").alias("n_repositories")).orderBy(F.desc("n_smells"), F.desc("n_repositories"), "path").limit(10)


@query(f"with {_S}, {_F}, {_REG}, {_SM}, {_W}, {_Q} select id, mi_normalized, round(smell_penalty, 10) as smell_penalty, bonus, round(mi_normalized * (1 - smell_penalty) + bonus, 10) as qpe from q", bonus="double")
def cp11_quality_score(spark, sf):
    r = lambda c: F.round(c, 10).alias(c)
    return M.quality(_snaps(spark, sf), M.registry(spark)).select("id", "mi_normalized", r("smell_penalty"), "bonus", r("qpe"))


@query(f"with {_S}, {_F}, {_P}, {_C} select id, path, what, complexity_change, effort_change::double as effort_change, mi_change::double as mi_change, volume_change::double as volume_change, tokens_change from c")
def jn01_file_changes(spark, sf):
    s = _snaps(spark, sf)
    d = M.file_changes(M.file_rows(s), M.pairs(s))
    return d.select("id", "path", "what", "complexity_change", *[F.col(f"{c}_change").cast("double").alias(f"{c}_change") for c in ("effort", "mi", "volume")], "tokens_change")


@query(f"""with {_S}, {_F}, {_P}, {_C} select id, count(*) filter (where what = 'added') as n_added, count(*) filter (where what = 'removed') as n_removed, count(*) filter (where what = 'changed') as n_changed, sum(complexity_change)::bigint as complexity_change,
 sum(tokens_change)::bigint as tokens_change, sum(effort_change)::double as effort_change, sum(mi_change)::double as mi_change, sum(volume_change)::double as volume_change from c group by 1""")
def cp07_snapshot_delta(spark, sf):
    s = _snaps(spark, sf)
    return M.delta(M.file_changes(M.file_rows(s), M.pairs(s)))


@query(f"with {_S}, {_F}, {_P}, {_C} select id, path, effort_change::double as effort_change, rank from (select *, row_number() over (partition by id order by abs(effort_change) desc, path) as rank from c where what in ('changed', 'same')) where rank <= 3", rank="int")
def so05_top_effort_changes(spark, sf):
    """JN-02, SO-05: the three files on both sides whose effort changed most."""
    s = _snaps(spark, sf)
    d = M.file_changes(M.file_rows(s), M.pairs(s)).filter("what in ('changed', 'same')")
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.abs("effort_change")), "path"))).filter("rank <= 3")
    return d.select("id", "path", F.col("effort_change").cast("double").alias("effort_change"), "rank")


@query(f"with {_S}, {_F} select id, path, effort::double as effort from f where effort is not null order by f.effort desc, path, id limit 10")
def so04_top_effort_files(spark, sf):
    f = M.file_rows(_snaps(spark, sf)).filter("effort is not null").orderBy(F.desc("effort"), "path", "id").limit(10)
    return f.select("id", "path", F.col("effort").cast("double").alias("effort"))


@query(f"with {_S}, {_F} select id, max(effort)::double as max_effort, min(mi)::double as min_mi from f group by 1")
def so04_extremes(spark, sf):
    return M.file_rows(_snaps(spark, sf)).groupBy("id").agg(F.max("effort").cast("double").alias("max_effort"), F.min("mi").cast("double").alias("min_mi"))


@query(f"""with {_S}, {_REG}, {_SM}, {_P} select p.id, reg.smell, coalesce(a.n, 0) - coalesce(b.n, 0) as change, (coalesce(a.n, 0) - coalesce(b.n, 0)) * weight::double as weighted_change from p cross join reg left join sm a on a.id = p.id and a.smell = reg.smell
 left join sm b on b.id = p.base_id and b.smell = reg.smell""")
def sf30_smell_advantage(spark, sf):
    s = _snaps(spark, sf)
    return M.smell_advantage(M.smell_rows(s), M.pairs(s), M.registry(spark))


@query(f"""with {_S}, {_F}, {_REG}, {_SM}, {_P}, {_C}, x as (select distinct id, smell, unnest(from_json(files, '["varchar"]')) as path from sm where json_type(files) = 'ARRAY' and smell in {M.BLOCKING}), e as (select id, path from c where what in ('added', 'changed'))
 select x.id, smell, count(e.path) as n_related, count(*) filter (where e.path is null) as n_unrelated from x left join e on x.id = e.id and x.path = e.path group by 1, 2""")
def cp16_scoped_smells(spark, sf):
    """CP-16, JN-14: blocking smells in files that the snapshot added or changed, and in others."""
    s = _snaps(spark, sf)
    edited = M.file_changes(M.file_rows(s), M.pairs(s)).filter("what in ('added', 'changed')")
    return M.scoped_smells(M.smell_rows(s), edited)


_LB = "l as (select * from (select *, row_number() over (partition by project_path order by id desc, measured_at) as rn from (select distinct * from qpe_leaderboard)) where rn = 1)"


def _latest_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "qpe_leaderboard").distinct()
    return latest(b, ["project_path"], F.desc("id"), F.asc("measured_at"))


@query(f"with {_LB} select row_number() over (order by qpe_score desc, project_path) as rank, project_path, project_name, qpe_score, qpe_weight_version is distinct from (select max(qpe_weight_version) from l) as stale from l", rank="int")
def cp12_leaderboard(spark, sf):
    """CP-12, WN-14: projects ranked by their newest score; stale if by an older weighting. One row per project is ranked, never the history."""
    b = _latest_scores(spark, sf)
    newest = b.agg(F.max("qpe_weight_version").alias("newest"))
    d = b.withColumn("stale", ~F.col("qpe_weight_version").eqNullSafe(newest.scalar()))
    return d.select(F.row_number().over(W.orderBy(F.desc("qpe_score"), "project_path")).alias("rank"), "project_path", "project_name", "qpe_score", "stale")


@query(f"with {_LB} select id, project_path, commit_sha_full, qpe_score from l")
def snk05_leaderboard_upsert(spark, sf):
    """SNK-05, WN-15: the upserted view of the history, one row per project."""
    return _latest_scores(spark, sf).select("id", "project_path", "commit_sha_full", "qpe_score")


_PAIRS = "x as (select id, project_path, qpe_score, lag(qpe_score) over (partition by project_path order by id) as base from (select distinct id, project_path, qpe_score from qpe_leaderboard))"


@query(f"""with {_PAIRS} select id, project_path, round(tanh(case when base > 0 then (qpe_score - base) / base else qpe_score - base end), 8) as advantage, case when abs(qpe_score - base) < 0.01 then 'tie' when qpe_score > base then 'candidate' else 'base' end as winner
 from x where base is not null""")
def sf15_advantage(spark, sf):
    """SF-15/16: each score against the one before of its project: bounded advantage, winner beyond a dead band."""
    b = table(spark, sf, "qpe_leaderboard").select("id", "project_path", "qpe_score").distinct().withColumn("base", F.lag("qpe_score").over(W.partitionBy("project_path").orderBy("id"))).filter("base is not null")
    return b.select("id", "project_path", F.round(scoring.advantage(F.col("base"), F.col("qpe_score")), 8).alias("advantage"), scoring.winner(F.col("base"), F.col("qpe_score"), "base", "candidate").alias("winner"))


@query("""select id, project_name, round(ln(total_effort + 1), 8) as effort_factor, coalesce(qpe_weight_version, '?') as version, left(commit_sha_full, 8) as short_sha, list_last(string_split(project_path, '/')) as base_name,
 regexp_replace(regexp_replace(lower(project_name), '[_ ]', '-', 'g'), '[^a-z0-9-]', '', 'g') as slug from qpe_leaderboard group by all""")
def pf18_display_columns(spark, sf):
    """PF-18, SF-25, SF-31: short ids, base names, slugs and the logarithmic effort factor."""
    b = table(spark, sf, "qpe_leaderboard")
    return b.select("id", "project_name", F.round(F.log1p("total_effort"), 8).alias("effort_factor"), F.coalesce("qpe_weight_version", F.lit("?")).alias("version"), F.left("commit_sha_full", F.lit(8)).alias("short_sha"), F.element_at(F.split("project_path", "/"), -1).alias("base_name"), scoring.slug(F.col("project_name")).alias("slug")).distinct()


@query("""select id, project_name, qpe_score from (select * from (select distinct id, project_name, qpe_score, qpe_weight_version from qpe_leaderboard) order by id desc limit 40) where qpe_weight_version is not null order by id desc limit 20""")
def pf13_limit_filter_limit(spark, sf):
    """PF-13: the newest 2n rows, of these the ones that pass, of these n."""
    b = table(spark, sf, "qpe_leaderboard").select("id", "project_name", "qpe_score", "qpe_weight_version").distinct().orderBy(F.desc("id")).limit(40)
    return b.filter("qpe_weight_version is not null").orderBy(F.desc("id")).limit(20).select("id", "project_name", "qpe_score")


@query("""select reading_level as rating, count(*) as n, count(distinct doc_id) as n_documents, count(distinct rater) as n_raters from reading_labels group by 1""")
def agg07_rating_histogram(spark, sf):
    return table(spark, sf, "reading_labels").groupBy(F.col("reading_level").alias("rating")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("rater").alias("n_raters"))


@query("""select d.doc_id, l.rater, l.reading_level from documents d left join (select doc_id, rater, reading_level, row_number() over (partition by doc_id order by reading_level desc nulls last, rater) as rn from (select distinct * from reading_labels)) l on d.doc_id = l.doc_id and rn = 1""")
def jn17_best_per_parent(spark, sf):
    """JN-17: each parent with the best of its children or none; children are reduced before the join."""
    best = F.max_by(F.struct("rater", "reading_level"), F.struct(F.coalesce("reading_level", F.lit(-1)).alias("a"), (-F.regexp_extract("rater", r"(\d+)$", 1).cast("int")).alias("b"))).alias("b")
    b = table(spark, sf, "reading_labels").groupBy("doc_id").agg(best)
    return table(spark, sf, "documents").select("doc_id").join(b, "doc_id", "left").select("doc_id", "b.rater", "b.reading_level")


@query("""select d.doc_id, coalesce(string_agg(coalesce(cast(l.reading_level as varchar), '-'), ',' order by l.reading_level nulls first, l.rater), '') as levels from documents d join reading_labels l using (doc_id) group by 1""")
def jn18_parent_with_children(spark, sf):
    """JN-18: parents with the ordered list of their children."""
    kids = F.array_sort(F.collect_list(F.struct("reading_level", "rater")))
    text = F.array_join(F.transform(kids, lambda k: F.coalesce(k.reading_level.cast("string"), F.lit("-"))), ",")
    l = table(spark, sf, "reading_labels").groupBy("doc_id").agg(text.alias("levels"))  # noqa: E741
    return table(spark, sf, "documents").select("doc_id").join(l, "doc_id")
