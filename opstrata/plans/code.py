"""Queries on source texts and paths; documents of kind source_code stand for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.functions import scoring
from opstrata.operators import code as C
from opstrata.operators import metrics as M
from opstrata.plans.registry import registry
from opstrata.sources.tables import table

QUERIES, ORACLES, query = registry()


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("kind = 'source_code' and text is not null").select("doc_id", "project_name", F.col("text").alias("content"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return M.file_rows(M.snapshots(table(spark, sf, "code_quality_cache"))).select("path").filter("path is not null").distinct()


_SRC = "(select doc_id, project_name, text as content from documents where kind = 'source_code' and text is not null)"
_PATHS = """p as (select distinct json_extract_string(f, '$.path') as path from (select unnest(from_json(json_extract(doc, '$.files'), '["json"]')) as f from (select case when json_type(m) = 'VARCHAR' then m->>'$' else m end as doc
 from (select case when json_valid(complexity_metrics_json) then complexity_metrics_json end as m from code_quality_cache)) where json_valid(doc) and json_type(doc, '$.files') = 'ARRAY') where json_extract_string(f, '$.path') is not null)"""


@query(f"""select doc_id, case when content = '' then 0 when regexp_matches(content, '[\\r\\n]$') then len(l) - 1 else len(l) end as loc, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[^\\s#]'))) as code_loc
 from (select *, string_split_regex(content, '\\r\\n|\\n|\\r') as l from {_SRC})""", loc="int", code_loc="int")
def sf01_line_counts(spark, sf):
    n, code = C.line_counts(F.col("content"))
    return _sources(spark, sf).select("doc_id", n.alias("loc"), code.alias("code_loc"))


@query(f"select doc_id, len(regexp_extract_all(content, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')) as tokens from {_SRC}", tokens="int")
def ca02_token_counts(spark, sf):
    return _sources(spark, sf).select("doc_id", C.token_count(F.col("content")).alias("tokens"))


@query(f"""with l as (select doc_id, unnest(string_split_regex(content, '\\r\\n|\\n|\\r')) as t, generate_subscripts(string_split_regex(content, '\\r\\n|\\n|\\r'), 1) as line from {_SRC}), c as (select doc_id, line, regexp_extract(t, '^[^''"#]*(#.*)$', 1) as c from l)
 select doc_id, case when regexp_matches(c, '#\\s*type:\\s*ignore') then 'type_ignore' when regexp_matches(c, '(?i)\\b(TODO|FIXME|XXX|HACK)\\b') then case when regexp_matches(c, 'https?://') or regexp_matches(c, '[A-Z]+-\\d+|#\\d+') then 'todo' else 'untracked_todo' end
 when regexp_matches(c, 'https?://') or regexp_matches(c, '(?i)#\\s*(NOTE|REASON|WARNING|WORKAROUND|IMPORTANT|CAVEAT|HACK|NB|PERF|SAFETY|COMPAT):') then 'justified' else 'orphan_comment' end as kind, count(*) as n from c where c <> '' group by 1, 2""")
def sf02_comment_kinds(spark, sf):
    rows = C.comment_rows(_sources(spark, sf))
    id_of = F.regexp_extract("path", r"src/(-?\d+)\.py", 1).cast("bigint").alias("doc_id")
    return rows.groupBy(id_of, "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_PATHS} select path, case lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) when 'py' then 'python' when 'rs' then 'rust' end as language, starts_with(list_last(string_split(path, '/')), 'test_') or contains(path, '/tests/') as is_test,
 len(list_intersect(string_split(path, '/'), ['build', 'dist', 'env', 'venv', 'target', 'site-packages'])) > 0 as ignored, list_last(string_split(path, '/')) as name from p""")
def pf12_paths(spark, sf):
    """PF-11/12, SF-03/05: what a path tells."""
    return _paths(spark, sf).select("path", C.language(F.col("path")).alias("language"), C.is_test_path(F.col("path")).alias("is_test"), C.ignored(F.col("path")).alias("ignored"), F.element_at(F.split("path", "/"), -1).alias("name"))


_TESTS = "s as (select path, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') as name from p), t as (select distinct regexp_replace(path, '^tests/', 'tests/test_') as test from p)"


def tests_of(sources: DataFrame, paths: DataFrame) -> DataFrame:
    """Test files of sources; the paths under tests/ stand for test files, with the prefix that these have."""
    return C.test_files(sources, paths.select(F.regexp_replace("path", "^tests/", "tests/test_").alias("path")))


@query(f"""with {_PATHS}, {_TESTS} select path, test from s, t where test in ('tests/test_' || name || '.py', 'test/test_' || name || '.py', 'tests/' || name || '_test.py', 'test_' || name || '.py') or (starts_with(test, 'tests/') and contains(test, 'test_' || name))""")
def jn09_test_files(spark, sf):
    p = _paths(spark, sf)
    return tests_of(p, p)


@query(f"""with {_PATHS}, m as (select replace(regexp_replace(path, '\\.py$', ''), '/', '.') as module, path from p) select module || '.thing' as module, path as target from m where not contains(path, '/__init__')""")
def jn11_import_resolution(spark, sf):
    """JN-11: a name imported from each file's module leads back to the file."""
    p = _paths(spark, sf)
    modules = p.select(F.concat(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."), F.lit(".thing")).alias("module"))
    return C.resolve(modules, p)


@query(f"""with {_PATHS}, m as (select distinct doc_id, unnest(regexp_extract_all(text, '[a-z_]+(?:/[a-z_]+)+\\.py')) as path from documents where contains(text, '.py')) select path, count(*) as n_documents from m join p using (path) group by 1""")
def jn10_documents_naming_files(spark, sf):
    """JN-10, SRC-16: the texts that name a file. Names are taken out of each text once and joined by equality, instead of searching every text for every pattern."""
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z_]+(?:/[a-z_]+)+\.py"), F.lit(0))))
    m = table(spark, sf, "documents").filter(F.col("text").contains(".py")).select("doc_id", names.alias("path"))
    return m.join(_paths(spark, sf), "path").groupBy("path").agg(F.count(F.lit(1)).alias("n_documents"))


@query("""select doc_id, regexp_extract(text, '^# ([^\\n]*)', 1) as title, len(regexp_extract_all(text, '(?m)^## ')) as n_sections from documents where kind = 'plan' and text is not null""", n_sections="int")
def src25_sections(spark, sf):
    """SRC-25: title and number of sections of Markdown texts."""
    return table(spark, sf, "documents").filter("kind = 'plan' and text is not null").select("doc_id", F.regexp_extract("text", r"^# ([^\n]*)", 1).alias("title"), F.regexp_count("text", F.lit(r"(?md)^## ")).alias("n_sections"))


@query("""select doc_id, left(text, 500) as head, length(text) as n_chars, case when length(text) >= 1000000 then '~' || printf('%.1f', length(text) / 1e6) || 'M' when length(text) >= 1000 then '~' || cast(length(text) // 1000 as varchar) || 'K' else cast(length(text) as varchar) end as size from documents where text is not null""", n_chars="int")
def sf32_bounded_text(spark, sf):
    """SF-20, SF-32: bounded texts and readable sizes."""
    n = F.length("text")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.left("text", F.lit(500)).alias("head"), n.alias("n_chars"), scoring.human_count(n).alias("size"))


@query("""select doc_id, sha256(text) as content_hash from documents where text is not null""")
def sf07_content_hash(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""with d as (select doc_id, text, unnest(regexp_extract_all(text, '(?m)^\\+\\+\\+ b/([^\\r\\n]*)', 1)) as path from documents where kind = 'diff') select path, count(*) as n_changes, count(distinct doc_id) as n_diffs from d group by 1""")
def src13_changed_files(spark, sf):
    """SRC-13, SRC-15: files that diffs change."""
    d = table(spark, sf, "documents").filter("kind = 'diff'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?md)^\+\+\+ b/([^\r\n]*)"), F.lit(1))).alias("path"))
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("n_changes"), F.count_distinct("doc_id").alias("n_diffs"))


@query()
def ca18_code_records(spark, sf):
    """CA-01…18 over all sources."""
    return C.analyse(_sources(spark, sf), "doc_id")


@query()
def agg12_code_ratios(spark, sf):
    """AGG-12 per project, from the sources themselves."""
    s = _sources(spark, sf)
    return C.ratios(C.analyse(s, "doc_id").join(s.select("doc_id", "project_name"), "doc_id"), "project_name")
