"""Source files: line counts, comments, code features, import graph, tests and dependents, ratios."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstrata.functions import python_code as P

# Directories that hold no sources of their own, file types of the languages that are known.
IGNORED = (
    "__pycache__", ".venv", "venv", "env", ".env", "site-packages", "dist", "build", ".eggs", ".pytest_cache", ".tox", ".nox", ".hypothesis", ".mypy_cache", ".ruff_cache", ".pytype", "htmlcov", ".coverage",
    ".ipynb_checkpoints", ".idea", ".vscode", "target", ".cargo", ".git",
)
LANGUAGES = {"py": "python", "rs": "rust", "go": "Go", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript"}
RECORD = ", ".join([f"{c} bigint" for c in P.COUNTS] + [f"{m} double" for m in P.MEASURES])
LINE_END = r"\r\n|\n|\r"


def line_counts(text: Column) -> tuple[Column, Column]:
    """SF-01: all lines (a final line end begins none) and code lines (not blank, not a comment alone)."""
    lines = F.split(text, LINE_END)
    n = F.when(text == "", 0).when(text.rlike(r"[\r\n]$"), F.size(lines) - 1).otherwise(F.size(lines))
    code = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[^\s#]")))
    return n, code


def token_count(text: Column) -> Column:
    """CA-02, without a vocabulary: words and signs."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def comment_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """SF-02, natively: (path, line, comment, kind) of lines whose first or last part is a comment, outside strings as far as a line shows."""
    lines = files.select(path, F.posexplode(F.split(content, LINE_END)).alias("pos", "text"))
    c = lines.select(path, (F.col("pos") + 1).alias("line"), F.regexp_extract("text", r"^[^'\"#]*(#.*)$", 1).alias("comment")).filter("comment <> ''")
    return c.withColumn("kind", comment_kind(F.col("comment"), is_test_path(F.col(path))))


def comment_kind(c: Column, in_test: Column) -> Column:
    tracked = c.rlike(r"https?://") | c.rlike(r"[A-Z]+-\d+|#\d+")
    justified = c.rlike(r"(?i)#\s*(NOTE|REASON|WARNING|WORKAROUND|IMPORTANT|CAVEAT|HACK|NB|PERF|SAFETY|COMPAT):")
    return (
        F.when(c.rlike(r"#\s*type:\s*ignore"), "type_ignore").when(c.rlike(r"(?i)\b(TODO|FIXME|XXX|HACK)\b"), F.when(tracked, "todo").otherwise("untracked_todo"))
        .when(in_test | c.rlike(r"https?://") | justified, "justified").otherwise("orphan_comment")
    )


def is_test_path(path: Column) -> Column:
    """SF-03."""
    return F.element_at(F.split(path, "/"), -1).startswith("test_") | path.contains("/tests/")


def language(path: Column) -> Column:
    """PF-12: the language by file type; null if unknown."""
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(ext)]


def ignored(path: Column) -> Column:
    """PF-11: a part of the path is a directory without own sources, or ends like one."""
    return F.exists(F.split(path, r"[/\\]"), lambda p: p.isin(*IGNORED) | p.endswith(".egg-info"))


def analyse(files: DataFrame, key: str = "path", content: str = "content", path: str | None = None) -> DataFrame:
    """CA-01…18: (key, parsed, *record) of every Python source. An unparseable or null source has nulls; an empty one zeros. Repeated rows stay."""
    schema = files.select(key).schema[0].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[pa.int64()] * len(P.COUNTS), *[pa.float64()] * len(P.MEASURES)]
        for b in batches:
            rows = [P.record(str(p), t) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            columns = [pa.array([None if r is None else r[c] for r in rows], t) for c, t in zip((*P.COUNTS, *P.MEASURES), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([r is not None for r in rows]), *columns], ["key", "parsed", *P.COUNTS, *P.MEASURES])

    d = files.select(F.col(key).alias("key"), F.col(path or key).cast("string").alias("path"), F.col(content).alias("content"))
    return d.mapInArrow(kernel, f"key {schema}, parsed boolean, {RECORD}").withColumnRenamed("key", key)


def imports(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """CA-19: (path, module) of every import."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, m) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for m in P.imported_modules(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], ["path", "module"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(kernel, "path string, module string")


def resolve(modules: DataFrame, files: DataFrame, module: str = "module") -> DataFrame:
    """JN-11: (module, target): the file of a module. The full dotted path first, then shorter ones; roots "." then "src"; a file before a package. Equi-joins on candidates only."""
    parts = F.split(module, r"\.")
    tries = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.transform(F.array(F.lit(""), F.lit("src/")), lambda root: F.array(F.concat(root, F.array_join(F.slice(parts, 1, n), "/"), F.lit(".py")), F.concat(root, F.array_join(F.slice(parts, 1, n), "/"), F.lit("/__init__.py"))))))
    c = modules.select(module).distinct().select(module, F.posexplode(F.flatten(tries)).alias("rank", "target"))
    hit = c.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy(module).agg(F.min_by("target", "rank").alias("target"))


def edges(imported: DataFrame, files: DataFrame) -> DataFrame:
    """The import graph: (src, dst) among the files, without self-edges."""
    target = resolve(imported, files)
    return imported.join(target, "module").select(F.col("path").alias("src"), F.col("target").alias("dst")).filter("src <> dst").distinct()


def test_files(sources: DataFrame, all_files: DataFrame) -> DataFrame:
    """JN-09: (path, test): a file tests a source if it has one of four names made from the source's, or lies in ``tests/`` with ``test_<name>`` somewhere in its path.

    Instead of comparing every file with every source, each test file tells all names it may test: what follows any ``test_`` in its path, at every length.
    These are as many as the path has characters, and meet the sources by equality.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    s = sources.select("path").distinct().withColumn("name", stem)
    t = all_files.select(F.col("path").alias("test")).distinct()
    after = F.when(F.col("test").startswith("tests/"), F.regexp_extract_all("test", F.lit("(?=test_(.*))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    prefixes = F.flatten(F.transform(after, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda n: F.left(x, n))))
    named = F.array_compact(F.array(*[F.nullif(F.regexp_extract("test", p, 1), F.lit("")) for p in (r"^tests?/test_([^/]+)\.py$", r"^tests/([^/]+)_test\.py$", r"^test_([^/]+)\.py$")]))
    t = t.select("test", F.explode(F.array_distinct(F.concat(prefixes, named))).alias("name"))
    return s.join(t, "name").select("path", "test").distinct()


def coverage(edited: DataFrame, read: DataFrame, graph: DataFrame, tests: DataFrame) -> DataFrame:
    """CP-05, JN-08, ST-04 per (session_id, path) edited: how many imports, dependents and tests it has and how many of them the session read, and the unread ones (blind spots)."""
    forward = graph.select(F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("imports").alias("kind"))
    backward = graph.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.lit("dependents").alias("kind"))
    related = forward.unionByName(backward).unionByName(tests.select("path", F.col("test").alias("other"), F.lit("tests").alias("kind")))
    r = read.select("session_id", F.col("path").alias("other"), F.lit(True).alias("seen")).distinct()
    d = edited.select("session_id", "path").distinct().join(related, "path", "left").join(r, ["session_id", "other"], "left")
    n = lambda k: [F.count_if(F.col("kind") == k).alias(k), F.count_if((F.col("kind") == k) & F.coalesce("seen", F.lit(False))).alias(f"{k}_read")]
    blind = F.array_sort(F.collect_set(F.when(F.col("other").isNotNull() & F.col("seen").isNull(), F.col("other"))))
    return d.groupBy("session_id", "path").agg(*n("imports"), *n("dependents"), *n("tests"), blind.alias("blind_spots"))


def ratios(records: DataFrame, *keys: str) -> DataFrame:
    """AGG-12 over file records: per cent of annotated arguments and returns, documented definitions, Any and str among type references; 0 without any."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pct = lambda a, b: F.coalesce(F.try_divide(a, b) * 100, F.lit(0.0))
    return records.filter("parsed").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), pct(s("annotated_args") + s("annotated_returns"), s("args") + s("returns")).alias("type_hint_coverage"), pct(s("docstrings"), s("functions") + s("classes")).alias("docstring_coverage"),
        pct(s("any_refs"), s("type_refs")).alias("any_percent"), pct(s("str_refs"), s("type_refs")).alias("str_percent"), F.count_if(F.col("code_loc") >= 10).alias("effective_files"), F.sum("complexity").alias("complexity"),
    )
