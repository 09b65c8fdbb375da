"""Sources, sinks and migrations on small fixtures."""

import json
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from opstrata.operators import code
from opstrata.sources import files, sinks
from opstrata.sources import git as G


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for k in range(3):
        (d / "pkg").mkdir(exist_ok=True)
        (d / "pkg" / f"m{k}.py").write_text(f"x = {k}\n")
        (d / "pkg" / "m0.py").write_text(f"x = {k}\n")
        (d / "notes.txt").write_text("n")
        run("add", "-A")
        run("commit", "-q", "-m", f"step {k}")
    run("checkout", "-q", "-b", "side", "HEAD~1")
    (d / "side.py").write_text("y = 1\n")
    run("add", "-A")
    run("commit", "-q", "-m", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merge side", "side")
    return str(d)


def test_git_sources(spark, repo):
    G.register(spark)
    log = spark.read.format("git_log").option("path", repo).load()
    rows = log.orderBy("position").collect()
    assert rows[0].subject == "merge side" and len(rows[0].parents) == 2 and {r.subject for r in rows} == {"step 0", "step 1", "step 2", "side", "merge side"}
    trunk = spark.read.format("git_log").option("path", repo).option("firstparent", "true").load()
    assert [r.subject for r in trunk.orderBy("position").collect()] == ["merge side", "step 2", "step 1", "step 0"]
    snap = spark.read.format("git_snapshot").option("path", repo).option("refs", "HEAD,HEAD~1").load()
    assert snap.rdd.getNumPartitions() == 2
    a, b = (snap.filter(F.col("ref") == r) for r in ("HEAD~1", "HEAD"))
    assert {r.path for r in a.collect()} == {"pkg/m0.py", "pkg/m1.py", "pkg/m2.py"}
    assert [r.path for r in files.changed(a, b).collect()] == ["side.py"]
    some = spark.read.format("git_snapshot").option("path", repo).option("paths", "pkg/m1.py,none.py").load()
    assert [(r.path, r.content) for r in some.collect()] == [("pkg/m1.py", "x = 1\n")]
    assert spark.read.format("git_snapshot").option("path", repo).option("prefix", "nowhere").load().count() == 0
    h = files.tree_hash(snap, "ref").collect()
    assert len({r.tree_hash for r in h}) == 2


def test_sqlite_source(spark, tmp_path):
    p = str(tmp_path / "x.db")
    with sqlite3.connect(p) as c:
        c.execute("create table hook_events (id integer primary key, session_id text, score real)")
        c.execute("create table empty (id integer)")
        c.executemany("insert into hook_events values (?, ?, ?)", [(i, f"s{i}" if i % 2 else None, i / 2) for i in range(1, 101)])
    G.register(spark)
    df = spark.read.format("sqlite_table").option("path", p).option("table", "hook_events").option("partitions", "4").load()
    assert df.dtypes == [("id", "bigint"), ("session_id", "string"), ("score", "double")]
    assert df.agg(F.sum("id"), F.count("session_id"), F.sum("score")).first()[:] == (5050, 50, 2525.0)
    assert spark.read.format("sqlite_table").option("path", p).option("table", "empty").load().count() == 0


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"cwd": "/w", "type": "user"}), "{bad", "", json.dumps({"sessionId": "S1"})]) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"cwd": "/other"}) + "\r\n")
    (tmp_path / "c.jsonl").write_text(json.dumps({"cwd": "/w"}))
    lines = files.transcript_lines(spark, str(tmp_path))
    assert [(r.line, r.ok) for r in lines.filter("endswith(path, 'a.jsonl')").orderBy("line").selectExpr("line", "event is not null as ok").collect()] == [(1, True), (2, False), (4, True)]
    assert sorted(r.session_id for r in files.transcript_files(lines, "/w").collect()) == ["S1", "c"]


def test_source_tree_and_coverage(spark, tmp_path):
    for p, t in (("src/a.py", "import b\n"), ("src/b.py", ""), ("venv/c.py", "x"), ("readme.md", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    G.register(spark)
    assert {r.path for r in spark.read.format("source_tree").load(str(tmp_path)).collect()} == {"src/a.py", "src/b.py"}
    (tmp_path / "coverage.xml").write_text('<?xml version="1.0"?>\n<coverage line-rate="0.8" lines-valid="10" lines-covered="8" version="1">\n<packages><package><classes><class name="a" filename="a.py" line-rate="1.0"/><class name="b" filename="b.py" line-rate="0.75"/></classes></package></packages></coverage>')
    (tmp_path / "bare.xml").write_text('<coverage line-rate="0.5"/>')
    assert files.coverage_total(spark, str(tmp_path / "coverage.xml")).first()[:] == (80.0, 10, 8)
    assert files.coverage_total(spark, str(tmp_path / "bare.xml")).first()[:] == (50.0, 0, 0)
    assert {(r.file, r.line_rate) for r in files.coverage_files(spark, str(tmp_path / "coverage.xml")).collect()} == {("a.py", 1.0), ("b.py", 0.75)}


def test_sinks(spark, tmp_path):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("k"), F.lit("v").alias("v"))
    assert sinks.export_newest(df, "id", f"{tmp_path}/e", 10) == 10 and spark.read.parquet(f"{tmp_path}/e").agg(F.min("id")).first()[0] == 20
    sinks.append_version(spark.createDataFrame([("a", 1), (None, 1)], "k string, v int"), f"{tmp_path}/u", 1)
    sinks.append_version(spark.createDataFrame([("a", 2, "n"), (None, 3, "n")], "k string, v int, more string"), f"{tmp_path}/u", 2)
    assert {tuple(r) for r in sinks.upserted(spark, f"{tmp_path}/u", ["k"]).select("k", "v", "more").collect()} == {("a", 2, "n"), (None, 3, "n")}
    sinks.replace_children(df, "k", f"{tmp_path}/c")
    sinks.replace_children(df.filter("k = 1 and id < 5"), "k", f"{tmp_path}/c")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/c").groupBy("k").count().collect()} == {(0, 10), (1, 2), (2, 10)}
    sinks.write_bundles(df, "k", f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b").count() == 30
    assert sinks.add_missing(df, {"v": "int", "w": "int"}, {"w": 4}).first()[:] == (0, 0, "v", 4)
    ledger = spark.createDataFrame([("d1", "001"), ("d1", "001"), ("d2", "002")], "database_id string, version string")
    assert {tuple(r)[:2] for r in sinks.pending_migrations(ledger, spark.createDataFrame([("001",), ("002",)], "version string")).collect()} == {("d1", "002"), ("d2", "001")}


def test_import_graph_and_context(spark):
    src = {"src/a.py": "from b import f\nimport pkg.m.K\nfrom . import x\n", "src/b.py": "import os\n", "pkg/__init__.py": "", "pkg/m.py": "def broken(:", "src/c.py": "import a", "tests/test_a.py": "import a"}
    df = spark.createDataFrame(list(src.items()), "path string, content string")
    g = code.edges(code.imports(df), df)
    assert {tuple(r) for r in g.collect()} == {("src/a.py", "src/b.py"), ("src/a.py", "pkg/m.py"), ("src/c.py", "src/a.py"), ("tests/test_a.py", "src/a.py")}
    tests = code.test_files(df, df)
    assert ("src/a.py", "tests/test_a.py") in {tuple(r) for r in tests.collect()}
    every = spark.createDataFrame([("tests/test_a.py",), ("test/test_a.py",), ("tests/a_test.py",), ("test_a.py",), ("tests/unit/test_ab_c.py",), ("other/test_a.py",), ("tests/x.py",)], "path string")
    got = {(r.path, r.test) for r in code.test_files(spark.createDataFrame([("src/a.py",), ("ab.py",), ("src/c.py",)], "path string"), every).collect()}
    assert got == {("src/a.py", t) for t in ("tests/test_a.py", "test/test_a.py", "tests/a_test.py", "test_a.py", "tests/unit/test_ab_c.py")} | {("ab.py", "tests/unit/test_ab_c.py")}
    edited = spark.createDataFrame([("s", "src/a.py"), ("s", "src/b.py"), ("t", "alone.py")], "session_id string, path string")
    read = spark.createDataFrame([("s", "src/b.py"), ("s", "src/b.py"), ("s", "tests/test_a.py")], "session_id string, path string")
    rows = {(r.session_id, r.path): r for r in code.coverage(edited, read, g, tests).collect()}
    a = rows["s", "src/a.py"]
    assert (a.imports, a.imports_read, a.dependents, a.dependents_read, a.tests, a.tests_read) == (2, 1, 2, 1, 1, 1) and a.blind_spots == ["pkg/m.py", "src/c.py"]
    assert rows["t", "alone.py"].blind_spots == [] and rows["s", "src/b.py"].blind_spots == ["src/a.py"]


def test_coverage_database(spark, tmp_path):
    p = str(tmp_path / ".coverage")
    with sqlite3.connect(p) as c:
        c.execute("create table file (id integer primary key, path text)")
        c.execute("create table line_bits (file_id integer, context_id integer, numbits blob)")
        c.executemany("insert into file values (?, ?)", [(1, "a.py"), (2, "b.py")])
        c.executemany("insert into line_bits values (?, ?, ?)", [(1, 0, bytes([0b00000110, 0b1])), (1, 1, bytes([0b00000100])), (1, 2, b"")])
    G.register(spark)
    assert {tuple(r) for r in files.coverage_database(spark, p).collect()} == {("a.py", 3), ("b.py", 0)}
    statements = spark.createDataFrame([("a.py", 4), ("b.py", 2), ("c.py", 0)], "file string, statements long")
    assert files.coverage(spark, None, p, statements).first()[:] == (50.0, "database") and files.coverage(spark, None, None) is None


def test_project(repo, tmp_path, monkeypatch):
    from opstrata.sources import project

    s = project.git_state(repo)
    assert (s["is_git_repo"], s["current_branch"], s["commit_count"], s["has_uncommitted_changes"]) == (True, "main", 5, False) and len(s["commit_sha"]) == 40
    assert project.identity(repo) is None and project.git_state(str(tmp_path))["is_git_repo"] is False
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "x"\n')
    assert project.identity(str(tmp_path)) == ("x", "pyproject")
    assert project.is_single_project(repo)
    for k in "ab":
        (tmp_path / k / ".git").mkdir(parents=True)
    assert not project.is_single_project(str(tmp_path))
    with pytest.warns(UserWarning, match="OPSTRATA_NOPE"):
        assert project.Settings.load({"OPSTRATA_INTERVAL_DAYS": "3", "OPSTRATA_NOPE": "1"}).interval_days == 3
    assert "- `a`: int" in project.dataset_card("d", [("a", "int")], 3)
