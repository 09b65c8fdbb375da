"""Git repositories and SQLite files as Spark data sources. Only plain git is called, as a program, where a partition is read."""

from __future__ import annotations

import io
import os
import sqlite3
import subprocess
import tarfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from opstrata.operators.code import IGNORED

FILES_PER_TASK = 500


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, check=True, timeout=600).stdout


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        """Newest first; ``firstparent`` keeps to the trunk, ``after`` bounds the time, ``limit`` the number."""
        o = self.options
        args = ["log", "--format=%H%x1f%ct%x1f%P%x1f%s%x1e", o.get("ref", "HEAD")]
        args += ["--first-parent"] * (o.get("firstparent") == "true") + ([f"--after={o['after']}"] if "after" in o else []) + ([f"--max-count={o['limit']}"] if "limit" in o else [])
        for k, entry in enumerate(git(o["path"], *args).decode("utf-8", "replace").split("\x1e")):
            if "\x1f" in entry:
                sha, seconds, parents, subject = entry.strip("\n").split("\x1f", 3)
                yield k, sha, int(seconds), parents.split(), subject


class GitLog(DataSource):
    """SRC-11/12/14: format ``git_log`` with the option path: (position, sha, epoch_seconds, parents, subject). Rows with two parents or more are merges."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "position int, sha string, epoch_seconds bigint, parents array<string>, subject string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class _SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(r) for r in self.options.get("refs", "HEAD").split(",")]

    def read(self, partition) -> Iterator[tuple]:
        o, ref = self.options, partition.value
        paths = [p for p in o.get("paths", o.get("prefix", "")).split(",") if p]
        known = set(git(o["path"], "ls-tree", "-r", "-z", "--name-only", ref).decode("utf-8", "replace").split("\0"))
        paths = [p for p in paths if any(k == p or k.startswith(p.rstrip("/") + "/") for k in known)]
        if not paths and (o.get("paths") or o.get("prefix")):
            return
        with tarfile.open(fileobj=io.BytesIO(git(o["path"], "archive", "--format=tar", ref, "--", *paths))) as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(tuple(o.get("suffixes", ".py").split(","))):
                    yield ref, m.name, tar.extractfile(m).read().decode("utf-8", "replace")


class GitSnapshot(DataSource):
    """SRC-07/08/09: format ``git_snapshot`` with path, refs (by comma, a partition each), and paths, prefix or suffixes: (ref, path, content). Unknown paths give no rows."""

    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return "ref string, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "1"))
        with self._open() as c:
            low, high = c.execute(f'select min(rowid), max(rowid) from "{self.options["table"]}"').fetchone()
        if low is None:
            return [_Part((0, 0))]
        step = (high - low) // n + 1
        return [_Part((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        with self._open() as c:
            yield from c.execute(f'select * from "{self.options["table"]}" where rowid >= ? and rowid < ?', partition.value)


class SqliteTable(DataSource):
    """SRC-02: format ``sqlite_table`` with path, table and partitions: the table's columns by their declared kind, read by ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{name}` {'bigint' if 'INT' in kind.upper() else 'double' if kind.upper() in ('REAL', 'DOUBLE', 'FLOAT') else 'binary' if kind.upper() == 'BLOB' else 'string'}" for _, name, kind, *_ in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Paths only, FILES_PER_TASK a task; directories without own sources aren't entered."""
        root, suffixes, paths = self.options["path"], tuple(self.options.get("suffixes", ".py").split(",")), []
        for base, below, names in os.walk(root):
            below[:] = [d for d in below if d not in IGNORED and not d.endswith(".egg-info")]
            paths += [os.path.relpath(os.path.join(base, n), root) for n in names if n.endswith(suffixes)]
        return [_Part(paths[k : k + FILES_PER_TASK]) for k in range(0, len(paths), FILES_PER_TASK)] or [_Part([])]

    def read(self, partition) -> Iterator[tuple]:
        for p in partition.value:
            with open(os.path.join(self.options["path"], p), encoding="utf-8", errors="replace", newline="") as f:
                yield p, f.read()


class SourceTree(DataSource):
    """SRC-06/10: format ``source_tree`` with path and suffixes: (path, content) of a folder that the executors share. Unlike Spark's file formats it keeps empty files, which packages need."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitSnapshot, SourceTree, SqliteTable):
        spark.dataSource.register(source)
