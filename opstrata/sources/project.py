"""What the driver finds out about a project before any job: identity, state of its repository, whether it is a single project, settings."""

from __future__ import annotations

import os
import subprocess
import tomllib
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "OPSTRATA_"


def _git(path: str, *args: str) -> str | None:
    try:
        r = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return r.stdout.strip() if r.returncode == 0 else None


def identity(path: str) -> tuple[str, str] | None:
    """SRC-20: (name, where it is from): the remote's address, else the name in pyproject.toml; None without both."""
    if remote := _git(path, "config", "--get", "remote.origin.url"):
        return remote, "git"
    try:
        name = tomllib.loads(Path(path, "pyproject.toml").read_text()).get("project", {}).get("name")
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return None
    return (name, "pyproject") if name else None


def git_state(path: str) -> dict:
    """SRC-26: the state of a repository as the events carry it; all but is_git_repo null where there is none."""
    count = _git(path, "rev-list", "--count", "HEAD")
    inside = _git(path, "rev-parse", "--is-inside-work-tree") == "true"
    changes = _git(path, "status", "--porcelain") if inside else None
    return {
        "commit_count": int(count) if count else (0 if inside else None), "current_branch": (_git(path, "rev-parse", "--abbrev-ref", "HEAD") or None) if inside else None,
        "has_uncommitted_changes": bool(changes) if inside else None, "is_git_repo": inside, "commit_sha": _git(path, "rev-parse", "HEAD") if inside else None,
    }


def is_single_project(path: str, depth: int = 2) -> bool:
    """PF-15: whether at most one repository lies in a folder and ``depth`` levels below; submodules (whose .git is a file) don't count, nor does a home or root folder pass."""
    root = Path(path).resolve()
    if root in (Path.home(), Path(root.anchor)):
        return False
    found, level = 0, [root]
    for _ in range(depth + 1):
        found += sum((d / ".git").is_dir() for d in level)
        level = [c for d in level for c in d.iterdir() if c.is_dir() and not c.name.startswith(".") and os.access(c, os.R_OK)]
    return found <= 1


@dataclass(frozen=True)
class Settings:
    """SRC-28: limits of the analyses; each can be set by an environment variable of its upper-case name behind PREFIX."""

    baseline_commits: int = 100
    detection_sample: int = 200
    merge_ratio: float = 0.15
    lookback_days: int = 180
    interval_days: int = 7
    least_samples: int = 10
    compact_lookback_lines: int = 50
    export_rows: int = 10_000

    @classmethod
    def load(cls, environment: dict[str, str] | None = None) -> Settings:
        """Settings of an environment; ST-07: a variable with the prefix that names none is warned about."""
        env = os.environ if environment is None else environment
        names = {PREFIX + f.name.upper(): f for f in fields(cls)}
        for unknown in sorted({k for k in env if k.startswith(PREFIX)} - set(names)):
            warnings.warn(f"unknown setting {unknown}", stacklevel=2)
        return cls(**{f.name: type(f.default)(env[k]) for k, f in names.items() if k in env})


def dataset_card(name: str, schema: list[tuple[str, str]], rows: int) -> str:
    """SNK-03: the card that goes with an exported dataset; sending it anywhere is left to the user."""
    columns = "\n".join(f"- `{c}`: {t}" for c, t in schema)
    return f"# {name}\n\n{rows} rows, split `train`, Parquet with snappy.\n\n## Columns\n\n{columns}\n"
