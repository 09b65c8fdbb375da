"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("problems", "sessions", "transcripts", "metrics", "commits", "code", "streams", "reports")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"opstrata.plans.{m}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"opstrata.plans.{m}").ORACLES
    return out
