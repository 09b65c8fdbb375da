"""Writing tables: exports, upserts, children replaced with their parent, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.operators.sessions import latest


def export_newest(df: DataFrame, order: str, path: str, limit: int = 10_000) -> int:
    """SNK-02: the newest rows as one snappy Parquet export; the number of rows written."""
    df.orderBy(F.desc(order)).limit(limit).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def append_version(df: DataFrame, path: str, version: int) -> None:
    """SNK-04/06/08: an upsert as an appended version; writing a version again replaces it, so a repeated task does no harm."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def upserted(spark: SparkSession, path: str, keys: list[str], *order: Column) -> DataFrame:
    """The table as upserts leave it: the row of the highest version of each key, null keys being equal."""
    return latest(spark.read.option("mergeSchema", True).parquet(path), keys, F.desc("version"), *order).drop("version")


def replace_children(children: DataFrame, parent: str, path: str) -> None:
    """SNK-07: replaces all children of the parents that occur, and no others."""
    children.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def write_bundles(df: DataFrame, key: str, path: str) -> None:
    """SNK-11/12: JSON bundles, a folder for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def add_missing(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """SNK-16: the table with columns it lacks, null or a default."""
    have = set(df.columns)
    return df.withColumns({c: F.lit((defaults or {}).get(c)).cast(kind) for c, kind in columns.items() if c not in have})


def pending_migrations(ledger: DataFrame, known: DataFrame) -> DataFrame:
    """SNK-16: (database_id, version): migrations of ``known`` that a database's ledger lacks. Known versions are one array, as a program has few."""
    every = known.agg(F.collect_set("version").alias("v")).scalar()
    have = ledger.groupBy("database_id").agg(F.collect_set("version").alias("have"))
    return have.select("database_id", F.explode(F.array_except(every, "have")).alias("version"))
