"""Parquet tables of a data directory, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, one parquet file or folder each; columns are pruned by the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach, below ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a folder of this machine is used and set, so that what is written
    there outlives the loss of an executor on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "opstrata-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stream_path(spark: SparkSession, path: str) -> str:
    """A path the streaming reader takes: a table that is one file must be a pattern, else it is taken for a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    one_file = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return f"{path[:-1]}[{path[-1]}]" if one_file else path


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The table ``name`` as a stream of its files."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(stream_path(spark, f"{sf_dir}/{name}.parquet"))
