"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Makes ``import opstrata`` work in Python workers that don't have it on their path; once per Spark context.

    The archive is a file of the driver, which hands it to executors itself, also to those that come later.
    """
    context = spark.sparkContext
    if getattr(context, "_opstrata_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="opstrata-"), "opstrata.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(base, n), os.path.relpath(os.path.join(base, n), os.path.dirname(here)))
    context.addPyFile(target)
    context._opstrata_shipped = True
