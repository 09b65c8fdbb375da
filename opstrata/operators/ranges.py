"""Seen numbers of producers as a table of disjoint ranges that lives between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.operators.delivery import BLOCK


def seen_ranges(numbers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(producer, block, low, high) of rows (producer, number): disjoint ranges that don't touch within a block, cut at blocks so that a lookup is an equality.

    A producer with a third of all rows is spread over its blocks, and repeated numbers combine before the shuffle. Null producers and numbers are left out.
    """
    n = numbers.filter("producer is not null and number is not null").select("producer", F.floor(F.col("number") / block).alias("block"), "number").distinct()
    return _merge(n.select("producer", "block", F.col("number").alias("low"), F.col("number").alias("high")))


def _merge(ranges: DataFrame) -> DataFrame:
    w = W.partitionBy("producer", "block").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = ranges.withColumn("begins", F.when(F.col("low") > reach + 1, 1).when(reach.isNull(), 1).otherwise(0))
    d = d.withColumn("island", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy("producer", "block", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def merge_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two tables of ranges of the same block length."""
    return _merge(a.unionByName(b))


def uncovered(batch: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``batch`` whose (producer, number) no range covers, each number once per row of the batch; all columns. Equality on (producer, block), then the interval.

    The search is left to the join by sorting: of each block only ranges that a number can fall in are compared, as ranges of a block are merged and few.
    """
    r = ranges.select(F.col("producer").alias("_p"), F.col("block").alias("_b"), "low", "high")
    on = (F.col("producer") == F.col("_p")) & (F.floor(F.col("number") / block) == F.col("_b")) & F.col("number").between(F.col("low"), F.col("high"))
    return batch.join(r, on, "left_anti")
