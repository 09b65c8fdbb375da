"""Running sums and row numbers over an entity's order, without one task per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, entity: str, place: str, value: Column, name: str, chunk: int, tie: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the entity's rows up to and with this one, in order of ``place`` (integer), then ``tie``.

    The order is cut into chunks of ``chunk`` places. Sums run within (entity, chunk), which is how rows are shuffled; what came before a chunk is a
    running sum over one row per chunk. An entity with a third of all rows is thus spread over many tasks.
    """
    order = [place, *([tie] if tie else [])]
    d = df.withColumn("_v", value).withColumn("_chunk", F.floor(F.col(place) / chunk))
    inner = d.withColumn("_in", F.sum("_v").over(W.partitionBy(entity, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy("_e").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy(F.col(entity).alias("_e"), F.col("_chunk").alias("_c")).agg(F.sum("_v").alias("_s")).select("_e", "_c", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    out = inner.join(before, (F.col(entity).eqNullSafe(F.col("_e"))) & (F.col("_chunk").eqNullSafe(F.col("_c"))), "left")
    return out.withColumn(name, F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_v", "_chunk", "_in", "_e", "_c", "_before")


def previous(df: DataFrame, entity: str, place: str, value: str, name: str, chunk: int) -> DataFrame:
    """``df`` with ``name``: ``value`` of the entity's row before this one in order of ``place`` (integer, unique within the entity); null for the first.

    Works by chunks as ``running_sum`` does: within a chunk a lag, at its start the last value of the chunk before.
    """
    d = df.withColumn("_chunk", F.floor(F.col(place) / chunk))
    w = W.partitionBy(entity, "_chunk").orderBy(place)
    inner = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = d.groupBy(F.col(entity).alias("_e"), F.col("_chunk").alias("_c")).agg(F.max_by(F.struct(value), place).alias("_l"))
    before = last.select("_e", "_c", F.lag("_l").over(W.partitionBy("_e").orderBy("_c")).alias("_b"))
    out = inner.join(before, (F.col(entity).eqNullSafe(F.col("_e"))) & (F.col("_chunk").eqNullSafe(F.col("_c"))), "left")
    return out.withColumn(name, F.when(F.col("_first"), F.col(f"_b.{value}")).otherwise(F.col("_lag"))).drop("_chunk", "_lag", "_first", "_e", "_c", "_b")
