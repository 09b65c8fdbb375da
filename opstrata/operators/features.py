"""One row per entity with counts, recency and totals for each event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions.events import letters_and_digits

#: Event types that share a wide row. A type list of any length is laid out in blocks of so many columns, so no plan grows with it.
BLOCK = 256
MEASURES = ("n", "last_sequence", "total_ms", "failures")
#: Columns of one plan that a named wide table may have at most; beyond it ask for blocks.
MOST_TYPES = 1000


def long_table(df: DataFrame, entity: str = "session_id", name: Column | None = None, event_id: str = "id", order: str = "sequence_number", duration: str = "duration_ms", exit_code: str = "exit_code") -> DataFrame:
    """(entity, type, n, last_sequence, total_ms, failures), one row per entity and event type: the compact form that all wide forms come from.

    An event repeated under its id counts once; events with null entity or name are left out. Negative and null durations add 0; a failure is an exit code other
    than 0, null is none. Both aggregations combine before they shuffle, so one entity with a third of the rows is no hot spot.
    """
    name = F.col("tool_name") if name is None else name
    d = df.select(F.col(entity).alias("entity"), letters_and_digits(name).alias("type"), F.col(event_id).alias("event_id"), F.col(order).alias("seq"), F.col(duration).alias("ms"), F.col(exit_code).alias("code"))
    once = d.filter("entity is not null and type is not null").groupBy("entity", "type", "event_id").agg(F.max("seq").alias("seq"), F.max("ms").alias("ms"), F.max("code").alias("code"))
    return once.groupBy("entity", "type").agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_sequence"), F.coalesce(F.sum(F.greatest("ms", F.lit(0)).cast("bigint")), F.lit(0)).alias("total_ms"), F.count_if(F.col("code") != 0).alias("failures")
    )


def type_list(long: DataFrame) -> DataFrame:
    """(type, block, slot): the explicit list of types, sorted, with the place of each in the wide rows. Grows with the kinds of events, not with events."""
    place = F.row_number().over(W.orderBy("type")) - 1
    return long.select("type").distinct().select("type", place.alias("place")).select("type", F.floor(F.col("place") / BLOCK).cast("int").alias("block"), (F.col("place") % BLOCK).cast("int").alias("slot"))


def wide_blocks(long: DataFrame, types: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(entity, block, s0_<measure> … s255_<measure>): the pivot, by the explicit list of slots; null where an entity lacks the type."""
    placed = long.join(types, "type").select("entity", "block", "slot", *measures)
    aggregates = [F.max(m).alias(m) for m in measures]
    wide = placed.groupBy("entity", "block").pivot("slot", list(range(BLOCK))).agg(*aggregates)
    return wide.toDF("entity", "block", *[f"s{i}_{m}" for i in range(BLOCK) for m in measures])


def unpivot_blocks(wide: DataFrame, types: DataFrame, measure: str) -> DataFrame:
    """(entity, type, <measure>): the filled cells of the wide rows again."""
    cells = F.array(*[F.col(f"s{i}_{measure}") for i in range(BLOCK)])
    cell = wide.select("entity", "block", F.posexplode(cells).alias("slot", measure)).filter(F.col(measure).isNotNull())
    return cell.join(types, ["block", "slot"]).select("entity", "type", measure)


def feature_table(long: DataFrame, types: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row per entity with columns ``<type>_<measure>`` for the explicit list ``types``, its last sequence of all and the recency of each type.

    Counts, totals and failures of a type that the entity lacks are 0, its last sequence and recency null. recency is the entity's last sequence
    less the type's. Types not listed only count in ``n_all`` and ``last_sequence_all``. At most MOST_TYPES types; beyond that use ``wide_blocks``.
    """
    if len(types) > MOST_TYPES:
        raise ValueError(f"{len(types)} types; more than {MOST_TYPES} are for wide_blocks")
    whole = long.groupBy("entity").agg(F.sum("n").alias("n_all"), F.max("last_sequence").alias("last_sequence_all"))
    wide = long.groupBy("entity").pivot("type", types).agg(*[F.max(m).alias(m) for m in measures])
    wide = wide.toDF("entity", *[f"{t}_{m}" for t in types for m in measures])
    # as texts, parsed in one call: a thousand columns built one by one take longer than the query
    name = lambda t, m: "`" + f"{t}_{m}".replace("`", "``") + "`"
    cells = [name(t, m) if m == "last_sequence" else f"coalesce({name(t, m)}, 0) as {name(t, m)}" for t in types for m in measures]
    recency = [f"last_sequence_all - {name(t, 'last_sequence')} as {name(t, 'recency')}" for t in types] if "last_sequence" in measures else []
    return whole.join(wide, "entity", "left").selectExpr("entity", "n_all", "last_sequence_all", *cells, *recency)
