"""Keyed state on streams: numbers of a sequence, feedback that must not repeat, pairs of events, running figures, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def number_events(stream: DataFrame, entity: str, order: str) -> DataFrame:
    """WN-01, SS-02: (entity, order, sequence_number): numbers go on from batch to batch, in order of ``order`` within a batch.

    No event is dropped and no lock is waited for. What a task holds of an entity is its share of one micro-batch, two numbers a row; bound it by the
    source's rows per trigger.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[[order]] for b in batches]).sort_values(order, kind="stable")
        done = state.get[0] if state.exists else 0
        state.update((done + len(rows),))
        yield pd.DataFrame({entity: key[0], order: rows[order].to_numpy(), "sequence_number": range(done + 1, done + len(rows) + 1)})

    kinds = dict(stream.dtypes)
    schema = f"{entity} {kinds[entity]}, {order} {kinds[order]}, sequence_number bigint"
    return stream.select(entity, order).groupBy(entity).applyInPandasWithState(number, schema, "n bigint", "append", GroupStateTimeout.NoTimeout)


def fresh_feedback(stream: DataFrame, project: str = "project", key: str = "feedback_key", order: str = "seq") -> DataFrame:
    """PF-14, SS-05/06: feedback of a project only where its key differs from the one given last; keys cover code state only, so unchanged code repeats nothing."""

    def filter_repeats(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        keep = []
        for x in rows[key]:
            keep.append(x != last)
            last = x
        state.update((last,))
        yield rows.loc[keep, [project, key, order]]

    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (project, key, order))
    return stream.select(project, key, order).groupBy(project).applyInPandasWithState(filter_repeats, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def without_echo(stream: DataFrame, session: str = "session_id", kind: str = "kind", order: str = "seq") -> DataFrame:
    """SS-05: events of a session without the idle event that directly follows feedback, as that one only answers it. State is one flag a session."""

    def drop(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        keep = []
        for x in rows[kind]:
            keep.append(not (pending and x == "idle"))
            pending = x == "feedback" or (pending and x != "idle")
        state.update((pending,))
        yield rows.loc[keep, [session, kind, order]]

    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (session, kind, order))
    return stream.select(session, kind, order).groupBy(session).applyInPandasWithState(drop, schema, "pending boolean", "append", GroupStateTimeout.NoTimeout)


def pair_events(first: DataFrame, second: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """JN-21, SS-04: events of ``first`` with those of ``second`` of equal keys that follow within an interval; state is kept no longer than the watermark needs.

    Both need the columns keys, ``time`` and id. Gives (keys, first_id, second_id, first_time, second_time).
    """
    a = first.select(*keys, F.col("id").alias("first_id"), F.col(time).alias("first_time")).withWatermark("first_time", within)
    b = second.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("second_id"), F.col(time).alias("second_time")).withWatermark("second_time", within)
    on = (F.col("second_time") >= F.col("first_time")) & (F.col("second_time") <= F.col("first_time") + F.expr(f"interval {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on).select(*keys, "first_id", "second_id", "first_time", "second_time")


def running(stream: DataFrame, entity: str, *aggregates) -> DataFrame:
    """SS-07: running figures of each entity, for update mode."""
    return stream.groupBy(entity).agg(*aggregates)


def keep_latest(updates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the changed rows of each batch of an update-mode stream under its number; ``sessions.latest`` by batch_id reads the current state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, time: str, lateness: str, window, *keys_and_aggregates) -> DataFrame:
    """SS-09: figures by event-time window (tumbling, sliding or session), final once the watermark has passed."""
    keys, aggregates = keys_and_aggregates
    return stream.withWatermark(time, lateness).groupBy(window.alias("window"), *keys).agg(*aggregates)


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an append-mode stream over all that is there and writes its rows."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
