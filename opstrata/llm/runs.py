"""Runs of consecutive events of the same kind, collapsed into one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions.events import letters_and_digits

#: Sequence numbers of one entity that share a task; an entity with most of the rows is spread over many.
CHUNK = 4096
RUNS = "entity string, chunk bigint, key string, first_sequence int, last_sequence int, n_events bigint, duration_ms bigint, at_start boolean, at_end boolean"


def _collapse(batch: pa.Table) -> pa.Table:
    """The runs of whole chunks. Rows come sorted by entity, chunk and sequence; the rows of a repeated event stand together.

    Run starts are gathered into one sorted array of positions; each event finds its run by binary search in it; sums per run follow.
    """
    entity, key = batch["entity"].combine_chunks().dictionary_encode().indices.to_numpy(), batch["key"].combine_chunks().dictionary_encode()
    code = key.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    chunk, seq, event = (batch[c].to_numpy() for c in ("chunk", "seq", "event_id"))
    changed = lambda x: np.append(True, x[1:] != x[:-1])
    edge = changed(entity) | changed(chunk)
    once = edge | changed(seq) | changed(event)
    batch, code, edge, seq = batch.filter(pa.array(once)), code[once], edge[once], seq[once]
    starts = np.flatnonzero(edge | changed(code) | (code < 0))
    run_of = np.searchsorted(starts, np.arange(len(code)), "right") - 1
    last = np.append(starts[1:], len(code)) - 1
    duration = np.add.reduceat(batch["duration_ms"].fill_null(0).to_numpy(), starts) if len(starts) else np.zeros(0, np.int64)
    head = batch.take(pa.array(starts))
    return pa.table(
        [head["entity"], head["chunk"], head["key"], seq[starts], seq[last], np.bincount(run_of, minlength=len(starts)), duration, edge[starts], np.append(edge[1:], True)[last]],
        ["entity", "chunk", "key", "first_sequence", "last_sequence", "n_events", "duration_ms", "at_start", "at_end"],
    )


def _collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the stream of batches at chunk borders; a chunk that is not complete waits for the next batch."""
    wait: list[pa.RecordBatch] = []
    names = ["entity", "chunk", "seq", "event_id", "key", "duration_ms"]
    tail = lambda b: (b.column("entity")[-1].as_py(), b.column("chunk")[-1].as_py())
    for b in batches:
        if not b.num_rows:
            continue
        same = pc.and_(pc.equal(b.column("entity"), tail(b)[0]), pc.equal(b.column("chunk"), tail(b)[1])).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut or (wait and tail(wait[-1]) != tail(b)):
            yield from _collapse(pa.Table.from_batches([*wait, b.slice(0, cut)]).select(names)).to_batches()
            wait = []
        wait.append(b.slice(cut))
    if wait:
        yield from _collapse(pa.Table.from_batches(wait).select(names)).to_batches()


def collapse_runs(df: DataFrame, entity: str, order: str, event_id: str, name: Column, duration: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """(entity, key, first_sequence, last_sequence, n_events, duration_ms): every longest run of events of the same key, single events included.

    Events stand in the order of ``order``; missing numbers don't end a run. A null name equals nothing, so it is a run of its own and ends the
    one before. A repeated event (same id and place) counts once. Durations that are null or negative count as 0. Events without entity or
    place are left out. An empty table gives none.

    One shuffle by (entity, chunk of numbers). Only runs at chunk borders, two a chunk at most, are joined over the entity by a second, small
    shuffle; all others are final where they were found.
    """
    d = df.select(
        F.col(entity).cast("string").alias("entity"), F.floor(F.col(order) / chunk).alias("chunk"), F.col(order).cast("int").alias("seq"), F.col(event_id).cast("bigint").alias("event_id"),
        letters_and_digits(name).alias("key"), F.greatest(F.coalesce((duration if duration is not None else F.lit(0)).cast("bigint"), F.lit(0)), F.lit(0)).alias("duration_ms"),
    ).filter("entity is not null and seq is not null")
    runs = d.repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "seq", "event_id").mapInArrow(_collapse_batches, RUNS)
    # runs at a border: joined with the neighbouring chunk's
    w = W.partitionBy("entity").orderBy("first_sequence")
    border = F.col("at_start") | F.col("at_end")
    joins = F.col("at_start") & F.lag("at_end").over(w) & (F.col("key") == F.lag("key").over(w))
    key = F.struct("entity", "key", "first_sequence", "last_sequence", "n_events", "duration_ms", border.alias("border"), "at_start", "at_end")
    split = runs.select(key.alias("r")).select("r.*")
    inner = split.filter("not border").select("entity", "key", "first_sequence", "last_sequence", "n_events", "duration_ms")
    outer = (
        split.filter("border").withColumn("begins", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("entity", "island").agg(F.first("key").alias("key"), F.min("first_sequence").alias("first_sequence"), F.max("last_sequence").alias("last_sequence"), F.sum("n_events").alias("n_events"), F.sum("duration_ms").alias("duration_ms"))
        .drop("island")
    )
    return inner.unionByName(outer)
