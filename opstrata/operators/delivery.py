"""Messages delivered more than once: which deliveries are surplus, so that exactly one of each message stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An identifier of a producer's sequence: letters, a number, an optional mark. What stands around the number names the producer with the session.
SEQUENCE_ID = r"^([a-z_\-]*)([0-9]{1,12})([a-z]?)$"
#: Numbers of one producer that share a task. Splits a producer with most of the rows.
BLOCK = 1 << 16
#: White space as Unicode has it, for trimming.
OUTER_SPACE = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


class SeenRanges:
    """The numbers a producer has been seen to deliver, as sorted disjoint ranges.

    ``accept`` takes numbers in order of preference and tells which are new: each uncovered number once. Ranges that touch are merged, so a gapless
    sequence of any length is one range.
    """

    def __init__(self, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.low = np.zeros(0, np.int64) if low is None else low
        self.high = np.zeros(0, np.int64) if high is None else high

    def covered(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.low, numbers, "right") - 1
        return (at >= 0) & (numbers <= np.append(self.high, -1)[at])

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        fresh = np.zeros(len(numbers), bool)
        _, first = np.unique(numbers, return_index=True)
        fresh[first] = True
        fresh &= ~self.covered(numbers)
        new = np.sort(numbers[fresh])
        if len(new):
            low, high = np.concatenate([self.low, new]), np.concatenate([self.high, new])
            order = np.argsort(low, kind="stable")
            low, high = low[order], high[order]
            begins = np.append(True, low[1:] > high[:-1] + 1)
            self.low = low[begins]
            self.high = high[np.append(np.flatnonzero(begins)[1:] - 1, len(high) - 1)]
        return fresh


def _accept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the deliveries that a range already covers. Rows come sorted by producer and number, best delivery of a number first.

    Between batches only the ranges of the last producer are kept, and of those only the last, as numbers ascend.
    """
    producer, ranges = None, SeenRanges()
    for batch in batches:
        keys = batch.column("producer").dictionary_encode()
        codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        numbers = batch.column("number").fill_null(-1).to_numpy(zero_copy_only=False)
        surplus = batch.column("surplus").to_numpy(zero_copy_only=False).copy()
        cuts = np.flatnonzero(np.diff(codes)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True):
            if a == b or codes[a] < 0:
                continue
            name = keys.dictionary[int(codes[a])].as_py()
            if name != producer:
                producer, ranges = name, SeenRanges()
            surplus[a:b] |= ~ranges.accept(numbers[a:b])
            ranges.low, ranges.high = ranges.low[-1:], ranges.high[-1:]
        yield batch.set_column(batch.schema.get_field_index("surplus"), "surplus", pa.array(surplus))


def surplus_deliveries(df: DataFrame, delivery_id: str = "delivery_id", message_id: str = "message_id", session_id: str = "session_id", total: Column | None = None) -> DataFrame:
    """(delivery_id, session_id, message_key): the deliveries that are not the one to keep of their message.

    The same message: equal session and equal id but for case and outer white space. Kept is the largest ``total`` (null last), then the smallest
    delivery. Ids of a producer's sequence go through seen ranges: first within each input partition, where they stand sorted (no shuffle),
    then what was accepted, spread by producer and block of numbers. So a message delivered millions of times reaches the second step at most
    once per input partition. Malformed ids (all others) are looked up by their exact key: one pre-aggregated best per key, then
    everything that is not that delivery. A null session or null message id is a value like any other. Without rows there is no surplus.
    """
    if total is None:
        total = F.col("tokens.input") + F.col("tokens.output") + F.col("tokens.reasoning")
    key = F.lower(F.regexp_replace(F.col(message_id), OUTER_SPACE, ""))
    d = df.select(F.col(delivery_id).cast("bigint").alias("delivery_id"), F.col(session_id).alias("session_id"), key.alias("message_key"), F.coalesce(total.cast("bigint"), F.lit(-(1 << 62))).alias("total"))
    in_sequence = F.coalesce(F.col("message_key").rlike(SEQUENCE_ID), F.lit(False)) & F.col("session_id").isNotNull()

    part = lambda g: F.regexp_extract("message_key", SEQUENCE_ID, g)
    producer = F.to_json(F.struct("session_id", part(1).alias("a"), part(3).alias("b"), F.length(part(2)).alias("w")))
    numbered = d.filter(in_sequence).select("*", producer.alias("producer"), part(2).cast("bigint").alias("number"), F.lit(False).alias("surplus"))
    order = ["producer", "number", F.desc("total"), "delivery_id"]
    schema = "delivery_id bigint, session_id string, message_key string, total bigint, producer string, number bigint, surplus boolean"
    local = numbered.sortWithinPartitions(*order).mapInArrow(_accept_batches, schema)
    block = F.floor(F.col("number") / BLOCK)
    place = F.when(F.col("surplus"), F.xxhash64("delivery_id")).otherwise(F.xxhash64("producer", block))
    rest = F.when(~F.col("surplus"), F.col("producer")).alias("producer")
    spread = local.select("delivery_id", "session_id", "message_key", "total", rest, "number", "surplus").repartition(place).sortWithinPartitions(*order)
    ranged = spread.mapInArrow(_accept_batches, schema).filter("surplus").select("delivery_id", "session_id", "message_key")

    odd = d.filter(~in_sequence)
    best = odd.groupBy("session_id", "message_key").agg(F.max(F.struct(F.col("total"), (-F.col("delivery_id")).alias("d"))).alias("m")).select((-F.col("m.d")).alias("delivery_id"))
    looked_up = odd.join(best, "delivery_id", "left_anti").select("delivery_id", "session_id", "message_key")
    return ranged.unionByName(looked_up)


def kept_deliveries(df: DataFrame, delivery_id: str = "delivery_id", **names) -> DataFrame:
    """The rows of ``df`` without surplus deliveries, all columns."""
    surplus = surplus_deliveries(df, delivery_id, **names).select(F.col("delivery_id").alias("_surplus_id"))
    return df.join(surplus, F.col(delivery_id) == F.col("_surplus_id"), "left_anti")
