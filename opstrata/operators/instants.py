"""Timestamps of mixed formats and zones, normalised to UTC instants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opstrata.functions import zones
from opstrata.functions.timestamps import CANONICAL, to_utc_micros

#: Rows of the host table up to which it is sent to every executor; a larger one is joined by shuffle.
HOSTS_BROADCAST = 100_000


def with_zone(df: DataFrame, hosts: DataFrame, host_id: str = "host_id") -> DataFrame:
    """``df`` (columns record_id, text, host_id) with the zone of its host as zone_name; null where the host is null or unknown."""
    h = hosts.groupBy(F.col("host_id").alias("_h")).agg(F.min("zone_name").alias("zone_name")).filter("_h is not null")
    if hosts.limit(HOSTS_BROADCAST + 1).count() <= HOSTS_BROADCAST:
        h = F.broadcast(h)
    return df.join(h, F.col(host_id) == F.col("_h"), "left").drop("_h")


def normalise(df: DataFrame, hosts: DataFrame, record_id: str, text: str, host_id: str = "host_id", skip_canonical: bool = False, keep: str | None = None) -> DataFrame:
    """(record_id, utc_micros), one row per record whose text denotes an instant; see ``to_utc_micros`` for the rules.

    Rows repeated under an id count once; should they differ, the earliest instant holds. Texts that denote none (null, blank, words, impossible dates,
    local times without any zone) give no row. With ``skip_canonical`` records that are already of the form yyyy-MM-ddTHH:mm:ss.ffffffZ are left out.
    Executors whose zone tables are of another release than the driver's fail instead of giving other instants. ``keep`` names a text column that comes along as the second column; records then are told apart by it too.
    """
    kept = [keep] if keep else []

    release = zones.version()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zones.check(release)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("record_id"), *map(b.column, kept), to_utc_micros(b.column("text"), b.column("zone_name"))], ["record_id", *kept, "utc_micros"])

    d = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).alias("text"), F.col(host_id).alias("host_id"), *kept).filter(F.col("text").isNotNull())
    if skip_canonical:
        d = d.filter(~F.col("text").rlike(CANONICAL))
    d = with_zone(d, hosts).select("record_id", *kept, "text", "zone_name")
    schema = ", ".join(["record_id bigint", *(f"{c} string" for c in kept), "utc_micros bigint"])
    return d.mapInArrow(kernel, schema).filter("utc_micros is not null").groupBy("record_id", *kept).agg(F.min("utc_micros").alias("utc_micros"))
