"""Deeply nested JSON records as flat tables that keep the link of child and parent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opstrata.functions.json_nodes import nodes

SCHEMA = "record_id bigint, path string, parent_path string, ordinal int, kind string, value string"
#: Bytes of text that the kernels take at once; bounds a task's memory whatever the length of the texts.
KERNEL_BYTES = 4 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most KERNEL_BYTES of text together, or of one longer text."""
    size = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64), out=size[1:])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, size[a] + KERNEL_BYTES, "right")) - 1)
        yield a, b
        a = b


def flatten_json(df: DataFrame, record_id: str, text: str, want: str = "objects", columns: tuple[str, ...] = ("path", "parent_path", "ordinal")) -> DataFrame:
    """One row per nested value of a JSON column: (record_id, *columns), ``columns`` out of path, parent_path, ordinal, kind, value.

    ``want`` is ``array_objects``, ``objects`` or ``values``, see ``json_nodes.nodes``. Objects keep their record and their place (path), and link to
    the row of the object or array that holds them by (record_id, parent_path). Rows repeated under an id count once, also if written
    otherwise. Null, empty, blank or unreadable texts and an empty table give no rows; a null id is kept as a record of its own.
    A field name that recurs in one object is followed at each of its places.
    Other columns of ``df`` are never read.
    """

    names = ["record_id", *columns]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _slices(texts):
                out = nodes(texts.slice(a, b - a), want)
                taken = ids.slice(a, b - a).take(out["row"].combine_chunks())
                yield from out.set_column(0, "record_id", taken).select(names).to_batches()

    fields = [f for f in SCHEMA.split(", ") if f.split()[0] in names]
    source = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return source.mapInArrow(kernel, ", ".join(fields)).select(*names).distinct()
