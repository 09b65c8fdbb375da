"""Chat lines put together into ordered, validated conversations by keyed streaming state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opstrata.sources.tables import shared_dir, stream_path

USER, ASSISTANT, SYSTEM = 1, 2, 3
ROLES = {"user": USER, "human": USER, "assistant": ASSISTANT, "ai": ASSISTANT, "model": ASSISTANT, "system": SYSTEM}
#: Sequence numbers of a session that one state holds. Bounds the state and spreads a session with most of the lines over many tasks.
SEGMENT = 512
#: States for each shuffle partition; segments are spread over them by hash.
BUCKETS = 32
#: How long a segment waits for late lines after the newest line it has.
LATENESS = "1 hour"
#: Event time of lines without one, and of the mark that ends a replay and closes every segment.
NO_TIME, END_OF_REPLAY = datetime(2000, 1, 1), datetime(2262, 1, 1)

LINE = "event_id bigint, line_in_event int, line_id bigint, uuid string, parent_uuid string, role tinyint, readable boolean, event_time timestamp"
ORDERED = "session_id string, segment bigint, seq bigint, line_in_event int, line_id bigint, uuid string, parent_uuid string, role tinyint, readable boolean"


def _never(x: str) -> None:
    raise ValueError(x)


def read_message(kind: str | None, message: str | None) -> tuple[int, bool]:
    """(role of the turn or 0 if the line is none, readable). A missing message is readable and no turn; an empty or blank one isn't readable."""
    if message is None:
        return 0, True
    try:
        m = json.loads(message, parse_constant=_never)
        while isinstance(m, str):
            m = json.loads(m, parse_constant=_never)
    except (ValueError, RecursionError):
        return 0, False
    if not isinstance(m, dict):
        return 0, True
    name = m.get("role") if kind is None else kind
    role = ROLES.get(name.strip().lower(), 0) if isinstance(name, str) else 0
    if not role:
        return 0, True
    content = m.get("content")
    if isinstance(content, str):
        return (role if content.strip() else 0), True
    for elements in (content, m.get("parts")):
        if isinstance(elements, list):
            for e in elements:
                if isinstance(e, dict) and e.get("type") == "text" and isinstance(e.get("text"), str) and e["text"].strip():
                    return role, True
    return 0, True


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        read = [read_message(k, m) for k, m in zip(b.column("type").to_pylist(), b.column("message").to_pylist(), strict=True)]
        columns = [b.column(c) for c in ("event_id", "line_in_event", "line_id", "uuid", "parent_uuid")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([r for r, _ in read], pa.int8()), pa.array([x for _, x in read], pa.bool_()), b.column("event_time")],
            ["event_id", "line_in_event", "line_id", "uuid", "parent_uuid", "role", "readable", "event_time"],
        )


def read_lines(lines: DataFrame) -> DataFrame:
    """The columns of LINE from transcript lines; texts end here and aren't shuffled. Works on streams too. A line without number or place gets -1, so comes first."""
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(-1).cast(kind)).alias(c)
    time = F.coalesce(F.try_to_timestamp("timestamp"), F.lit(NO_TIME))
    d = lines.select(
        F.col("event_id").cast("bigint").alias("event_id"), number("line_in_event", "int"), number("line_id", "bigint"),
        F.col("uuid").cast("string").alias("uuid"), F.col("parent_uuid").cast("string").alias("parent_uuid"), "type", "message", time.alias("event_time"),
    )
    return d.mapInArrow(_read_lines, LINE)


def place_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines with the session and sequence number of their hook event; lines of unknown events, and of events without session, belong to none."""
    e = events.filter("session_id is not null and sequence_number is not null").groupBy(F.col("id").alias("event_id")).agg(F.min("session_id").alias("session_id"), F.min("sequence_number").cast("bigint").alias("seq"))
    return lines.join(e, "event_id").withColumn("segment", F.floor(F.col("seq") / SEGMENT)).drop("event_id")


_COLUMNS = ["session_id", "segment", "seq", "line_in_event", "line_id", "uuid", "parent_uuid", "role", "readable"]


def buffer_lines(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of one bucket of segments: their lines so far, each with its event time in ms.

    New lines are added; the timeout is that of the segment to close first. When the watermark passes it, every segment of the bucket whose newest
    line is behind the watermark closes: its lines leave in order, a uuid that recurs at its first place only. The others wait on.
    """
    lines = json.loads(state.get[0]) if state.exists else []
    for b in batches:
        times = (b["event_time"].astype("int64") // 1_000_000 if str(b["event_time"].dtype) == "datetime64[ns]" else b["event_time"].astype("datetime64[ms]").astype("int64")).tolist()
        lines += [list(x) for x in zip(times, *(b[c].astype(object).where(b[c].notna(), None).tolist() for c in _COLUMNS), strict=True)]
    if key[0] is None:
        return  # the mark that ends a replay
    newest: dict[tuple, int] = {}
    for x in lines:
        newest[x[1], x[2]] = max(newest.get((x[1], x[2]), 0), x[0])
    now = state.getCurrentWatermarkMs()
    if state.hasTimedOut:
        ready = sorted((x[1:] for x in lines if newest[x[1], x[2]] <= now), key=lambda x: x[:5])
        seen: set[tuple] = set()
        out = [x for x in ready if x[5] is None or not ((x[0], x[1], x[5]) in seen or seen.add((x[0], x[1], x[5])))]
        lines = [x for x in lines if newest[x[1], x[2]] > now]
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)
    if lines:
        state.update((json.dumps(lines),))
        state.setTimeoutTimestamp(max(min(newest[x[1], x[2]] for x in lines), now + 1))
    elif state.exists:
        state.remove()


def ordered_lines(placed: DataFrame, lateness: str = LATENESS, buckets: int | None = None) -> DataFrame:
    """The stateful operator on a stream of placed lines: lines of closed segments, ordered.

    Segments share ``buckets`` states, by default BUCKETS for each shuffle partition, as a state costs far more than a line; more buckets, smaller states.
    """
    n = buckets or BUCKETS * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.when(F.col("session_id").isNotNull(), F.pmod(F.xxhash64("session_id", "segment"), F.lit(n)))
    return (
        placed.withColumn("bucket", bucket).withWatermark("event_time", lateness).groupBy("bucket")
        .applyInPandasWithState(buffer_lines, ORDERED, "lines string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def replay(spark: SparkSession, path: str, events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """All lines of a table at ``path`` through the stream, until every segment is closed: the written lines of closed segments.

    The table is one micro-batch, so no line of it can be behind the watermark, whatever the order of its files. The mark that
    ends the replay then moves the watermark past every timeout, and the following batch closes all segments. State, progress and output lie in
    the shared folder, so a lost executor costs only its tasks.
    """
    base = shared_dir(spark, "conversations")
    mark = [(None, 0, 0, None, None, 0, True, END_OF_REPLAY, None, 0)]
    names = "line_in_event int, seq bigint, line_id bigint, uuid string, parent_uuid string, role tinyint, readable boolean, event_time timestamp, session_id string, segment bigint"
    spark.createDataFrame(mark, names).write.parquet(f"{base}/mark")
    lines = spark.readStream.schema(spark.read.parquet(path).schema).parquet(stream_path(spark, path))
    stream = place_lines(read_lines(lines), events)
    ends = spark.readStream.schema(spark.read.parquet(f"{base}/mark").schema).parquet(f"{base}/mark")
    provider, used = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            ordered_lines(stream.unionByName(ends), lateness).writeStream.format("parquet").option("path", f"{base}/lines")
            .option("checkpointLocation", f"{base}/progress").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, used) if used else spark.conf.unset(provider)
    return spark.read.schema(ORDERED).parquet(f"{base}/lines")


def first_copies(lines: DataFrame) -> DataFrame:
    """``lines`` without the later copies of a uuid, whatever segments they are in; all lines count, turns or not.

    Segments have dropped their own, so few uuids are left that recur. Their first places are written, so that a small table of them is broadcast.
    """
    place = F.struct("seq", "line_in_event", "line_id")
    first = lines.filter("uuid is not null").groupBy("session_id", "uuid").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("session_id", "uuid", "first")
    path = shared_dir(lines.sparkSession, "recurring")
    first.write.parquet(path)
    again = lines.sparkSession.read.schema(first.schema).parquet(path)
    return lines.join(again, ["session_id", "uuid"], "left").filter(F.col("first").isNull() | (F.col("first") == place)).drop("first")


def validated_turns(lines: DataFrame) -> DataFrame:
    """(session_id, turn_no, uuid, role): the turns of the conversations that are whole, from the lines of closed segments.

    A uuid that recurs counts at its first place only, for all that follows. Kept: every message readable, every parent a uuid of the conversation, a user turn, the first turn other than system turns by user, and between
    a user turn and the next (or the end) an assistant turn. A conversation without turns gives no rows. Segments are judged by themselves
    and summed up in one row; only these rows meet over a session, so no task holds the lines of a long session.
    """
    lines = first_copies(lines)
    place = ["seq", "line_in_event", "line_id"]
    recurs = F.row_number().over(W.partitionBy("session_id", F.coalesce("uuid", F.concat_ws(" ", F.lit("line"), *[F.col(c).cast("string") for c in place]))).orderBy(*place))
    parents = lines.filter("parent_uuid is not null").select("session_id", F.col("parent_uuid").alias("uuid")).distinct()
    orphans = parents.join(lines.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").select("session_id", F.lit(True).alias("broken"))
    unreadable = lines.filter("not readable").select("session_id", F.lit(True).alias("broken"))
    turns = lines.filter("role > 0").withColumn("place", recurs).filter("place = 1")
    by_segment = turns.groupBy("session_id", "segment").agg(F.array_sort(F.collect_list(F.struct(*place, "role", "uuid"))).alias("turns"))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t.role != SYSTEM), lambda t: t.role.cast("string")), "")
    facts = by_segment.select("session_id", "segment", F.size("turns").alias("n"), said.alias("said"))
    w = W.partitionBy("session_id").orderBy("segment")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    spoke = F.when(F.col("said") != "", F.right("said", F.lit(1)))
    facts = facts.select(
        "session_id", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "said", F.last(spoke, ignorenulls=True).over(before).alias("last_said"),
    ).withColumn("after", F.concat(F.coalesce("last_said", F.lit("")), "said"))
    judged = facts.groupBy("session_id").agg(
        F.bool_or(F.col("after").contains(f"{USER}{USER}")).alias("twice"), F.bool_or(F.col("last_said").isNull() & F.col("said").startswith(str(ASSISTANT))).alias("led"),
        F.bool_or(F.col("said").contains(str(USER))).alias("asked"), F.max_by(F.right("after", F.lit(1)), "segment").alias("ends"),
    )
    broken = orphans.unionByName(unreadable).distinct()
    kept = judged.filter(f"asked and not twice and not led and ends <> '{USER}'").join(broken, "session_id", "left_anti").select("session_id")
    # which segments stay is decided on their summary rows; the turns themselves only meet by (session, segment)
    numbered = by_segment.join(facts.join(kept, "session_id", "left_semi").select("session_id", "segment", "offset"), ["session_id", "segment"])
    return numbered.select("session_id", "offset", F.posexplode("turns").alias("pos", "turn")).select("session_id", (F.col("offset") + F.col("pos") + 1).cast("int").alias("turn_no"), F.col("turn.uuid").alias("uuid"), F.col("turn.role").alias("role"))
