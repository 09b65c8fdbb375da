"""Sessions from their events: headers, counts, first and last state, lists, lookups, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions.events import DEFAULT_SOURCE, letters_and_digits
from opstrata.functions.timestamps import CANONICAL
from opstrata.operators.instants import normalise

HEADER = ["session_id", "sequence_number", "event_type", "tool_type", "duration_ms", "error_message", "source"]


def distinct_events(hook_events: DataFrame, *columns: str) -> DataFrame:
    """Events with a session, each once, with the given columns only (so the scan reads no others); the rows of a repeated event agree in all but its JSON."""
    return hook_events.select("id", *[c for c in columns if c != "id"]).filter("session_id is not null").distinct()


def canonical_time(text: Column) -> Column:
    """The instant of a timestamp already in canonical form, as UTC; null for others (``instants.normalise`` reads those)."""
    return F.when(text.rlike(CANONICAL), F.try_to_timestamp(F.rtrim(text, F.lit("Z"))).cast("timestamp_ntz"))


def session_times(hook_events: DataFrame, hosts: DataFrame) -> DataFrame:
    """(session_id, first_time, last_time) over the instants of a session's events, of whatever form their timestamps are; a session without any has no row.

    A repeated event counts once, by ``normalise``; what meets other figures is one row per session.
    """
    t = normalise(hook_events.filter("session_id is not null"), hosts, "id", "timestamp", keep="session_id")
    time = lambda c: F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return t.groupBy("session_id").agg(F.min("utc_micros").alias("a"), F.max("utc_micros").alias("b")).select("session_id", time(F.col("a")).alias("first_time"), time(F.col("b")).alias("last_time"))


def header_aggregates() -> list[Column]:
    """AGG-01 without times. An error is a message that is neither null nor empty; the average over all events counts events without duration too, as the usual one doesn't."""
    total = F.coalesce(F.sum("duration_ms"), F.lit(0))
    return [
        F.count(F.lit(1)).alias("n_events"), F.min("sequence_number").alias("first_sequence"), F.max("sequence_number").alias("last_sequence"),
        F.count_if(F.col("error_message").isNotNull() & (F.col("error_message") != "")).alias("n_errors"), total.alias("total_duration_ms"),
        (total / F.count(F.lit(1))).alias("avg_duration_all_events"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
    ]


def canonical_times() -> list[Column]:
    """First and last time where all timestamps are known to be canonical; ``session_times`` reads all forms."""
    return [F.min(canonical_time(F.col("timestamp"))).alias("first_time"), F.max(canonical_time(F.col("timestamp"))).alias("last_time")]


def headers(events: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """AGG-01. ``times`` are those of ``session_times``; without them all timestamps must be canonical."""
    if times is None:
        return events.groupBy("session_id").agg(*header_aggregates(), *canonical_times())
    return events.groupBy("session_id").agg(*header_aggregates()).join(times, "session_id", "left")


def counts_by(events: DataFrame, *keys: str) -> DataFrame:
    """AGG-02/03: events per session and key(s); null keys are left out."""
    return events.dropna(subset=list(keys)).groupBy("session_id", *keys).agg(F.count(F.lit(1)).alias("n_events"))


def summaries(events: DataFrame) -> DataFrame:
    """AGG-04: a row per session and project; a session that changes its project gives several."""
    return events.groupBy("session_id", "project_name", "project_source").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("tool_type").alias("n_tools"), F.coalesce(F.max("source"), F.lit(DEFAULT_SOURCE)).alias("source")
    )


def recent(events: DataFrame, limit: int, directory: str | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """AGG-05, PF-06: the sessions whose first event is newest; with a directory those with any event in it. Without ``hosts`` (the zones of local times) all timestamps must be canonical."""
    if directory is not None:
        events = events.filter(F.col("working_directory") == directory)
    if hosts is None:
        d = events.groupBy("session_id").agg(*canonical_times())
    else:
        d = events.select("session_id").distinct().join(session_times(events, hosts), "session_id", "left")
    return d.select("session_id", "first_time").orderBy(F.desc_nulls_last("first_time"), "session_id").limit(limit)


def git_states() -> list[Column]:
    """WN-04: first and last known state of the repository, and the commits made in between (0 unless both are repositories, never less)."""
    known = F.when(F.col("git_state").isNotNull(), F.col("sequence_number"))
    first, last = F.min_by("git_state", known), F.max_by("git_state", known)
    made = F.when(first["is_git_repo"] & last["is_git_repo"], F.greatest(last["commit_count"] - first["commit_count"], F.lit(0))).otherwise(0)
    return [first["commit_count"].alias("first_commit_count"), last["commit_count"].alias("last_commit_count"), last["current_branch"].alias("last_branch"), F.coalesce(made, F.lit(0)).alias("commits_made")]


def first_attributes() -> list[Column]:
    """WN-05: directory, project and transcript of the first event; an unknown directory is named so, a project needs a name."""
    first = F.min_by(F.struct("working_directory", "project_name", "project_source", "transcript_path"), "sequence_number")
    return [
        F.coalesce(first["working_directory"], F.lit("Unknown")).alias("working_directory"), first["project_name"].alias("project_name"),
        F.when(first["project_name"].isNotNull(), first["project_source"]).alias("project_source"), first["transcript_path"].alias("transcript_path"),
    ]


def statistics(events: DataFrame, times: DataFrame) -> DataFrame:
    """CP-01: all of a session's figures in one aggregation, for all sessions at once; ``times`` (``session_times``) are joined as one row per session."""
    d = events.groupBy("session_id").agg(
        *header_aggregates(), *git_states(), *first_attributes(), F.count_distinct("tool_type").alias("n_tools"),
        F.count_if(F.col("event_type") == "PreToolUse").alias("n_pre"), F.count_if(F.col("event_type") == "PostToolUse").alias("n_post"), F.count_if(F.col("event_type") == "Stop").alias("n_stop"),
    )
    return d.join(times, "session_id", "left")


def pre_post_pairs(events: DataFrame) -> DataFrame:
    """JN-21: calls with their results: (pre_id, post_id, duration_ms).

    A result belongs to the call before it with the same session and call_id. Where no call_id is shared, a call and a result are paired if they are neighbours
    in their session and their tool names agree by letters and digits; where a name is missing, if their tool types agree. An equi-join on the place.
    """
    e = events.groupBy("id", "session_id", "sequence_number", "event_type", "tool_name", "tool_type", "duration_ms").agg(F.max("call_id").alias("call_id"))
    w = W.partitionBy("session_id", F.coalesce(F.concat(F.lit("c"), "call_id"), F.concat(F.lit("i"), F.col("id").cast("string")))).orderBy("sequence_number", "id")
    is_pre = F.col("event_type") == "PreToolUse"
    answered = is_pre & (F.lead("event_type").over(w) == "PostToolUse")
    caller = F.when(~is_pre & (F.lag("event_type").over(w) == "PreToolUse"), F.lag("id").over(w))
    e = e.select("*", F.nullif(letters_and_digits(F.col("tool_name")), F.lit("")).alias("name"), F.coalesce(answered, F.lit(False)).alias("answered"), caller.alias("caller"))
    by_id = e.filter("caller is not null").select(F.col("caller").alias("pre_id"), F.col("id").alias("post_id"), "duration_ms")
    pre = e.filter(is_pre & ~F.col("answered")).select("session_id", (F.col("sequence_number") + 1).alias("sequence_number"), F.col("id").alias("pre_id"), F.col("name").alias("_name"), F.col("tool_type").alias("_type"))
    post = e.filter(~is_pre & F.col("caller").isNull()).select("session_id", "sequence_number", F.col("id").alias("post_id"), "duration_ms", "name", "tool_type")
    same = F.coalesce(F.col("name") == F.col("_name"), F.col("tool_type") == F.col("_type"))
    return by_id.unionByName(pre.join(post, ["session_id", "sequence_number"]).filter(same).select("pre_id", "post_id", "duration_ms"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """SNK-04/05, WN-15/16: the newest row of each key, null keys being equal to each other. ``order`` is newest first and decides ties."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def unique_prefix(df: DataFrame, column: str, length: int) -> DataFrame:
    """PF-07: prefixes of ``length`` that lead to exactly one value."""
    return df.select(column).distinct().groupBy(F.left(column, F.lit(length)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias(column)).filter("n = 1").select("prefix", column)


def before_cutoff(df: DataFrame, time: str, cutoff: str, entity: str) -> DataFrame:
    """SNK-10: what a clean-up by age would delete, counted first: entities and rows older than the cutoff."""
    return df.filter(F.col(time) < F.lit(cutoff).cast("timestamp_ntz")).agg(F.count_distinct(entity).alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))


def kept_after(df: DataFrame, time: str, cutoff: str) -> DataFrame:
    """SNK-10: the rows that stay, for the rewrite of the table; rows without time stay."""
    return df.filter(F.col(time).isNull() | (F.col(time) >= F.lit(cutoff).cast("timestamp_ntz")))
