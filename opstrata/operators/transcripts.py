"""Transcripts: lines of sessions, token usage, compactions, tool results, files read and edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstrata.functions.events import opened, readable, tool_category
from opstrata.operators.running import previous, running_sum

#: Lines of a session that share a task where lines need their neighbours.
CHUNK = 20_000
DIALECT_A = "role string, usage struct<input_tokens:bigint,output_tokens:bigint>, content array<struct<type:string,id:string,name:string,tool_use_id:string,input:struct<subagent_type:string,file_path:string>>>"
DIALECT_B = "role string, agent string, tokens struct<input:bigint,output:bigint,reasoning:bigint>, parts array<struct<type:string,tool:string,text:string,auto:boolean>>"


def session_lines(transcript: DataFrame, hook_events: DataFrame, *columns: str) -> DataFrame:
    """Lines with the session of their event, ``line`` numbering them over all sessions; lines of unknown events are left out."""
    e = hook_events.select(F.col("id").alias("event_id"), F.col("session_id").alias("session")).filter("session is not null").distinct()
    return transcript.select("event_id", F.col("line_id").alias("line"), *columns).join(e, "event_id").withColumnRenamed("session", "session_id").drop("event_id")


def parsed(message: Column, schema: str) -> Column:
    """A readable message by schema; fields of another kind, a content that is text for one, are null."""
    return F.from_json(F.when(readable(message).isNotNull(), message), schema)


def turns_a(lines: DataFrame) -> DataFrame:
    """Assistant turns of dialect A that used tokens: (session_id, line, input, output, n_tools, n_explore). Turns without input and output are skipped."""
    m = lines.filter(F.lower(F.trim("type")) == "assistant").select("session_id", "line", parsed(F.col("message"), DIALECT_A).alias("m")).filter("m.usage is not null")
    tools = F.filter(F.coalesce("m.content", F.array().cast("array<struct<type:string,id:string,name:string,tool_use_id:string,input:struct<subagent_type:string,file_path:string>>>")), lambda x: x.type == "tool_use")
    t = m.select("session_id", "line", F.coalesce("m.usage.input_tokens", F.lit(0)).alias("input"), F.coalesce("m.usage.output_tokens", F.lit(0)).alias("output"), tools.alias("tools")).filter("input > 0 or output > 0")
    explores = F.filter("tools", lambda x: F.coalesce(tool_category(x["name"], x["input"]["subagent_type"]) == "search", F.lit(False)))
    return t.select("session_id", "line", "input", "output", F.size("tools").alias("n_tools"), F.size(explores).alias("n_explore"))


def turns_b(lines: DataFrame) -> DataFrame:
    """Assistant turns of dialect B with a token record, zeros included; reasoning is output; the agents explore and search explore whatever they use."""
    m = lines.filter("type is null").select("session_id", "line", parsed(F.col("message"), DIALECT_B).alias("m")).filter("m.tokens is not null and lower(trim(m.role)) = 'assistant'")
    tools = F.filter(F.coalesce("m.parts", F.array().cast("array<struct<type:string,tool:string,text:string,auto:boolean>>")), lambda x: x.type == "tool")
    explores = F.filter("tools", lambda x: F.coalesce(tool_category(x["tool"]) == "search", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = m.select("session_id", "line", zero("m.tokens.input").alias("input"), (zero("m.tokens.output") + zero("m.tokens.reasoning")).alias("output"), F.coalesce(F.lower("m.agent").isin("explore", "search"), F.lit(False)).alias("explorer"), tools.alias("tools"))
    n = F.size("tools")
    return t.select("session_id", "line", "input", "output", F.when(F.col("explorer"), 1).otherwise(n).alias("n_tools"), F.when(F.col("explorer"), 1).otherwise(F.size(explores)).alias("n_explore"))


def incremental(turns: DataFrame) -> DataFrame:
    """WN-02: what each turn adds to the context, ``max(0, input - input of the turn before)``; the first turn adds all of it."""
    return previous(turns, "session_id", "line", "input", "_before", CHUNK).withColumn("added", F.greatest(F.col("input") - F.coalesce("_before", F.lit(0)), F.lit(0))).drop("_before")


def usage(turns: DataFrame) -> DataFrame:
    """CP-03 per session: tokens added and put out, split into exploring and implementing by each turn's share of exploring tools, both halves cut off; final context."""
    t = incremental(turns)
    share = F.col("n_explore") / F.col("n_tools")
    part = lambda x, explore: F.when((F.col("n_tools") == 0) | (F.col("n_explore") == 0), F.lit(0) if explore else x).when(F.col("n_explore") == F.col("n_tools"), x if explore else F.lit(0)).otherwise(F.floor(x * (share if explore else 1 - share)))
    return t.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("added").alias("input_tokens"), F.sum("output").alias("output_tokens"),
        F.sum(part(F.col("added"), True)).alias("explore_input"), F.sum(part(F.col("added"), False)).alias("implement_input"),
        F.sum(part(F.col("output"), True)).alias("explore_output"), F.sum(part(F.col("output"), False)).alias("implement_output"), F.max_by("input", "line").alias("final_context"),
    )


def subagent_tokens(lines: DataFrame) -> DataFrame:
    """JN-06: tokens that sub-agents report, by what their call was for. A result belongs to the earliest earlier tool use with its id; unknown ids count as other."""
    m = lines.select("session_id", "line", "type", "tool_use_result", parsed(F.col("message"), DIALECT_A).alias("m"))
    uses = m.select("session_id", F.col("line").alias("use_line"), F.explode("m.content").alias("c")).filter("c.type = 'tool_use' and c.id is not null")
    uses = uses.groupBy("session_id", F.col("c.id").alias("tool_id")).agg(F.min_by(F.struct("use_line", F.coalesce(tool_category(F.col("c.name"), F.col("c.input.subagent_type")), F.lit("implementation")).alias("category")), "use_line").alias("u"))
    total = F.try_variant_get(readable(F.col("tool_use_result")), "$.totalTokens", "bigint")
    first = F.get(F.filter("m.content", lambda c: c.type == "tool_result"), F.lit(0)).tool_use_id
    results = m.filter("tool_use_result is not null").select("session_id", "line", first.alias("tool_id"), total.alias("tokens")).filter("tool_id is not null and tokens is not null")
    j = results.join(uses, ["session_id", "tool_id"], "left").withColumn("category", F.when(F.col("u.use_line") < F.col("line"), F.col("u.category")))
    kind = F.when(F.col("category") == "search", "explore").otherwise("other").alias("kind")
    return j.groupBy("session_id", kind).agg(F.count(F.lit(1)).alias("results"), F.sum("tokens").alias("tokens"))


def compactions(lines: DataFrame) -> DataFrame:
    """CP-04, JN-03: a boundary with the first later summary that names it as parent: (session_id, line, summary_line, trigger, pre_tokens).

    The line is the boundary's. Of boundaries that share a uuid the latest before the summary counts. Unmatched ones are dropped.
    """
    b = lines.filter("lower(trim(type)) = 'system' and subtype = 'compact_boundary' and uuid is not null").select("session_id", "uuid", "line", "compact_metadata")
    s = lines.filter("is_compact_summary and parent_uuid is not null").select("session_id", F.col("parent_uuid").alias("uuid"), F.col("line").alias("summary_line"))
    pair = b.join(s, ["session_id", "uuid"]).filter("line < summary_line")
    chosen = pair.groupBy("session_id", "uuid", "summary_line").agg(F.max_by(F.struct("line", "compact_metadata"), "line").alias("b")).groupBy("session_id", "b").agg(F.min("summary_line").alias("summary_line"))
    v = readable(F.col("b.compact_metadata"))
    return chosen.select(
        "session_id", F.col("b.line").alias("line"), "summary_line", F.coalesce(F.try_variant_get(v, "$.trigger", "string"), F.lit("unknown")).alias("trigger"),
        F.coalesce(F.try_variant_get(v, "$.preTokens", "bigint"), F.lit(0)).alias("pre_tokens"),
    )


def nearest_before(left: DataFrame, right: DataFrame, entity: str, place: str, within: int, carry: str | None = None) -> DataFrame:
    """JN-05: ``left`` (entity, place, …) with ``found``: the nearest place of ``right`` at most ``within`` before it, null if none; ``carry`` names a column of ``right`` that comes along.

    An as-of join by equality: right rows fall in buckets of ``within`` places, left rows look into their own bucket and the one before.
    """
    r = right.select(F.col(entity).alias("_e"), F.col(place).alias("_p"), F.floor(F.col(place) / within).alias("_b"), *([F.col(carry).alias("_c")] if carry else []))
    bucket = F.floor((F.col(place) - 1) / within)
    probe = left.withColumn("_b0", F.explode(F.array(bucket, bucket - 1)))
    j = probe.join(r, (F.col(entity) == F.col("_e")) & (F.col("_b0") == F.col("_b")) & (F.col("_p") < F.col(place)) & (F.col("_p") >= F.col(place) - within), "left")
    return j.groupBy(*left.columns).agg(F.max("_p").alias("found"), *([F.max_by("_c", "_p").alias(carry)] if carry else []))


def compact_instructions(lines: DataFrame, within: int = 50) -> DataFrame:
    """JN-05, CP-04: boundaries (session_id, line) with the nearest user line at most ``within`` lines before whose content is a text with /compact in any case.

    ``found`` is that line's number in the session and ``instructions`` its text, both null if there is none. Only such texts go through the shuffle.
    """
    content = F.try_variant_get(opened(F.col("message")), "$.content", "variant")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    asks = F.lower(F.trim("type")).isin("user", "human") & F.lower(text).contains("/compact")
    n = numbered(lines.select("session_id", "line", (F.col("subtype") == "compact_boundary").alias("boundary"), F.when(asks, text).alias("instructions")))
    return nearest_before(n.filter("boundary").select("session_id", "line", "n"), n.filter("instructions is not null"), "session_id", "n", within, "instructions").drop("n")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``n``, their number within the session from 1."""
    return running_sum(lines, "session_id", "line", F.lit(1), "n", CHUNK)


def metadata(lines: DataFrame) -> DataFrame:
    """SRC-04: first version, branch and model of each session's transcript."""
    model = F.try_variant_get(readable(F.col("message")), "$.model", "string")
    d = lines.withColumn("model", F.when(F.lower(F.trim("type")) == "assistant", model))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    return d.groupBy("session_id").agg(first("version").alias("version"), first("git_branch").alias("git_branch"), first("model").alias("model"), F.count(F.lit(1)).alias("lines"))


def compactions_b(transcripts: DataFrame) -> DataFrame:
    """JN-04 from (session_id, m), m the document with the transcript: user messages with a compaction part that the compacting agent answers next: (session_id, pos, trigger, pre_tokens).

    Neighbours are looked up within the array, so no window is needed.
    """
    message = "struct<role:string,agent:string,tokens:struct<input:bigint>,parts:array<struct<type:string,auto:boolean>>>"
    t = transcripts.select("session_id", F.from_json("m", f"transcript array<{message}>")["transcript"].alias("t"))
    d = t.select("session_id", "t", F.posexplode("t").alias("pos", "x")).withColumn("next", F.get("t", F.col("pos") + 1))
    part = F.get(F.filter("x.parts", lambda p: p.type == "compaction"), F.lit(0))
    d = d.withColumn("part", part).filter("x.role = 'user' and part is not null and next.role = 'assistant' and next.agent = 'compaction'")
    return d.select("session_id", "pos", F.when(F.coalesce("part.auto", F.lit(False)), "auto").otherwise("manual").alias("trigger"), F.coalesce("next.tokens.input", F.lit(0)).alias("pre_tokens"))
