"""How a session's todo list develops: snapshots, their differences, what happened between them."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions.events import at, readable, tool_category
from opstrata.operators.running import running_sum

TODOS = "array<struct<content:string,status:string>>"
NOT_COUNTED = ("todowrite", "taskcreate", "taskupdate")
PLAN_FILE = r"\.claude[/\\]plans[/\\][a-zA-Z0-9_-]+\.md$"
CHUNK = 20_000


def _once(hook_events: DataFrame, condition: str, *columns: str) -> DataFrame:
    """The events of a condition, each id once, with the readable one of its JSON texts (the greatest, if written differently)."""
    e = hook_events.filter(condition).filter("session_id is not null")
    text = F.max(F.when(readable(F.col("metadata")).isNotNull(), F.col("metadata"))).alias("metadata")
    return e.groupBy("id", "session_id", "sequence_number", *columns).agg(text)


def snapshots(hook_events: DataFrame) -> DataFrame:
    """(session_id, seq, todos): accepted todo lists in order of events.

    In a session with any todo event, todo tools are ignored (WN-09); todo events without todos are skipped; an empty list after none or an empty one changes
    nothing and is left out. Todos are keyed by content, the last of a name counts, one without content doesn't.
    """
    e = _once(hook_events, "event_type = 'TodoUpdated' or (event_type = 'PostToolUse' and lower(tool_name) = 'todowrite')", "event_type")
    m = F.from_json("metadata", f"todos {TODOS}, tool_input struct<todos:{TODOS}>, args struct<todos:{TODOS}>")
    s = e.select("session_id", F.col("sequence_number").alias("seq"), "event_type", m.alias("m"))
    own = F.max((F.col("event_type") == "TodoUpdated").cast("int")).over(W.partitionBy("session_id")) == 1
    todos = F.when(F.col("event_type") == "TodoUpdated", F.col("m.todos")).otherwise(F.coalesce("m.tool_input.todos", "m.args.todos"))
    s = s.select("session_id", "seq", "event_type", F.filter(todos, lambda t: t.content.isNotNull()).alias("t"), own.alias("own")).filter("t is not null and own = (event_type = 'TodoUpdated')")
    s = s.filter("not (event_type = 'TodoUpdated' and size(t) = 0)")
    names = F.array_distinct(F.transform("t", lambda t: t.content))
    last = F.transform(names, lambda n: F.element_at(F.filter("t", lambda t: t.content == n), -1))
    s = s.select("session_id", "seq", F.array_sort(last).alias("todos"))
    before = F.lag(F.size("todos"), 1, 0).over(W.partitionBy("session_id").orderBy("seq"))
    return s.withColumn("_before", before).filter("size(todos) > 0 or _before > 0").drop("_before")


def differences(snaps: DataFrame) -> DataFrame:
    """WN-06 per snapshot: step (from 1), n_todos, what was added, removed and changed in status since the one before, and what became completed."""
    w = W.partitionBy("session_id").orderBy("seq")
    names = lambda c: F.transform(c, lambda t: t.content)
    d = snaps.withColumn("step", F.row_number().over(w)).withColumn("prev", F.coalesce(F.lag("todos").over(w), F.array().cast(TODOS)))
    d = d.withColumn("added", F.array_except(names("todos"), names("prev"))).withColumn("removed", F.array_except(names("prev"), names("todos")))
    d = d.withColumn("changed", F.filter(F.array_except("todos", "prev"), lambda t: ~F.array_contains(F.col("added"), t.content)))
    completed = F.transform(F.filter("changed", lambda t: t.status == "completed"), lambda t: t.content)
    return d.select("session_id", "seq", "step", "todos", "added", "removed", names("changed").alias("changed"), completed.alias("completed"))


def steps(hook_events: DataFrame) -> DataFrame:
    """WN-07: each accepted snapshot with the tool events since the one before: all, exploring, implementing. Todo and task tools aren't counted."""
    diffs = differences(snapshots(hook_events))
    tool = _once(hook_events, f"event_type = 'PostToolUse' and tool_name is not null and lower(tool_name) not in {NOT_COUNTED}", "tool_name")
    v = readable(F.col("metadata"))
    category = tool_category(F.col("tool_name"), F.coalesce(at(v, "$.tool_input.subagent_type"), at(v, "$.args.subagent_type")))
    tools = tool.select("session_id", F.col("sequence_number").alias("seq"), F.lit(0).alias("snap"), category.alias("category"))
    marks = diffs.select("session_id", "seq", F.lit(1).alias("snap"), F.lit(None).cast("string").alias("category"))
    islands = running_sum(tools.unionByName(marks), "session_id", "seq", F.col("snap"), "before", CHUNK).filter("snap = 0")
    per = islands.groupBy("session_id", (F.col("before") + 1).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("category") == "search").alias("search"), F.count_if(F.col("category") == "implementation").alias("implementation"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "search", "implementation")]
    return diffs.join(per, ["session_id", "step"], "left").select("session_id", "step", "seq", "todos", "added", "removed", "changed", "completed", *zero)


def evolution(step_rows: DataFrame) -> DataFrame:
    """AGG-16, CP-02 per session: todos ever created and completed, their ratio, events per step, share of exploring.

    A todo is completed if its status ever changed to completed or is so at the end. Todos are counted as rows by (session, content), so no
    task gathers all todos of a session.
    """
    figures = step_rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_steps"), F.max("step").alias("last_step"), *[F.sum(c).alias(c) for c in ("events", "search", "implementation")])
    none = F.array().cast("array<string>")
    final = F.transform(F.filter("todos", lambda t: t.status == "completed"), lambda t: t.content)
    d = step_rows.join(figures.select("session_id", "last_step"), "session_id").select("session_id", F.array_union("added", "changed").alias("created"), F.array_union("completed", F.when(F.col("step") == F.col("last_step"), final).otherwise(none)).alias("done"))
    each = lambda c, done: d.select("session_id", F.explode(c).alias("content"), F.lit(done).alias("done"))
    todos = each("created", 0).unionByName(each("done", 1)).groupBy("session_id", "content").agg(F.max("done").alias("done"))
    n = todos.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_created"), F.sum("done").alias("n_completed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return figures.join(n, "session_id", "left").select(
        "session_id", "n_steps", zero("n_created").alias("n_created"), zero("n_completed").alias("n_completed"), F.coalesce(F.try_divide("n_completed", "n_created"), F.lit(0.0)).alias("efficiency"),
        (F.col("events") / F.col("n_steps")).alias("events_per_step"), F.coalesce(F.try_divide(F.col("search") * 100, F.col("search") + F.col("implementation")), F.lit(0.0)).alias("exploration_percent"),
    )


def plan_files(hook_events: DataFrame) -> DataFrame:
    """SF-04: distinct plan files that a session wrote."""
    tool = _once(hook_events, "event_type = 'PostToolUse' and lower(tool_name) = 'write'")
    v = readable(F.col("metadata"))
    path = F.coalesce(at(v, "$.tool_input.file_path"), at(v, "$.args.file_path"))
    return tool.select("session_id", path.alias("path")).filter(F.col("path").rlike(PLAN_FILE)).distinct()


def task_lists(changes: DataFrame) -> DataFrame:
    """WN-08: the full task list after each change, from rows (session_id, seq, kind, task_id, subject, status).

    A create adds a task under its id (its subject, if it has none) as pending; an update sets the status of a known id, ``deleted`` removes it; unknown ids change
    nothing. The fold runs over the task changes of a session only, which are few.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        tasks: dict[str, tuple[str, str]] = {}
        out = []
        for r in pdf.sort_values("seq").itertuples():
            key = r.task_id if isinstance(r.task_id, str) else r.subject
            if r.kind == "create" and isinstance(key, str):
                tasks[key] = (r.subject if isinstance(r.subject, str) else key, "pending")
            elif r.kind == "update" and key in tasks:
                if r.status == "deleted":
                    del tasks[key]
                else:
                    tasks[key] = (r.subject if isinstance(r.subject, str) else tasks[key][0], r.status if isinstance(r.status, str) else tasks[key][1])
            out.append((r.session_id, r.seq, [{"content": c, "status": s} for c, s in tasks.values()]))
        return pd.DataFrame(out, columns=["session_id", "seq", "todos"])

    return changes.groupBy("session_id").applyInPandas(fold, f"session_id string, seq int, todos {TODOS}")
