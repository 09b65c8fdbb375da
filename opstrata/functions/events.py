"""Expressions over event rows: kinds, tool categories, JSON access, identity."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools that look around and tools that change things, by lower-case name.
SEARCH_TOOLS = (
    "grep", "glob", "websearch", "webfetch", "read", "ls", "todoread", "tasklist", "taskget", "notebookread", "mcp__ide__getdiagnostics", "mcp__ide__getworkspaceinfo", "mcp__ide__getfilecontents",
    "mcp__ide__searchfiles", "mcp__filesystem__read", "mcp__filesystem__list", "mcp__database__query", "mcp__database__schema", "mcp__web__scrape", "mcp__web__search", "mcp__github__getrepo",
    "mcp__github__listissues", "mcp__slack__listchannels",
)
IMPLEMENTATION_TOOLS = (
    "write", "edit", "multiedit", "bash", "todowrite", "taskcreate", "taskupdate", "notebookedit", "exit_plan_mode", "mcp__ide__executecode", "mcp__ide__createfile", "mcp__ide__deletefile",
    "mcp__ide__renamefile", "mcp__filesystem__write", "mcp__github__createissue", "mcp__slack__sendmessage",
)
#: Events of the plugin and the event types they stand for.
PLUGIN_EVENTS = {
    "tool_start": "PreToolUse", "tool_end": "PostToolUse", "message": "MessageUpdated", "todo": "TodoUpdated", "stop": "Stop", "subagent_start": "SubagentStart", "subagent_stop": "SubagentStop",
}
DEFAULT_SOURCE = "claude_code"


def plugin_event_type(name: Column) -> Column:
    """The event type of a plugin event (PF-02); null for unknown ones."""
    return F.create_map(*[F.lit(x) for x in chain(*PLUGIN_EVENTS.items())])[name]


def tool_category(name: Column, subagent: Column | None = None) -> Column:
    """search, implementation or null (neither); a task counts by whether its sub-agent explores."""
    low = F.lower(name)
    task = F.when(low == "task", F.when(F.lower(F.coalesce(subagent, F.lit(""))).contains("explore"), "search").otherwise("implementation")) if subagent is not None else F.when(F.lit(False), "")
    return F.coalesce(task, F.when(low.isin(*SEARCH_TOOLS), "search").when(low.isin(*IMPLEMENTATION_TOOLS), "implementation"))


def tool_type(name: Column) -> Column:
    """The normalised type of a tool name (lower case): known ones as they are, mcp__other or other (PF)."""
    low = F.lower(name)
    return F.when(low.isin(*SEARCH_TOOLS, *IMPLEMENTATION_TOOLS, "task"), low).when(low.startswith("mcp__"), "mcp__other").when(low.isNotNull(), "other")


def letters_and_digits(name: Column) -> Column:
    """What of a name counts for equality: its letters and digits in lower case; null stays null."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def readable(text: Column) -> Column:
    """The text as VARIANT; null where it is no JSON."""
    return F.try_parse_json(text)


def opened(text: Column) -> Column:
    """As ``readable``, also where the document is wrapped in JSON strings, at any depth.

    A wrap doubles the backslashes of those inside, so n wraps take at least 2 ** n characters and the logarithm of the length bounds them. Only texts that begin with a quote pay.
    """
    wrapped = lambda t: F.ltrim(t, F.lit(" \t\r\n")).startswith('"')
    inner = lambda t, _: F.when(wrapped(t), F.try_variant_get(readable(t), "$", "string")).otherwise(t)
    levels = F.sequence(F.lit(1), F.floor(F.log2(F.length(text))).cast("int") + 1)
    return readable(F.when(wrapped(text), F.aggregate(levels, text, inner)).otherwise(text))


def at(variant: Column, path: str, kind: str = "string") -> Column:
    """A value inside a VARIANT, null where it is absent or of another kind."""
    return F.try_variant_get(variant, path, kind)


def event_kind(keys: Column, stop_active: Column) -> Column:
    """The kind of a raw payload by which fields it has (PF-01); null where none fits."""
    has = lambda k: F.array_contains(keys, k)
    return (
        F.when(has("tool_name") & has("tool_input") & has("tool_response"), "PostToolUse").when(has("tool_name") & has("tool_input"), "PreToolUse").when(has("message"), "Notification")
        .when(has("stop_hook_active"), F.when(stop_active, "SubagentStop").otherwise("Stop")).when(has("session_id") & has("transcript_path"), "Stop")
    )


def captures_git(event_type: Column, sequence: Column) -> Column:
    """Whether an event carries the state of the repository: every stop, and the first event of a session (PF-03)."""
    return event_type.isin("Stop", "SubagentStop") | ((sequence == 1) & event_type.isin("PreToolUse", "SubagentStart"))
