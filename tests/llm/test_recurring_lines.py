"""A uuid that recurs, with and without a segment border between its copies."""

import json
from collections import defaultdict

import pytest

from opstrata.llm import conversations as c

U, A = ({"role": r, "content": "x"} for r in ("user", "assistant"))


@pytest.mark.parametrize("segment", [2, 512])
def test_later_copies_count_nowhere(spark, tmp_path, monkeypatch, segment):
    """Whether a segment border lies between the copies of a uuid or not: no turn, orphan or unreadable line comes from a later one."""
    monkeypatch.setattr(c, "SEGMENT", segment)
    talks = {
        "no turn first": [("a", U, None), ("x", 5, None), ("b", A, None), ("c", A, None), ("x", U, None)], "unreadable later": [("a", U, None), ("x", A, None), ("b", A, None), ("c", A, None), ("x", "{", None)],
        "orphan later": [("a", U, None), ("x", A, None), ("b", A, None), ("c", A, None), ("x", A, "nowhere")], "unreadable first": [("a", U, None), ("x", "{", None), ("b", A, None), ("c", A, None), ("x", A, None)],
    }
    lines, events = [], []
    for s, ms in talks.items():
        for q, (u, m, parent) in enumerate(ms):
            events.append((len(events), s, q))
            lines.append((len(events), events[-1][0], 0, None, m if isinstance(m, str) else json.dumps(m), u, parent, None))
    spark.createDataFrame(lines, "line_id long, event_id long, line_in_event int, type string, message string, uuid string, parent_uuid string, timestamp string").write.parquet(f"{tmp_path}/t")
    got = defaultdict(list)
    for r in c.validated_turns(c.replay(spark, f"{tmp_path}/t", spark.createDataFrame(events, "id long, session_id string, sequence_number int"))).orderBy("turn_no").collect():
        got[r.session_id].append(r.uuid)
    assert got == {"no turn first": ["a", "b", "c"], "unreadable later": ["a", "x", "b", "c"], "orphan later": ["a", "x", "b", "c"]}
