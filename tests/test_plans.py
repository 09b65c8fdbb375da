"""Properties of physical plans: what every query's plan must not have, and what reaches the scan."""

import pytest

from opstrata.plans import catalogue

STREAMS = {n for n in catalogue.queries() if n.startswith("ss0") and n != "ss09_session_gaps"}
PYTHON = {"p2_found", "p2_objects", "p2_values", "p3_found", "p3_kept", "p6_found", "p6_instants", "ca18_code_records", "agg12_code_ratios"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - STREAMS))
def test_no_pairs_and_no_rowwise_python(spark, sf, name):
    text = plan(catalogue.queries()[name](spark, sf))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text, operator
    assert ("MapInArrow" in text or "ArrowEvalPython" in text) == (name in PYTHON)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalogue.queries()["pf05_predicates"](spark, sf))
    assert "In(event_type, [Stop,SubagentStop])" in text and "IsNotNull(git_state)" in text
    assert text.count("FileScan") == 1 and "metadata" not in text and "error_message" not in text
    text = plan(catalogue.queries()["agg02_events_by_type"](spark, sf))
    assert "ReadSchema: struct<id:bigint,session_id:string,event_type:string>" in text
    text = plan(catalogue.queries()["p5_long"](spark, sf))
    assert "metadata" not in text and "git_state" not in text
