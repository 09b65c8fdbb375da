"""Scores, baselines and code features on small cases with known results."""

import ast
import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from opstrata.functions import python_code as P
from opstrata.functions import scoring as S
from opstrata.operators import code, history, metrics


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


L = lambda x: F.lit(x).cast("double")


def test_z_scores(spark):
    assert [one(spark, S.z_score(L(x), L(5), L(0))) for x in (5, 7, 3)] == [0, 1, -1] and one(spark, S.z_score(L(7), L(5), L(4))) == 0.5
    names = ["significant_improvement", "minor_improvement", "neutral", "neutral", "neutral", "minor_degradation", "minor_degradation", "significant_degradation"]
    assert [one(spark, S.impact_category(L(x))) for x in (1.5, 0.75, 0.5, -0.4, -0.5, -0.75, -1.0, -1.5)] == names
    assert one(spark, S.impact(L(1), L(2), L(3))) == 0.75
    assert one(spark, S.z_label(L(2), True)) == "much worse" and one(spark, S.z_label(L(2), False)) == "much better"


def test_advantage_and_rates(spark):
    assert one(spark, S.advantage(L(0.5), L(0.5))) == 0 and one(spark, S.advantage(L(0.5), L(0.4))) < 0 < one(spark, S.advantage(L(0), L(0.4))) <= 1
    assert [one(spark, S.winner(L(a), L(b))) for a, b in ((0.5, 0.505), (0.5, 0.6), (0.6, 0.5))] == ["tie", "B", "A"]
    assert [round(one(spark, S.galen_rate(L(t), L(d))), 6) for t, d in ((1e6, 30), (5e5, 30), (2e6, 30), (1, 0), (-5e5, 30))] == [1, 0.5, 2, 0, 0.5]
    assert [one(spark, S.completion(L(c), L(10))) for c in (10, 5, 20)] == [1, 0.5, -1] and one(spark, S.completion(L(20), L(10), True)) == 1
    assert [one(spark, S.safe(x)) for x in (L(float("nan")), L(float("inf")), F.lit(None).cast("double"), L(2))] == [0, 0, 0, 2]


def test_display(spark):
    assert [one(spark, S.human_count(F.lit(n))) for n in (999, 150_000, 1_500_000)] == ["999", "~150K", "~1.5M"]
    assert one(spark, S.truncate_path(F.lit("a/very/long/path/to/file.py"), 20)) == "a/very/lo.../file.py" and one(spark, S.truncate_path(F.lit("a.py"), 20)) == "a.py"
    assert one(spark, S.slug(F.lit("My_Repo Name!"))) == "my-repo-name"
    assert one(spark, S.trend_arrow(L(0.5), True)) == "up bad" and one(spark, S.trend_arrow(L(0.001), True)) == "flat"
    assert [one(spark, S.ladder(L(x), 80, 60)) for x in (90, 70, 10)] == ["green", "yellow", "red"]


def test_history(spark):
    d = spark.createDataFrame([("r", n, float(v)) for n, v in enumerate((1, 2, 3, 4, 5))] + [("one", 0, 5.0), ("flat", 0, 2.0), ("flat", 1, 2.0)], "repo string, n int, v double")
    s = {r.repo: r for r in history.summary(d, "repo", "v").collect()}
    assert (s["r"]["mean"], s["r"]["median"], round(s["r"]["sd"], 4), s["r"]["trend"]) == (3, 3, 1.5811, 1) and (s["one"]["sd"], s["one"]["trend"], s["flat"]["trend"]) == (0, 0, 0)
    day = lambda k: datetime.datetime(2025, 1, 1) + datetime.timedelta(days=k)
    c = spark.createDataFrame([("a", k, day(k)) for k in range(100)] + [("b", k, day(k)) for k in range(5)] + [("c", k, day(k)) for k in range(20)], "repo string, id int, t timestamp")
    got = {}
    for r in history.sampled(c, "repo", "id", "t").orderBy("repo", "position").collect():
        got.setdefault(r.repo, []).append(r.id)
    assert got["a"] == [*range(99, 0, -7), 0] and got["b"] == [4, 0] and got["c"] == [*range(19, 0, -2), 0]


def test_quality_and_delta(spark):
    doc = lambda mi, **k: json.dumps({"files": [{"path": "a.py", "complexity": 8, "mi": mi, "effort": 10, "tokens": 5}, {"path": "b.py", "complexity": 2, "mi": mi, "tokens": {"error": "none"}}], **k})
    more = json.dumps({"files": [{"path": "b.py", "complexity": 5, "mi": 75}, {"path": "c.py", "complexity": 1, "mi": 75}], "swallowed_exception_count": 2, "swallowed_exception_files": ["b.py", "z.py"]})
    cache = spark.createDataFrame([(1, "r", doc(75)), (2, "r", json.dumps(more)), (3, "r", "{cut"), (4, "q", doc(75, test_skip_count=400, test_coverage_percent=80)), (5, "q", None)], "id long, repository_path string, complexity_metrics_json string")
    s = metrics.snapshots(cache)
    files, smells, reg = metrics.file_rows(s), metrics.smell_rows(s), metrics.registry(spark)
    t = {r.id: r for r in metrics.totals(files, "id").collect()}
    assert (t[1].total_complexity, t[1].avg_complexity, t[1].max_complexity, t[1].min_complexity, t[1].total_tokens, t[1].n_token_errors) == (10, 5, 8, 2, 5, 1)
    q = {r.id: r for r in metrics.quality(s, reg).collect()}
    assert q[1].qpe == 0.75 and q[1].smell_penalty == 0 and 0.5 < q[4].smell_penalty <= 0.9 and q[4].bonus == 0.05
    assert math.isclose(q[2].smell_penalty, 0.9 * (1 - math.exp(-0.3 / 2 * 2)))
    p = metrics.pairs(s)
    ch = metrics.file_changes(files, p)
    assert {r.path: r.what for r in ch.collect()} == {"a.py": "removed", "b.py": "changed", "c.py": "added"}
    d = metrics.delta(ch).first()
    assert (d.n_added, d.n_removed, d.n_changed, d.complexity_change) == (1, 1, 1, -4)
    adv = {r.smell: r for r in metrics.smell_advantage(smells, p, reg).collect()}
    assert len(adv) == 14 and adv["swallowed_exception"].change == 2 and math.isclose(adv["swallowed_exception"].weighted_change, 0.3)
    scoped = metrics.scoped_smells(smells, ch.filter("what <> 'removed'")).collect()
    assert [(r.id, r.smell, r.n_related, r.n_unrelated) for r in scoped] == [(2, "swallowed_exception", 1, 1)]


def test_coverage_is_set_for_one_session(spark):
    cache = spark.createDataFrame([("s", '{"a":1,"test_coverage_percent":null}'), ("s", '{"a":1}'), ("s", "{cut"), ("t", '{"a":1}')], "session_id string, complexity_metrics_json string")
    out = [r.complexity_metrics_json for r in metrics.with_coverage(cache, "s", 81.5).collect()]
    assert [json.loads(x).get("test_coverage_percent") if x != "{cut" else "cut" for x in out] == [81.5, 81.5, "cut", None]


def smells(text, path="src/x.py"):
    return {k: v for k, v in P.record(path, text).items() if v}


@pytest.mark.parametrize(
    ("text", "smell", "n"),
    [
        ("def f():\n    import os\n", "inline_import", 1), ("import os\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import b\n", "inline_import", 0), ("d.get('a', 1)\nd.get('a')\nd.get('a', default=2)\n", "dict_get_with_default", 2),
        ("hasattr(a, 'b') or getattr(a, 'c')\n", "hasattr_getattr", 2), ("import pytest\n@pytest.mark.skip\ndef test_a():\n    pytest.skip('x')\n", "test_skip", 2), ("try:\n    f()\nexcept E:\n    pass\nexcept F:\n    x = 1\nexcept G:\n    raise\n", "swallowed_exception", 2),
        ("eval('1'); exec('2'); a.eval()\n", "dynamic_execution", 2), ("class A:\n    def __init__(self): ...\n    def m(self): ...\n", "single_method_class", 1), ("class A(B, C, D): ...\n", "deep_inheritance", 1),
        ("def f(a, b):\n    return g(a, b)\n", "passthrough_wrapper", 1), ("def f(a, b):\n    return g(b, a)\n", "passthrough_wrapper", 0), ("@unittest.skipIf(x)\ndef f(): ...\nunittest.skip(1)\n", "test_skip", 1), ("def f(x: 'list[Any]', y: str | None, z: dict[str, Any]): ...\n", "type_refs", 5), ("import sys\nsys.path.append('x')\nsys.path = []\nsys.path += []\n", "sys_path_manipulation", 3),
        ("x = 1  # plain words\n# NOTE: why\n# note without colon\n# see https://x.y\n", "orphan_comment", 2), ("# TODO later\n# TODO AB-12 later\n# fixme #7\n", "untracked_todo", 1), ("x = 1  # type: ignore\ny = '# type: ignore'\n", "type_ignore", 1),
        ("import warnings\n@deprecated\ndef f():\n    warnings.warn('x', DeprecationWarning)\n", "deprecations", 2),
    ],
)
def test_smells(text, smell, n):
    assert smells(text).get(smell, 0) == n


def test_code_records(spark):
    r = P.record("x.py", "def f(x: int, y: str, z: Any) -> bool:\n    '''doc'''\n    # words\n\n    return x\n")
    assert (r["args"], r["annotated_args"], r["annotated_returns"], r["type_refs"], r["any_refs"], r["str_refs"], r["docstrings"], r["loc"], r["code_loc"], r["complexity"]) == (3, 3, 1, 4, 1, 1, 1, 5, 3, 1)
    assert P.type_names(ast.parse("dict[str, list[Any]] | None", mode="eval").body).count("Any") == 1
    assert smells("x = 1", "a/__init__.py").get("nonempty_init") == 1 and not smells("'''d'''\nfrom a import b\n__all__ = ['b']\n", "a/__init__.py").get("nonempty_init")
    assert not smells("# words\n", "test_x.py").get("orphan_comment")
    a, b = (P.record("x.py", "def f(a):\n" + "    if a > 1:\n        a += 1\n" * n + "    return a\n") for n in (1, 9))
    assert a["complexity"] == 2 and b["complexity"] == 10 and a["volume"] < b["volume"] and a["effort"] < b["effort"] and a["mi"] > b["mi"]
    df = spark.createDataFrame([("a.py", "x = 1\n"), ("a.py", "x = 1\n"), ("b.py", "def broken(:"), ("c.py", None), ("d.py", ""), ("e.py", "# " + "x" * 300_000)], "path string, content string").withColumn("loc", F.lit("clash"))
    rows = code.analyse(df).collect()
    assert sorted((x.path, x.parsed) for x in rows) == [("a.py", True), ("a.py", True), ("b.py", False), ("c.py", False), ("d.py", True), ("e.py", True)]
    ratio = code.ratios(code.analyse(df)).first()
    assert ratio.n_files == 4 and ratio.type_hint_coverage == 0 and code.analyse(df.limit(0)).count() == 0


def test_line_counts(spark):
    texts = ["a\nb\n", "", "a", "\n", "# c\r\n x\r\n", "a\n\n  # b\nc"]
    n, c = code.line_counts(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n, c).collect()]
    assert got == [P.line_counts(t) for t in texts]


def test_projection_and_marks(spark):
    assert [one(spark, S.month_projection(L(t), F.lit(d))) for t, d in ((40_000, 10), (10_000, 10), (33_000, 1), (20_000, 29))] == ["on track", "out of reach", "out of reach", "out of reach"]
    assert [one(spark, S.baseline_cell(L(z), True)) for z in (-2, -0.7, 0, 0.7, 2)] == ["far above", "above", "around", "below", "far below"]
    assert [one(spark, S.status_mark(F.lit(x))) for x in ("completed", "in_progress", "pending", "x")] == ["+", ">", ".", "?"]
