import numpy as np
import pytest
from pyspark.sql import functions as F

from opstrata.llm import readability as r
from opstrata.sources.tables import table


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("table", 2), ("make", 1), ("makes", 1), ("boxes", 2), ("walked", 1), ("wanted", 2), ("reading", 2), ("nation", 2), ("area", 3), ("idea", 3), ("beautiful", 3), ("well-known", 2), ("the", 1), ("rhythm", 1), ("creating", 3), ("responsibility", 6), ("x", 1), ("日本", 1)])
def test_syllables(word, n):
    assert r.syllables(word) == n


def test_grades_rise_with_difficulty():
    easy = "The cat sat on the mat. It was a fat cat. We like the cat. " * 6
    hard = "Notwithstanding the extraordinary institutionalization of administrative responsibilities, the organization is reconsidering its characterization of interdependent infrastructure within the international community. " * 6
    assert r.grade(easy) < 3 < 20 < r.grade(hard)
    assert r.grade(easy.replace(" ", "  ").replace(". ", ".\r\n")) == r.grade(easy)
    assert r.grade("Der Hund ist nicht in dem Haus und die Katze ist auf dem Dach. " * 5) is None
    assert r.grade(None) is r.grade("") is r.grade(" \n") is r.grade("1 2 3 !!") is r.grade("猫は小さい。") is None


def test_thresholds_have_least_error():
    rng = np.random.default_rng(0)
    level = rng.integers(1, 6, 400)
    z = level * 5 + rng.normal(0, 2, 400)
    at = r.fit_thresholds(list(zip(z.tolist(), level.tolist(), strict=True)))
    loss = lambda t: np.abs(1 + (z[:, None] > np.array(t)).sum(1) - level).sum()
    assert at == sorted(at) and all(loss(at) <= loss([a + d for a in at]) for d in (-1, -0.3, 0.3, 1))
    assert r.fit_thresholds([]) == [3.5, 8.5, 13.5, 18.5]


def test_held_out_labels(spark):
    """Thresholds from two thirds of the labels give the level of the others, where three raters or more judged, in nine of ten cases."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "reading_labels")
    even = labels.filter("doc_id % 3 <> 0")
    judged = labels.filter("doc_id % 3 = 0 and reading_level is not null").distinct().groupBy("doc_id").agg(F.median("reading_level").alias("level"), F.count("rater").alias("n")).filter("n >= 3").collect()
    got = {x.doc_id: x.reading_level for x in r.reading_levels(docs, even).collect()}
    hits = [abs(got[x.doc_id] - x.level) for x in judged if x.doc_id in got]
    assert len(hits) > 60 and np.mean(np.array(hits) == 0) >= 0.9 and max(hits) <= 1


def test_fit_takes_a_bounded_sample(spark):
    text = "The cat sat on the mat and it was a fat cat that we like. " * 5
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("plan").alias("kind"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(2).alias("reading_level"), F.lit("a").alias("rater"))
    assert len(r.labelled(docs, labels, 100)) in range(60, 101) and len(r.labelled(docs, labels, 5000)) == 500
    assert r.labelled(docs, labels, 100) == r.labelled(docs.repartition(3), labels.repartition(5), 100)


def test_edge_cases(spark):
    text = "The cat sat on the mat and it was a fat cat that we like. " * 5
    rows = [(1, text, "plan", "de"), (1, text, "plan", "de"), (2, None, "plan", "en"), (3, "", "chat", "en"), (4, text, "log", "en"), (5, text, None, "en"), (6, text[:200], "chat", "en"), (7, text + "x" * 200000, "chat", None), (None, text, "chat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, lang string").selectExpr("*", "1 as reading_level", "2 as grade")
    labels = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (1, None, "b"), (9, 3, "a"), (None, 3, "c")], "doc_id long, reading_level int, rater string")
    got = sorted((x.doc_id or 0) for x in r.reading_levels(docs, labels).collect())
    assert got == [0, 1, 1, 7]
    assert r.reading_levels(docs, labels.limit(0)).count() == 4 and r.reading_levels(docs.limit(0), labels).count() == 0
