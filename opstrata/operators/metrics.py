"""Code metrics of repository snapshots: file rows, totals, smells, quality score, differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opstrata.functions.events import readable

# Smells with category and weight.
SMELLS = [
    ("orphan_comment", "general", 0.01), ("untracked_todo", "general", 0.02), ("swallowed_exception", "general", 0.15), ("test_skip", "general", 0.10), ("type_ignore", "general", 0.08),
    ("dynamic_execution", "general", 0.12), ("inline_import", "python", 0.01), ("dict_get_with_default", "python", 0.05), ("hasattr_getattr", "python", 0.10), ("nonempty_init", "python", 0.03),
    ("single_method_class", "python", 0.05), ("deep_inheritance", "python", 0.08), ("passthrough_wrapper", "python", 0.02), ("sys_path_manipulation", "python", 0.10),
]
BLOCKING = ("test_skip", "swallowed_exception")
# Parameters of the quality score.
MOST_PENALTY, STEEPNESS = 0.9, 2.0
BONUSES = (("test_coverage_percent", 80, 0.05), ("type_hint_coverage", 90, 0.05), ("docstring_coverage", 80, 0.02))
_FILE = "struct<path:string,complexity:bigint,mi:decimal(18,4),volume:decimal(18,4),effort:decimal(18,4),tokens:string>"


def registry(spark: SparkSession) -> DataFrame:
    """The smells as a table of constant size."""
    return spark.createDataFrame(SMELLS, "smell string, category string, weight double")


def document(text: Column) -> Column:
    """The JSON document of a field, also where it is wrapped in a JSON string; null if unreadable."""
    v = readable(text)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(v.isNotNull(), text)


def snapshots(cache: DataFrame) -> DataFrame:
    """(id, repository_path, doc): the snapshots with a readable document."""
    return cache.select("id", "repository_path", document(F.col("complexity_metrics_json")).alias("doc")).filter(readable(F.col("doc")).isNotNull())


def file_rows(snaps: DataFrame) -> DataFrame:
    """A row per snapshot and file; ``tokens`` is null where counting failed, ``token_error`` then tells."""
    f = snaps.select("id", "repository_path", F.explode(F.from_json("doc", f"files array<{_FILE}>")["files"]).alias("f"))
    tokens = F.try_to_number("f.tokens", F.lit("999999999999999999")).cast("bigint")
    return f.select("id", "repository_path", "f.path", "f.complexity", "f.mi", "f.volume", "f.effort", tokens.alias("tokens"), F.when(tokens.isNull() & F.col("f.tokens").isNotNull(), F.get_json_object("f.tokens", "$.error")).alias("token_error"))


def totals(files: DataFrame, *keys: str) -> DataFrame:
    """AGG-09: sums, means and extremes per snapshot. Decimal sums, so the order of rows can't change them; averages are per file."""
    mean = lambda c: F.coalesce(F.sum(c).cast("double") / F.count(F.lit(1)), F.lit(0.0))
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("complexity").alias("total_complexity"), mean("complexity").alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.min("complexity").alias("min_complexity"),
        F.coalesce(F.sum("volume"), F.lit(0)).cast("double").alias("total_volume"), F.coalesce(F.sum("effort"), F.lit(0)).cast("double").alias("total_effort"), mean("effort").alias("avg_effort"), mean("mi").alias("avg_mi"),
        F.sum("mi").cast("double").alias("total_mi"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.count("token_error").alias("n_token_errors"),
    )


def smell_rows(snaps: DataFrame) -> DataFrame:
    """SF-33: the smells of a snapshot as rows (id, smell, n, files), those it has a count of."""
    fields = ", ".join(f"{s}_count bigint, {s}_files array<string>" for s, _, _ in SMELLS)
    m = snaps.select("id", "repository_path", F.from_json("doc", fields).alias("m"))
    rows = F.array(*[F.struct(F.lit(s).alias("smell"), F.col(f"m.{s}_count").alias("n"), F.col(f"m.{s}_files").alias("files")) for s, _, _ in SMELLS])
    return m.select("id", "repository_path", F.explode(rows).alias("r")).select("id", "repository_path", "r.*").filter("n is not null")


def weighted(smells: DataFrame, registry: DataFrame) -> DataFrame:
    """AGG-26 per snapshot: the weighted sum of its smells, in ten-thousandths added as integers."""
    w = smells.join(F.broadcast(registry), "smell")
    return w.groupBy("id").agg((F.sum(F.col("n") * F.round(F.col("weight") * 10000).cast("bigint")) / 10000).alias("weighted_smells"), F.sum("n").alias("n_smells"))


def penalty(weighted_smells: Column, files: Column) -> Column:
    """SF-14: a penalty that saturates below MOST_PENALTY, by weighted smells per file."""
    return MOST_PENALTY * (1 - F.exp(-(weighted_smells / F.greatest(files, F.lit(1))) * STEEPNESS))


def quality(snaps: DataFrame, registry: DataFrame) -> DataFrame:
    """CP-11: (id, mi_normalized, smell_penalty, bonus, qpe). Unknown coverage counts as none."""
    cover = snaps.select("id", F.from_json("doc", ", ".join(f"{c} double" for c, _, _ in BONUSES)).alias("c"))
    bonus = sum((F.when(F.col(f"c.{c}") >= least, F.lit(b)).otherwise(F.lit(0.0)) for c, least, b in BONUSES), F.lit(0.0))
    t = totals(file_rows(snaps), "id").select("id", "n_files", (F.col("avg_mi") / 100).alias("mi_normalized"))
    w = weighted(smell_rows(snaps), registry).select("id", "weighted_smells")
    d = cover.select("id", bonus.alias("bonus")).join(t, "id").join(w, "id", "left").withColumn("smell_penalty", penalty(F.coalesce("weighted_smells", F.lit(0.0)), F.col("n_files")))
    return d.select("id", "mi_normalized", "smell_penalty", "bonus", (F.col("mi_normalized") * (1 - F.col("smell_penalty")) + F.col("bonus")).alias("qpe"))


def pairs(snaps: DataFrame) -> DataFrame:
    """(id, base_id): each snapshot with the one before it of the same repository."""
    return snaps.select("id", F.lag("id").over(W.partitionBy("repository_path").orderBy("id")).alias("base_id")).filter("base_id is not null")


def file_changes(files: DataFrame, pair: DataFrame) -> DataFrame:
    """JN-01: per pair and path what became of the file: added, removed, changed or same, with the changes of its metrics (0 for what isn't on both sides)."""
    side = ["path", "complexity", "effort", "mi", "volume", "tokens"]
    new = files.join(pair, "id").select("id", *[F.col(c).alias(f"new_{c}") if c != "path" else F.col(c) for c in side], F.lit(True).alias("in_new"))
    old = files.withColumnRenamed("id", "base_id").join(pair, "base_id").select("id", *[F.col(c).alias(f"old_{c}") if c != "path" else F.col(c) for c in side], F.lit(True).alias("in_old"))
    d = new.join(old, ["id", "path"], "full_outer")
    delta = lambda c: F.coalesce(F.col(f"new_{c}"), F.lit(0)) - F.coalesce(F.col(f"old_{c}"), F.lit(0))
    what = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(delta("complexity") != 0, "changed").otherwise("same")
    return d.select("id", "path", what.alias("what"), delta("complexity").alias("complexity_change"), *[delta(c).cast("decimal(18,4)").alias(f"{c}_change") for c in ("effort", "mi", "volume")], delta("tokens").alias("tokens_change"))


def delta(changes: DataFrame) -> DataFrame:
    """CP-07: the differences of two snapshots in one row."""
    kind = lambda k: F.count_if(F.col("what") == k).alias(f"n_{k}")
    return changes.groupBy("id").agg(kind("added"), kind("removed"), kind("changed"), F.sum("complexity_change").alias("complexity_change"), F.sum("tokens_change").alias("tokens_change"), *[F.sum(f"{c}_change").cast("double").alias(f"{c}_change") for c in ("effort", "mi", "volume")])


def smell_advantage(smells: DataFrame, pair: DataFrame, registry: DataFrame) -> DataFrame:
    """SF-30, JN-16: all smells of a pair with the weighted change of their counts, a smell that isn't counted being 0."""
    base = smells.select(F.col("id").alias("base_id"), "smell", F.col("n").alias("base_n"))
    names = F.array(*[F.lit(s) for s, _, _ in SMELLS])
    full = pair.select("*", F.explode(names).alias("smell")).join(F.broadcast(registry), "smell")
    d = full.join(smells.select("id", "smell", F.col("n").alias("new_n")), ["id", "smell"], "left").join(base, ["base_id", "smell"], "left")
    change = F.coalesce("new_n", F.lit(0)) - F.coalesce("base_n", F.lit(0))
    return d.select("id", "smell", change.alias("change"), (change * F.col("weight")).alias("weighted_change"))


def scoped_smells(smells: DataFrame, edited: DataFrame, blocking: tuple[str, ...] = BLOCKING) -> DataFrame:
    """CP-16, JN-14: per snapshot and blocking smell how many of its files are related to the edits, (id, path) of ``edited``, and how many aren't."""
    f = smells.filter(F.col("smell").isin(*blocking)).select("id", "smell", F.explode(F.array_distinct("files")).alias("path"))
    e = edited.select("id", "path").distinct().withColumn("hit", F.lit(1))
    return f.join(e, ["id", "path"], "left").groupBy("id", "smell").agg(F.count("hit").alias("n_related"), F.count_if(F.col("hit").isNull()).alias("n_unrelated"))


def with_coverage(cache: DataFrame, session_id: str, percent: float) -> DataFrame:
    """SNK-09: the cache rows with the coverage of one session's documents set, for the rewrite; other rows and unreadable documents stay as they are."""
    doc = document(F.col("complexity_metrics_json"))
    old = F.regexp_replace(doc, r'"test_coverage_percent":\s*(null|-?[0-9.eE+]+)', f'"test_coverage_percent":{percent}')
    added = F.when(old.contains('"test_coverage_percent"'), old).otherwise(F.regexp_replace(doc, r"\}\s*$", f',"test_coverage_percent":{percent}}}'))
    return cache.withColumn("complexity_metrics_json", F.when((F.col("session_id") == session_id) & doc.isNotNull(), added).otherwise(F.col("complexity_metrics_json")))
