"""Series of commits: differences to the commit before, baselines, trends, sampling in time, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstrata.functions import scoring
from opstrata.operators.running import previous, running_sum

#: Commits of one repository that share a task.
CHUNK = 1_000_000
METRICS = ("complexity", "effort", "mi")
# Days between sampled commits, least number of samples, most samples.
INTERVAL_DAYS, LEAST_SAMPLES, MOST_SAMPLES = 7, 10, 100
MERGE_RATIO = 0.15


def deltas(commits: DataFrame, repo: str = "repo", place: str = "place", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """WN-11, JN-20: each commit after the first with the one before it (base) and the change of each metric."""
    d = commits.withColumn("_m", F.struct(F.col(place).alias("base"), *metrics))
    d = previous(d, repo, place, "_m", "_p", CHUNK).filter("_p is not null")
    return d.select(repo, place, F.col("_p.base").alias("base"), *[(F.col(m) - F.col(f"_p.{m}")).alias(f"{m}_delta") for m in metrics])


def summary(d: DataFrame, repo: str, value: str, place: str = "n") -> DataFrame:
    """AGG-13/14: mean, sample deviation (0 for one), median, extremes, count and slope over ``place`` (0 without spread); deviation and slope are rounded to 9 places."""
    r = lambda c: F.round(c, 9) + 0.0  # no negative zero
    x = F.col(value).cast("double")
    slope = F.when(F.count(value) < 2, 0.0).otherwise(F.coalesce(F.regr_slope(x, F.col(place).cast("double")), F.lit(0.0)))
    return d.groupBy(repo).agg(
        (F.avg(x) + 0.0).alias("mean"), r(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("sd"), F.median(x).alias("median"), F.min(x).alias("least"), F.max(x).alias("most"), F.count(value).alias("n"), r(slope).alias("trend")
    )


def numbered(d: DataFrame, repo: str, place: str) -> DataFrame:
    """Rows with ``n``, their number in the repository from 1, oldest first."""
    return running_sum(d, repo, place, F.lit(1), "n", CHUNK)


def sampled(commits: DataFrame, repo: str, id: str, time: str, interval_days: int = INTERVAL_DAYS, least: int = LEAST_SAMPLES, most: int = MOST_SAMPLES) -> DataFrame:  # noqa: A002
    """WN-13: (repo, position, id), newest first. Kept are the newest, each that is at least ``interval_days`` older than the last kept, and the oldest.

    If fewer than ``least`` are kept though there are as many, every k-th of n // least instead, with the oldest. At most ``most``. The fold runs over an
    ordered array of (time, id) per repository, 16 bytes a commit.
    """
    a = F.reverse(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(id).alias("id")))))
    g = commits.groupBy(repo).agg(a.alias("a"))
    step = F.lit(interval_days * 86_400_000_000)
    start = F.struct(F.col("a")[0].t.alias("last"), F.array(F.col("a")[0].id).alias("kept"))
    fold = F.aggregate(F.slice("a", F.lit(2), F.size("a")), start, lambda acc, x: F.when(acc.last - x.t >= step, F.struct(x.t.alias("last"), F.array_append(acc.kept, x.id).alias("kept"))).otherwise(acc), lambda acc: acc.kept)
    n = F.size("a")
    oldest = F.element_at("a", -1).id
    with_oldest = lambda k: F.when(F.element_at(k, -1) == oldest, k).otherwise(F.array_append(k, oldest))
    every = F.floor(n / least)
    kth = F.transform(F.filter("a", lambda x, i: i % every == 0), lambda x: x.id)
    g = g.select(repo, "a", with_oldest(fold).alias("kept"))
    chosen = F.when((F.size("kept") < least) & (n >= least), with_oldest(kth)).otherwise(F.col("kept"))
    return g.select(repo, F.posexplode(F.slice(chosen, 1, most)).alias("position", id))


def ancestry(commits: DataFrame, repo: str, place: str) -> DataFrame:
    """JN-23: (repo, place, root, depth), each commit with its first ancestor and the edges between them, at any number of commits.

    The parent of a commit is the one before it in its repository. Such a chain is linear, so a running count along it is the depth; nothing recurs.
    """
    root = commits.groupBy(F.col(repo).alias("_r")).agg(F.min(place).alias("root"))
    d = numbered(commits, repo, place).join(root, F.col(repo).eqNullSafe(F.col("_r")))
    return d.select(repo, place, "root", (F.col("n") - 1).cast("int").alias("depth"))


def strategy(commits: DataFrame, parents: Column, repo: str, place: str, sample: int = 200) -> DataFrame:
    """AGG-23 per repository: the share of merges among its newest ``sample`` commits, and the strategy that follows (strictly above the ratio: by merges)."""
    c = commits.select(F.col(repo).alias("repo"), place, (parents >= 2).cast("int").alias("m"))
    total = c.groupBy(F.col("repo").alias("_r")).agg(F.count(F.lit(1)).alias("total"))
    newest = numbered(c, "repo", place).withColumnRenamed("n", "_n").join(total, F.col("repo").eqNullSafe(F.col("_r"))).filter(F.col("total") - F.col("_n") < sample)
    d = newest.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("merges"))
    return d.withColumn("strategy", F.when(F.col("merges") / F.col("n") > MERGE_RATIO, "merge_anchored").otherwise("time_sampled"))


def impacts(d: DataFrame, repo: str = "repo", place: str = "place") -> DataFrame:
    """CP-09: the newest change of each repository against the spread of all its changes: z-scores, score and category."""
    spread = [f(F.col(f"{m}_delta").cast("double")).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("sd", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))]
    newest = F.max_by(F.struct(*[f"{m}_delta" for m in METRICS]), place).alias("x")
    b = d.groupBy(repo).agg(*spread, newest, F.max(place).alias(place))
    z = {m: scoring.z_score(F.col(f"x.{m}_delta").cast("double"), F.col(f"{m}_mean"), F.col(f"{m}_sd")) for m in METRICS}
    b = b.select(repo, place, *[(F.round(v, 6) + 0.0).alias(f"z_{m}") for m, v in z.items()])
    whole = [F.round(F.col(f"z_{m}") * 1_000_000).cast("bigint") for m in METRICS]  # added as integers, so the sum is exact
    b = b.withColumn("score", scoring.impact_percent(*whole) / 100_000_000)
    return b.withColumn("category", scoring.impact_category(F.col("score")))


def chain(commits: DataFrame, repo: str = "repo", place: str = "place") -> DataFrame:
    """WN-12, CP-14: cumulative value and increment of each commit of a chain."""
    d = previous(commits, repo, place, "complexity", "_p", CHUNK).withColumn("increment", F.col("complexity") - F.coalesce("_p", F.lit(0))).drop("_p")
    return running_sum(d, repo, place, F.col("increment"), "cumulative", CHUNK).select(repo, place, "complexity", "increment", "cumulative")
