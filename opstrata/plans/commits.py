"""Queries on commit series; orders stand for commits (a customer is a repository), their lines for the files' metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrata.functions import scoring
from opstrata.operators import history as H
from opstrata.operators.running import previous
from opstrata.plans.registry import registry
from opstrata.sources.tables import table

QUERIES, ORACLES, query = registry()


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("complexity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("effort"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("mi")
    )
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("place"), F.col("o_orderdate").alias("time"))
    return orders.join(lines, F.col("place") == F.col("l_orderkey")).drop("l_orderkey")


_C = """c as (select o_custkey as repo, o_orderkey as place, o_orderdate as time, complexity, effort, mi from orders join (select l_orderkey, sum(cast(l_quantity as bigint))::bigint as complexity, sum(cast(l_extendedprice as decimal(18,2))) as effort,
 sum(cast(round(l_discount * 100) as bigint))::bigint as mi from lineitem group by 1) on o_orderkey = l_orderkey)"""
_D = """d as (select * from (select repo, place, lag(place) over w as base, complexity - lag(complexity) over w as complexity_delta, effort - lag(effort) over w as effort_delta, mi - lag(mi) over w as mi_delta from c window w as (partition by repo order by place)) where base is not null)"""
_STATS = "select repo, avg(x) + 0.0 as mean, round(coalesce(stddev_samp(x), 0), 9) as sd, median(x) as median, min(x) as least, max(x) as most, count(x) as n, round(case when count(x) < 2 then 0 else coalesce(regr_slope(x, n), 0) end, 9) + 0.0 as trend"


@query(f"with {_C}, {_D} select repo, place, base, complexity_delta, effort_delta::double as effort_delta, mi_delta from d")
def wn11_commit_deltas(spark, sf):
    return H.deltas(_commits(spark, sf)).withColumn("effort_delta", F.col("effort_delta").cast("double"))


@query(f"with {_C}, {_D}, n as (select *, complexity_delta::double as x, row_number() over (partition by repo order by place) as n from d) {_STATS} from n group by 1")
def agg13_baseline(spark, sf):
    """AGG-13/14, CP-08: the spread and trend of complexity changes, by position in the series."""
    return H.summary(H.numbered(H.deltas(_commits(spark, sf)), "repo", "place"), "repo", "complexity_delta")


_Z = "round(case when {m}_sd < 1e-10 then case when abs({m}_x - {m}_mean) < 1e-10 then 0 else sign({m}_x - {m}_mean) end else ({m}_x - {m}_mean) / {m}_sd end, 6) + 0.0 as z_{m}"
_B = ", ".join(f"avg({m}_delta::double) as {m}_mean, coalesce(stddev_samp({m}_delta::double), 0) as {m}_sd, arg_max({m}_delta, place)::double as {m}_x" for m in H.METRICS)


@query(f"""with {_C}, {_D}, b as (select repo, max(place) as place, {_B} from d group by 1), z as (select repo, place, {", ".join(_Z.format(m=m) for m in H.METRICS)} from b), s as (select *, (25 * -cast(round(z_complexity * 1000000) as bigint) + 25 * -cast(round(z_effort * 1000000) as bigint) + 50 * cast(round(z_mi * 1000000) as bigint)) / 100000000 as score from z)
 select *, case when score > 1 then 'significant_improvement' when score > 0.5 then 'minor_improvement' when score >= -0.5 then 'neutral' when score >= -1 then 'minor_degradation' else 'significant_degradation' end as category from s""")
def cp09_impact(spark, sf):
    return H.impacts(H.deltas(_commits(spark, sf)))


@query(f"with {_C} select repo, place, complexity, complexity - coalesce(lag(complexity) over (partition by repo order by place), 0) as increment, complexity as cumulative from c")
def cp14_commit_chain(spark, sf):
    return H.chain(_commits(spark, sf))


_REC = """with recursive o as (select o_custkey as repo, o_orderkey as place, epoch_us(o_orderdate) as t, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn, count(*) over (partition by o_custkey) as n from orders),
 k as (select repo, rn, n, t as last, true as keep from o where rn = 1 union all select o.repo, o.rn, o.n, case when k.last - o.t >= 604800000000 then o.t else k.last end, k.last - o.t >= 604800000000 from k join o on o.repo = k.repo and o.rn = k.rn + 1),
 f as (select repo, rn, n from k where keep or rn = n), c as (select repo, count(*) as kept, max(n) as n from f group by 1),
 g as (select o.repo, o.rn, o.place from o join c using (repo) where case when c.kept < 10 and c.n >= 10 then (o.rn - 1) % (c.n // 10) = 0 or o.rn = o.n else exists (select 1 from f where f.repo = o.repo and f.rn = o.rn) end)
 select repo, row_number() over (partition by repo order by rn) - 1 as position, place from g qualify position < 100"""


@query(_REC, position="int")
def wn13_time_sampling(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("place"), F.col("o_orderdate").alias("time"))
    return H.sampled(orders, "repo", "place", "time")


@query("""with o as (select * from orders order by o_orderkey desc limit 200) select count(*) as n, count(*) filter (where o_orderstatus = 'F')::bigint as merges, case when count(*) filter (where o_orderstatus = 'F') / count(*) > 0.15 then 'merge_anchored' else 'time_sampled' end as strategy from o""")
def agg23_strategy(spark, sf):
    """AGG-23 on the newest 200 commits of each repository; a finished order stands for a merge. The SQL takes the newest 200 over all repositories."""
    return H.strategy(table(spark, sf, "orders"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1), "o_custkey", "o_orderkey")


@query("""with o as (select o_custkey as repo, o_orderkey as place, row_number() over (partition by o_custkey order by o_orderkey desc) as rn, count(*) over (partition by o_custkey) as n from orders) select repo, place from o where (rn - 1) % greatest(n // 10, 1) = 0""")
def so10_every_kth(spark, sf):
    """SO-10: a sampling operator: every k-th commit of a repository, k a tenth of its commits."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("place"))
    n = o.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    d = H.numbered(o, "repo", "place").join(n, "repo")
    return d.filter((F.col("total") - F.col("n")) % F.greatest(F.floor(F.col("total") / 10), F.lit(1)) == 0).select("repo", "place")


@query(f"""with {_C}, g as (select repo, sum(mi)::bigint as tokens, epoch_us(max(time)) - epoch_us(min(time)) as us from c group by 1) select repo, tokens, case when us > 0 then abs(tokens) / (us / 86400000000) / (1000000 / 30) else 0 end as rate from g""")
def sf18_galen_rate(spark, sf):
    us = F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))
    g = _commits(spark, sf).groupBy("repo").agg(F.sum("mi").alias("tokens"), us.alias("us"))
    return g.select("repo", "tokens", scoring.galen_rate(F.col("tokens"), F.col("us") / 86_400_000_000).alias("rate"))


@query(f"with {_C}, {_D} select repo, count(*) as n, sum(complexity_delta)::bigint as complexity, sum(effort_delta)::double as effort, sum(mi_delta)::bigint as mi, sum(complexity_delta) / count(*) as complexity_per_commit from d group by 1")
def agg21_chain_totals(spark, sf):
    d = H.deltas(_commits(spark, sf))
    return d.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("complexity_delta").alias("complexity"), F.sum("effort_delta").cast("double").alias("effort"), F.sum("mi_delta").alias("mi"), (F.sum("complexity_delta") / F.count(F.lit(1))).alias("complexity_per_commit"))


@query("""with recursive o as (select o_orderkey as k, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as p from orders where o_orderpriority = '1-URGENT'), r as (select k, k as root, 0 as depth from o where p is null union all select o.k, r.root, r.depth + 1 from o join r on o.p = r.k)
 select root, max(depth) as depth, count(*) as n from r group by 1""")
def jn23_ancestry(spark, sf):
    """SRC-14, JN-23: commits reached from their first ancestor, over all commits. The SQL takes urgent ones only."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("k"))
    return H.ancestry(o, "repo", "k").groupBy("root").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"))
