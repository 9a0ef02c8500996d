"""Qualification bars, reference pools, baselines and shrinkage towards them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.reliability import pool_mean, pool_rate
from statloom.plans.params import Params


def reliability_weight(opps: Column, k: Column) -> Column:
    n = F.greatest(F.coalesce(opps, F.lit(0)), F.lit(0))
    return n / (n + k)


def shrink_workload(rate: Column, exposure: Column, k: Column, league: Column) -> Column:
    w = F.greatest(F.coalesce(exposure, F.lit(0.0)), F.lit(0.0))
    return F.when(k <= 0, F.coalesce(rate, league)).otherwise(league + F.try_divide(w, w + k) * F.coalesce(rate - league, F.lit(0.0)))


def qualification(season: DataFrame, p: Params) -> DataFrame:
    """(period, mode, qualified_bar, provisional_bar, max_exposure)."""
    top = season.groupBy("period").agg(F.max("exposure").alias("max_exposure"))
    live = F.col("period") == p.live
    bar = lambda i: F.when(live, F.greatest(F.col("max_exposure") * p.live_shares[i], F.lit(p.live_floors[i]))).otherwise(p.final_bars[i])
    return top.select("period", F.when(live, "scaled").otherwise("fixed").alias("mode"), bar(0).alias("qualified_bar"), bar(1).alias("provisional_bar"), "max_exposure")


def sample_status(season: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds status and in_pool; a period where nobody reaches the pool has everybody in it."""
    x = season.join(F.broadcast(bars), "period")  # one row a period
    x = x.withColumn("status", F.when(F.col("exposure") >= F.col("qualified_bar"), "qualified").when(F.col("exposure") >= F.col("provisional_bar"), "provisional").otherwise("limited"))
    reached = F.broadcast(x.groupBy("period").agg(F.max(F.col("status") != "limited").alias("any_pool")))
    x = x.join(reached, "period").withColumn("in_pool", (F.col("status") != "limited") | ~F.col("any_pool"))
    return x.drop("mode", "qualified_bar", "provisional_bar", "max_exposure", "any_pool")


def league_baseline(dense: DataFrame, params: DataFrame, p: Params) -> DataFrame:
    """(period, component, mu, league_workload, pool_size, baseline_source)."""
    pool = dense.filter("in_pool")
    size = pool.groupBy("period").agg(F.countDistinct("entity_id").alias("pool_size"))
    grid = size.crossJoin(F.broadcast(params.select("component", F.col("mean").alias("pm"), "league_rate")))  # six rows
    x = grid.join(F.broadcast(pool_mean(pool, ["period", "component"])), ["period", "component"], "left").join(F.broadcast(pool_rate(pool, ["period", "component"], p.basis)), ["period", "component"], "left")
    own = F.col("pool_size") >= p.min_pool
    return x.select("period", "component", F.when(own, F.coalesce("pool_mean", F.lit(0.0))).otherwise(F.col("pm")).alias("mu"), F.when(own, F.coalesce("pool_rate", F.lit(0.0))).otherwise(F.col("league_rate")).alias("league_workload"), "pool_size", F.when(own, "period_pool").otherwise("historical_pool").alias("baseline_source"))


def apply_shrinkage(dense: DataFrame, params: DataFrame, baseline: DataFrame, p: Params) -> DataFrame:
    """Adds weight, observed and adjusted value per opportunity, adjusted workload, adj_rate and base_rate.

    `dense` has a row for each entity, period and component, absent ones with nulls."""
    x = dense.join(F.broadcast(params.select("component", "k", "k_exposure", "s2")), "component").join(F.broadcast(baseline.select("period", "component", "mu", "league_workload")), ["period", "component"])
    weight = reliability_weight(F.col("opps"), F.col("k"))
    seen = F.col("value") / F.when(F.col("opps") > 0, F.col("opps"))
    x = x.withColumns({"weight": weight, "observed_value": seen, "adj_value": F.coalesce(F.col("mu") + weight * (seen - F.col("mu")), F.col("mu")), "obs_rate": F.col("value") / F.when(F.col("exposure") > 0, F.col("exposure")) * p.basis})
    rate = F.col("opps") / F.when(F.col("exposure") > 0, F.col("exposure")) * p.basis
    x = x.withColumn("adj_opp_rate", shrink_workload(rate, F.col("exposure"), F.col("k_exposure"), F.col("league_workload")))
    return x.withColumns({"adj_rate": F.col("adj_value") * F.col("adj_opp_rate"), "base_rate": F.col("mu") * F.col("adj_opp_rate")})


def shrunk_totals(shrunk: DataFrame, total: DataFrame, p: Params) -> DataFrame:
    """Per entity and period: adj_total, base_total, obs_total, sampling variance and total reliability."""
    n = len(p.components)
    x = shrunk.groupBy("entity_id", "period").agg(
        F.first("exposure").alias("exposure"), F.first("status").alias("status"), F.first("in_pool").alias("in_pool"), F.sum("adj_rate").alias("adj_total"), F.sum("base_rate").alias("base_total"),
        F.when(F.count("value") == n, F.sum("obs_rate")).alias("obs_total"), F.sum(F.when(F.col("s2") > 0, F.coalesce("opps", F.lit(0)) * F.col("s2"))).alias("ns"),
    )
    x = x.withColumn("sampling_variance", F.when(F.col("exposure") > 0, F.pow(p.basis / F.when(F.col("exposure") > 0, F.col("exposure")), 2) * F.coalesce("ns", F.lit(0.0)))).drop("ns").crossJoin(F.broadcast(total.select("total_tau2")))  # one row
    return x.withColumn("total_reliability", F.when(F.col("total_tau2") > 0, F.coalesce(F.col("total_tau2") / (F.col("total_tau2") + F.col("sampling_variance")), F.lit(0.0)))).drop("total_tau2")
