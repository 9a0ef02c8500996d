"""Current talent: a league prior, the past period and the live period weighted by their precision."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.rank import TIE, competition_rank, weighted_percentile
from statloom.plans.params import Params


UNIDENTIFIED = "total talent variance is not identified: neither its direct estimate nor the components' is positive"


def league_mean_total(prior: DataFrame, p: Params) -> DataFrame:
    """One row: exposure-weighted mean of the observed total, of regular entities if there are any."""
    use = prior.filter("obs_total is not null")
    regular = F.col("exposure") >= p.regular_exposure
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("exposure") * F.col("obs_total"))), F.sum(F.when(c, F.col("exposure"))))
    return use.agg(F.coalesce(mean(regular), mean(F.lit(True)), F.lit(0.0)).alias("league_mean"))


def current_talent(totals: DataFrame, total: DataFrame, p: Params) -> DataFrame:
    """Posterior mean, sd, interval and weights for every entity of either period; without a total variance an error says so."""
    side = lambda period, name: totals.filter(F.col("period") == period).select("entity_id", F.col("obs_total").alias(f"{name}_rate"), F.col("exposure").alias(f"{name}_exposure"), F.col("sampling_variance").alias(f"{name}_sv"))
    prior, live = side(p.final, "prior"), side(p.live, "live")
    x = prior.join(live, "entity_id", "full_outer").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(league_mean_total(totals.filter(F.col("period") == p.final), p)))  # one row each
    x = x.withColumn("total_tau2", F.when(F.col("total_tau2") > 0, F.col("total_tau2")).otherwise(F.raise_error(F.lit(UNIDENTIFIED)).cast("double")))
    a = F.when(F.col("prior_rate").isNotNull() & (F.col("prior_sv") >= 0), 1 / (F.col("prior_sv") + F.col("total_drift")))
    b = F.when(F.col("live_rate").isNotNull() & (F.col("live_sv") > 0), 1 / F.when(F.col("live_sv") > 0, F.col("live_sv")))
    x = x.withColumns({"_a": F.coalesce(a, F.lit(0.0)), "_b": F.coalesce(b, F.lit(0.0)), "_p": 1 / F.col("total_tau2")}).withColumn("_t", F.col("_p") + F.col("_a") + F.col("_b"))
    mean = (F.col("_p") * F.col("league_mean") + F.col("_a") * F.coalesce("prior_rate", F.lit(0.0)) + F.col("_b") * F.coalesce("live_rate", F.lit(0.0))) / F.col("_t")
    x = x.withColumns({"talent": mean, "talent_sd": F.sqrt(1 / F.col("_t")), "weight_league": F.col("_p") / F.col("_t"), "weight_prior": F.col("_a") / F.col("_t"), "weight_live": F.col("_b") / F.col("_t"), "prior_source": F.when(F.col("_a") > 0, "history").otherwise("new")})
    z = NormalDist().inv_cdf(0.5 + p.interval / 2)
    x = x.withColumns({"talent_low": F.col("talent") - z * F.col("talent_sd"), "talent_high": F.col("talent") + z * F.col("talent_sd"), "evidence_exposure": F.coalesce("live_exposure", F.lit(0.0)) + F.coalesce("prior_exposure", F.lit(0.0)), "in_live": F.col("live_exposure").isNotNull()})
    return x.drop("_a", "_b", "_p", "_t", "prior_sv", "live_sv", "total_tau2", "total_drift", "total_source")


def rank_talent(talent: DataFrame, least_live: int = 10) -> DataFrame:
    """Percentiles of the mean and of both bounds on one scale, and the rank; the pool is the live entities. Means and bounds nearer than TIE to the next are ties."""
    enough = F.broadcast(talent.agg((F.count_if("in_live") >= least_live).alias("_enough")))  # one row
    x = talent.crossJoin(enough).withColumn("_pool", F.col("in_live") | ~F.col("_enough")).drop("_enough")
    long = x.select("entity_id", "evidence_exposure", "_pool", F.explode(F.create_map(F.lit("mid"), "talent", F.lit("low"), "talent_low", F.lit("high"), "talent_high")).alias("bound", "v"))
    out = interval_percentiles(long, x.filter("_pool"), "talent", "evidence_exposure", near=TIE)
    wide = out.groupBy("entity_id").pivot("bound", ["mid", "low", "high"]).agg(F.first("pct"))
    x = x.join(wide.select("entity_id", F.col("mid").alias("talent_pct"), F.col("low").alias("talent_pct_low"), F.col("high").alias("talent_pct_high")), "entity_id")
    return competition_rank(x.withColumn("_one", F.lit(1)), ["_one"], "talent", "talent_rank", near=TIE).drop("_one", "_pool")


def with_identity(talent: DataFrame, ratings: DataFrame, entities: DataFrame, p: Params) -> DataFrame:
    """`talent` with status, name and team of the live period where the entity is in it, else of the past one."""
    seen = ratings.filter(F.col("period").isin(p.final, p.live)).groupBy("entity_id").agg(F.max_by(F.struct("status"), "period").alias("_last"))
    known = talent.join(seen.select("entity_id", "_last.status"), "entity_id", "left")
    return known.join(entities.select("entity_id", "name", "team"), "entity_id", "left")


def interval_percentiles(long: DataFrame, pool: DataFrame, value: str, weight: str, keys: list[str] | None = None, near: float | None = None) -> DataFrame:
    """`long` (.., v) with pct of v against the pool's `value` weighted by `weight`: bounds on the score's own scale."""
    keys = keys or ["_k"]
    if keys == ["_k"]:
        long, pool = long.withColumn("_k", F.lit(1)), pool.withColumn("_k", F.lit(1))
    asked = long.withColumn("_w", F.lit(0.0)).withColumn("_in", F.lit(False))
    given = pool.select(*keys, F.col(value).alias("v"), F.col(weight).alias("_w")).withColumn("_in", F.lit(True))
    both = asked.unionByName(given, allowMissingColumns=True)
    out = weighted_percentile(both, keys, "v", "_w", "_in", near=near)
    return out.filter("not _in").drop("_w", "_in", *(["_k"] if keys == ["_k"] else []))
