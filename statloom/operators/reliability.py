"""Variance components: how much of a rate is the entity and how much is noise.

All estimators take one table of sufficient statistics, a row for each entity, period and component, which one pass over
the matches makes (`moments`); so facts are read once, whatever is estimated from them. Each estimator is one or two
grouped aggregations of that table for every component at once, with partial sums combined before the shuffle. Sums of
squares are taken about group means in one pass: sum(v^2 / n) - (sum v)^2 / sum n equals sum((v - n g)^2 / n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.scalars import guarded_corr
from statloom.operators.rank import medians
from statloom.plans.params import Params

GROUP = ["entity_id", "period"]


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.nullif(F.sum(w), F.lit(0))


def moments(matches: DataFrame, basis: float) -> DataFrame:
    """(entity_id, period, component, ...): sums of all that the estimators need from matches (value, opps, exposure, order).

    w_: value's noise (matches, sum v^2 / n, sum v, sum n); h_: halves by date (matches, sums of odd and even ones);
    x_: rate of opportunities (matches, sum e r^2, sum e r, sum e); value and opps: the period's own sums."""
    seen = F.col("value").isNotNull() & F.col("opps").isNotNull()
    w = Window.partitionBy(*GROUP, "component").orderBy("_order")
    order = F.when(seen, F.struct("event_date", "event_id"))  # matches without either take no part in the halves
    x = matches.withColumn("_order", order).withColumn("_no", F.when(seen, F.count("_order").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    odd, noise, rated = seen & (F.col("_no") % 2 == 1), F.col("value").isNotNull() & (F.col("opps") > 0), F.col("opps").isNotNull() & (F.col("exposure") > 0)
    even, v, n, e = seen & (F.col("_no") % 2 == 0), F.col("value"), F.col("opps"), F.col("exposure")
    rate = n / e * basis
    total = lambda when, c: F.sum(F.when(when, c))
    return x.groupBy(*GROUP, "component").agg(
        F.count_if(noise).alias("w_m"), total(noise, v * v / n).alias("w_q"), total(noise, v).alias("w_v"), total(noise, n).alias("w_n"),
        F.count_if(seen).alias("h_m"), total(odd, v).alias("h_v1"), total(odd, n).alias("h_n1"), total(even, v).alias("h_v2"), total(even, n).alias("h_n2"),
        F.count_if(rated).alias("x_m"), total(rated, e * rate * rate).alias("x_q"), total(rated, e * rate).alias("x_r"), total(rated, e).alias("x_e"),
        F.sum("value").alias("value"), F.sum("raw_value").alias("raw_value") if "raw_value" in matches.columns else F.lit(None).cast("double").alias("raw_value"), F.sum("opps").alias("opps"),
    )


def within_variance(cube: DataFrame, min_matches: int) -> DataFrame:
    """(component, s2, n_groups, n_matches): variance of one opportunity's value within entity and period."""
    groups = cube.filter(F.col("w_m") >= min_matches)
    out = groups.groupBy("component").agg(F.sum(F.col("w_q") - F.col("w_v") * F.col("w_v") / F.col("w_n")).alias("num"), F.sum(F.col("w_m") - 1).alias("den"), F.count("*").alias("n_groups"), F.sum("w_m").alias("n_matches"))
    return out.select("component", F.when((F.col("den") > 0) & (F.col("num") > 0), F.col("num") / F.col("den")).alias("s2"), "n_groups", "n_matches")


def _weighted_moments(rows: DataFrame, x: Column, w: Column) -> DataFrame:
    """Per component: weight sums, weighted mean and weighted variance about it (two passes, exact)."""
    mean = rows.groupBy("component").agg(weighted_mean(x, w).alias("mean"))
    joined = rows.join(F.broadcast(mean), "component")  # one row a component
    d = x - F.col("mean")
    return joined.groupBy("component").agg(F.first("mean").alias("mean"), F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), (F.sum(w * d * d) / F.sum(w)).alias("observed"))


def between_variance(seasons: DataFrame, s2: DataFrame, p: Params) -> DataFrame:
    """(component, tau2, mean, n_used): variance of true value per opportunity, noise removed."""
    use = seasons.filter((F.col("exposure") >= p.min_exposure) & (F.col("opps") >= p.min_opps) & F.col("value").isNotNull())
    m = _weighted_moments(use, F.col("value") / F.col("opps"), F.col("opps").cast("double")).join(F.broadcast(s2.select("component", "s2")), "component")
    correction = 1 - F.col("w2") / (F.col("w") * F.col("w"))
    noise = F.col("n") * F.col("s2") / F.col("w")
    enough = F.col("n") >= 2
    return m.select("component", F.when(enough & (correction > 0), (F.col("observed") - noise) / F.when(correction > 0, correction)).alias("tau2"), F.when(enough, F.col("mean")).otherwise(0.0).alias("mean"), F.col("n").alias("n_used"))


def pool_mean(seasons: DataFrame, keys: list[str]) -> DataFrame:
    use = seasons.filter("value is not null and opps > 0")
    return use.groupBy(*keys).agg((F.sum("value") / F.sum("opps")).alias("pool_mean"))


def pool_rate(seasons: DataFrame, keys: list[str], basis: float) -> DataFrame:
    use = seasons.filter("opps is not null and exposure > 0")
    return use.groupBy(*keys).agg((F.sum("opps") / F.sum("exposure") * basis).alias("pool_rate"))


def split_half(cube: DataFrame, min_matches: int) -> DataFrame:
    """(component, split_half, spearman_brown): odd against even matches by date."""
    halves = cube.filter((F.col("h_m") >= max(2 * min_matches, 6)) & (F.col("h_n1") > 0) & (F.col("h_n2") > 0))
    r = halves.groupBy("component").agg(guarded_corr(F.col("h_v1") / F.col("h_n1"), F.col("h_v2") / F.col("h_n2"), 10).alias("r"))
    r = r.select("component", F.when(F.abs("r") < 0.005, 0.0).otherwise(F.col("r")).alias("split_half"))
    return r.withColumn("spearman_brown", F.when(F.col("split_half") > -1, 2 * F.col("split_half") / (1 + F.col("split_half"))))


def consecutive(seasons: DataFrame, p_min: float, least_opps: int) -> DataFrame:
    """(component, entity, x, y, nx, ny): value per opportunity in a period and in the next."""
    use = seasons.filter((F.col("exposure") >= p_min) & (F.col("opps") >= least_opps) & F.col("value").isNotNull()).select("entity_id", "period", "component", (F.col("value") / F.col("opps")).alias("x"), F.col("opps").alias("nx"))
    after = use.select("entity_id", "component", (F.col("period") - 1).alias("period"), F.col("x").alias("y"), F.col("nx").alias("ny"))
    return use.join(after, ["entity_id", "component", "period"])


def year_over_year(seasons: DataFrame, p: Params) -> DataFrame:
    return consecutive(seasons, p.regular_exposure, 1).groupBy("component").agg(guarded_corr(F.col("x"), F.col("y"), 10).alias("year_over_year"))


def drift(seasons: DataFrame, variances: DataFrame, p: Params) -> DataFrame:
    """(component, drift, drift_source) from consecutive differences; `variances` has component, s2, tau2."""
    pairs = consecutive(seasons, p.drift_exposure, p.min_opps).groupBy("component").agg(F.count("*").alias("pairs"), F.var_samp(F.col("y") - F.col("x")).alias("dv"), F.avg(1 / F.col("nx") + 1 / F.col("ny")).alias("inv"))
    x = variances.join(F.broadcast(pairs), "component", "left")
    tau2, d = F.col("tau2"), F.col("dv") - F.col("s2") * F.col("inv")
    none, thin = tau2.isNull() | (tau2 <= 0), F.col("s2").isNull() | (F.col("s2") <= 0) | F.coalesce(F.col("pairs") < 10, F.lit(True))
    value = F.when(none, 0.0).when(thin, tau2 * p.drift_fallback).when(d < tau2 * p.drift_floor, tau2 * p.drift_floor).when(d > tau2, tau2).otherwise(d)
    source = F.when(none, "unavailable").when(thin, "fallback_share_of_talent_variance").when(d < tau2 * p.drift_floor, "clamped_to_floor").when(d > tau2, "clamped_to_talent_variance").otherwise("empirical")
    return x.select("component", value.alias("drift"), source.alias("drift_source"))


def _lookup(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v)))), F.col("component"))


def k_gate(x: DataFrame, p: Params) -> DataFrame:
    """Adds k, source, reason: the empirical s2 / tau2 or the component's fallback."""
    candidate = F.try_divide(F.col("s2"), F.col("tau2"))
    reason = (
        F.when(F.col("s2").isNull(), "no_variance").when(F.col("tau2").isNull() | (F.col("tau2") <= 0), "no_talent_variance").when(F.col("n_groups") < p.min_groups, "too_few_groups")
        .when((candidate < p.k_range[0]) | (candidate > p.k_range[1]), "out_of_range").when(F.col("split_half").isNull() | (F.col("split_half") < p.min_split_half), "no_repeatability").otherwise("empirical")
    )
    x = x.withColumn("reason", reason)
    empirical = F.col("reason") == "empirical"
    return x.withColumns({"k": F.when(empirical, candidate).otherwise(_lookup(p.fallback_k)), "source": F.when(empirical, "empirical").otherwise("fallback")})


def volume_reliability(cube: DataFrame, p: Params) -> DataFrame:
    """(component, k_exposure, volume_source, sampling, talent, league_rate, volume_groups, reliability_900)."""
    seasons, rate = cube, F.col("opps") / F.col("exposure") * p.basis
    groups = cube.filter(F.col("x_m") >= p.min_matches)
    within = groups.groupBy("component").agg(F.sum(F.col("x_q") - F.col("x_r") * F.col("x_r") / F.col("x_e")).alias("num"), F.sum(F.col("x_m") - 1).alias("den"), F.count("*").alias("volume_groups"))
    within = within.select("component", F.when((F.col("den") > 0) & (F.col("num") > 0), F.col("num") / F.col("den")).alias("sampling"), "volume_groups")
    pool = seasons.filter((F.col("exposure") >= p.min_exposure) & F.col("opps").isNotNull())
    m = _weighted_moments(pool, rate, F.col("exposure").cast("double"))
    x = pool_rate(seasons, ["component"], p.basis).withColumnRenamed("pool_rate", "league_rate").join(F.broadcast(within), "component", "left").join(F.broadcast(m), "component", "left")
    correction = 1 - F.col("w2") / (F.col("w") * F.col("w"))
    x = x.withColumn("talent", F.when((F.col("n") >= 2) & (correction > 0), (F.col("observed") - F.col("n") * F.col("sampling") / F.col("w")) / F.when(correction > 0, correction)))
    candidate = F.try_divide(F.col("sampling"), F.col("talent"))
    sound = (F.col("talent") > 0) & (F.col("volume_groups") >= p.min_groups) & candidate.between(*p.volume_range)
    sound = F.coalesce(sound, F.lit(False))
    x = x.withColumns({"k_exposure": F.when(sound, candidate).otherwise(_lookup(p.volume_fallback)), "volume_source": F.when(sound, "empirical").otherwise("fallback")})
    return x.select("component", "k_exposure", "volume_source", "sampling", "talent", "league_rate", "volume_groups", (900 / (900 + F.col("k_exposure"))).alias("reliability_900"))


def estimate_reliability(cube: DataFrame, p: Params) -> DataFrame:
    """One row of parameters per component, from the history periods of `moments` with each period's exposure."""
    s = cube.filter(F.col("period").between(*p.history))
    w = within_variance(s, p.min_matches)
    b = between_variance(s, w, p)
    out = pool_mean(s, ["component"])
    for part in (w, b, split_half(s, p.min_matches), year_over_year(s, p), medians(s.filter(F.col("exposure") >= p.regular_exposure), ["component"], ["opps"])):
        out = out.join(F.broadcast(part), "component", "left")  # one row a component
    out = k_gate(out.withColumn("mean", F.when(F.col("s2") > 0, F.col("mean")).otherwise(F.col("pool_mean"))), p)
    out = out.join(F.broadcast(drift(s, out.select("component", "s2", "tau2"), p)), "component", "left")
    out = out.withColumn("reliability_at_median", F.col("median_opps") / (F.col("median_opps") + F.col("k")))
    return out.join(F.broadcast(volume_reliability(s, p)), "component", "left")


def total_variance(totals: DataFrame, components: DataFrame, params: DataFrame, p: Params) -> DataFrame:
    """One row: tau2 and drift of the total rate; rebuilt from components where the direct estimate isn't positive."""
    use = totals.filter((F.col("exposure") >= p.min_exposure) & F.col("total_rate").isNotNull() & F.col("period").between(*p.history))
    noise = components.join(F.broadcast(params.select("component", "s2")), "component").groupBy(*GROUP).agg(F.sum(F.col("opps") * F.col("s2")).alias("ns"))
    x = use.join(noise, GROUP).withColumn("noise", F.pow(p.basis / F.col("exposure"), 2) * F.col("ns")).filter("noise > 0").withColumn("w", 1 / F.col("noise")).withColumn("component", F.lit("total"))
    m = _weighted_moments(x, F.col("total_rate"), F.col("w"))
    correction = 1 - F.col("w2") / (F.col("w") * F.col("w"))
    direct = m.select(F.when((F.col("n") >= 5) & (correction > 0), (F.col("observed") - F.col("n") / F.col("w")) / F.when(correction > 0, correction)).alias("direct"))
    med = medians(components.filter((F.col("exposure") >= p.min_exposure) & F.col("period").between(*p.history)), ["component"], ["opps", "exposure"])
    derived = med.join(F.broadcast(params.select("component", "tau2")), "component").agg(F.sum(F.when(F.col("tau2") > 0, F.col("tau2") * F.pow(p.basis * F.col("median_opps") / F.greatest("median_exposure", F.lit(1.0)), 2))).alias("derived"))
    t = direct.crossJoin(derived)  # one row each
    own = F.col("direct") > 0
    t = t.select(F.when(own, F.col("direct")).otherwise(F.coalesce("derived", F.lit(0.0))).alias("total_tau2"), F.when(own, "empirical").when(F.col("derived") > 0, "component_derived").otherwise("unavailable").alias("total_source"))
    return t.withColumn("total_drift", F.col("total_tau2") * F.when(F.col("total_source") == "empirical", p.drift_floor).otherwise(p.drift_fallback))
