"""Where the league's average lies on a period's scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.rank import medians
from statloom.operators.talent import interval_percentiles


def league_reference(ratings: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row a period: the average entity's adjusted rate and its percentile, and the pool's spread.

    The average entity has every component's baseline value at its league workload."""
    average = baseline.groupBy("period").agg(F.sum(F.col("mu") * F.col("league_workload")).alias("average_adjusted"), F.min("baseline_source").alias("baseline_source"))
    pool = ratings.filter("in_pool and adj_total is not null")
    placed = interval_percentiles(average.withColumn("v", F.col("average_adjusted")), pool.select("period", "adj_total", "exposure"), "adj_total", "exposure", ["period"])
    spread = [f(c).alias(f"{name}_{stat}") for name, c in (("adj", "adj_total"), ("obs", "obs_total")) for stat, f in (("min", F.min), ("max", F.max))]
    named = {"adj_total": "adj_median", "obs_total": "obs_median", "conceded_rate": "conceded_median", "save_pct": "save_pct_median"}
    middle = medians(pool, ["period"], list(named)).withColumnsRenamed({f"median_{c}": m for c, m in named.items()})
    sizes = pool.groupBy("period").agg(F.count("*").alias("pool_size"), *spread).join(middle, "period")
    return sizes.join(placed.select("period", "average_adjusted", "baseline_source", F.col("pct").alias("average_score")), "period")
