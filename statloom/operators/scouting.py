"""Serving queries: similarity, fit, notes, comparison matrices and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.rank import rank_of, standings


def cosine_to(pcts: DataFrame, reference: DataFrame, least: int = 3) -> DataFrame:
    """(entity_id, similarity) of component percentiles to one reference profile, on at least `least` shared ones."""
    r = F.broadcast(reference.select("component", F.col("pct").alias("q")))  # one row a component
    x = pcts.join(r, "component").filter("pct is not null and q is not null").groupBy("entity_id").agg(F.count("*").alias("n"), F.sum(F.col("pct") * F.col("q")).alias("d"), F.sum(F.col("pct") * F.col("pct")).alias("a"), F.sum(F.col("q") * F.col("q")).alias("b"))
    return x.filter(F.col("n") >= least).select("entity_id", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("d") / F.sqrt(F.col("a") * F.col("b"))).alias("similarity"))


def fit_score(first: Column, second: Column, third: Column, score: Column, reliability: Column, exposure: Column, similarity: Column, bonus: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.35 * zero(first) + 0.15 * zero(second) + 0.15 * zero(third) + 0.2 * F.coalesce(score, F.lit(50.0)) + 10.0 * zero(reliability) + F.least(F.lit(20.0), exposure / 180.0) + 25.0 * zero(similarity) + F.when(bonus, 8.0).otherwise(0.0)


def compare_matrix(metrics: DataFrame, higher: dict[str, bool | None]) -> DataFrame:
    """`metrics` (entity_id, metric, value) with is_best: the best of each metric by its direction; neutral ones have none."""
    up = F.col("metric").isin([m for m, h in higher.items() if h]) if any(higher.values()) else F.lit(False)
    down = F.col("metric").isin([m for m, h in higher.items() if h is False])
    w = Window.partitionBy("metric")
    best = F.when(up, F.max("value").over(w)).when(down, F.min("value").over(w))
    return metrics.withColumn("is_best", F.coalesce(F.col("value") == best, F.lit(False)))


def rank_among(metrics: DataFrame, higher: dict[str, bool]) -> DataFrame:
    """Rank and number of values for each metric."""
    x = F.when(F.col("metric").isin([m for m, h in higher.items() if h]), F.col("value")).otherwise(-F.col("value"))
    placed = standings(metrics.withColumn("_signed", x), ["metric"], ["entity_id"], ["_signed"])
    of = placed.groupBy("metric").agg(F.count("value").alias("of"))
    return placed.withColumn("rank", rank_of("_signed")).drop("_signed", "at__signed").join(F.broadcast(of), "metric")  # one row a metric
