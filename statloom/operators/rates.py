"""Rates per exposure and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalars import per_exposure


def add_totals(components: DataFrame, keys: list[str], n_components: int) -> DataFrame:
    """Total value only if every component is present; total opportunities if any is."""
    complete = F.count("value") == n_components
    return components.groupBy(*keys).agg(
        F.when(complete, F.sum("value")).alias("total_value"), F.when(F.count("raw_value") == n_components, F.sum("raw_value")).alias("total_raw"),
        F.sum("opps").alias("total_opps"), complete.alias("components_complete"),
    )


def add_rates(components: DataFrame, basis: float) -> DataFrame:
    """value_rate and opp_rate per `basis` of exposure."""
    return components.withColumns({"value_rate": per_exposure(F.col("value"), F.col("exposure"), basis), "opp_rate": per_exposure(F.col("opps"), F.col("exposure"), basis)})


def traditional(season: DataFrame, basis: float) -> DataFrame:
    """Conceded, faced and expected per basis, save percentage, prevented."""
    rate = lambda c: per_exposure(F.col(c), F.col("exposure"), basis)
    out = season.withColumns({"conceded_rate": rate("conceded"), "shots_rate": rate("shots"), "expected_rate": rate("expected"), "save_pct": F.try_divide(F.col("saves") * 100.0, F.when(F.col("shots") > 0, F.col("shots"))), "prevented": F.col("expected") - F.col("conceded")})
    return out.withColumn("prevented_rate", rate("prevented"))
