"""Canonical facts and dimensions: keep-first and keep-last, slugs, placeholders, stints, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.scalars import slug


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dedupe_slugs(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, slug): the first id keeps the base, later ones get six characters of their id, then -2, -3, ..."""
    base = df.select(F.col(id_col).alias("id"), slug(F.col(name_col)).alias("base")).distinct()
    first = base.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy(F.col("id").cast("string"))))
    second = first.withColumn("s", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.substring(F.col("id").cast("string"), 1, 6))))
    again = second.withColumn("m", F.row_number().over(Window.partitionBy("s").orderBy(F.col("n") > 1, F.col("id").cast("string"))))
    return again.select("id", F.when(F.col("m") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", F.col("m").cast("string"))).alias("slug"))


def attach_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], order: list) -> DataFrame:
    """`right` joined on `keys` after it is reduced to one row a key, so rows of `left` never multiply."""
    return left.join(keep_first(right, keys, order), keys, "left")


def label_unknown(facts: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Facts with the dimension's name, or "Unknown (id)"."""
    got = facts.join(dim.select(key, name), key, "left")
    return got.withColumn(name, F.coalesce(name, F.concat(F.lit("Unknown ("), F.col(key).cast("string"), F.lit(")"))))


def placeholder_rows(dim: DataFrame, key: str, name: str, *referenced: DataFrame) -> DataFrame:
    """The dimension plus a synthetic row for each referenced id that it lacks."""
    ids = referenced[0].select(key)
    for r in referenced[1:]:
        ids = ids.union(r.select(key))
    missing = ids.filter(F.col(key).isNotNull()).distinct().join(dim, key, "left_anti")
    return dim.select(key, name).unionByName(missing.select(key, F.concat(F.lit("Unknown ("), F.col(key).cast("string"), F.lit(")")).alias(name)))


def pivot_components(long: DataFrame, keys: list[str], values: list[str], components: tuple[str, ...]) -> DataFrame:
    """Six rows a key to one wide row; a component that is absent is null."""
    return long.groupBy(*keys).pivot("component", list(components)).agg(*(F.first(v).alias(v) for v in values))


def unpivot_components(wide: DataFrame, keys: list[str], value: str, components: tuple[str, ...]) -> DataFrame:
    return wide.unpivot([F.col(k) for k in keys], [F.col(f"{c}_{value}").alias(c) for c in components], "component", value)


def stints(matches: DataFrame, keys: list[str], team: str, order: list[str]) -> DataFrame:
    """Runs of consecutive matches for one team: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.lag(team).over(w) != F.col(team)).cast("int"), F.lit(1))
    runs = matches.withColumn("_c", change).withColumn("stint", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "stint", team).agg(F.count("*").alias("appearances"), F.sum("exposure").alias("exposure"), F.min(order[0]).alias("first_date"), F.max(order[0]).alias("last_date"))


def current_team(stints: DataFrame, keys: list[str], team: str) -> DataFrame:
    """The team of the last stint, the number of stints, and whether there were several."""
    return stints.groupBy(*keys).agg(F.max_by(F.struct(team), "stint").alias("_last"), F.count("*").alias("n_stints")).select(*keys, F.col(f"_last.{team}").alias("current_team"), "n_stints", (F.col("n_stints") > 1).alias("changed_teams"))


def project(df: DataFrame, types: dict[str, str], **constants: str) -> DataFrame:
    """The columns of `types`, cast; those that `df` lacks are null. `constants` are the same in every row."""
    columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select(*columns, *(F.lit(v).alias(c) for c, v in constants.items()))
