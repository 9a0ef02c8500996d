"""Dated standings: build, compare, movement, history, pruning and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.sources.payload import written


def build_snapshot(ratings: DataFrame, captured_at) -> DataFrame:
    return ratings.select("period", captured_at.alias("captured_at"), "entity_id", F.col("rank_adjusted").alias("rank"), F.round("score", 1).alias("score"), F.round("adj_total", 4).alias("rate"), F.round("exposure", 1).alias("exposure"))


ENTRY = ("entity_id", "rank", "score", "rate", "exposure")
IDENTITY = ("source_fingerprint", "methodology_version")
#: Decimal places that a snapshot keeps of its numbers.
PLACES = {"score": 1, "rate": 4, "exposure": 1}


def row_digest(columns: tuple[str, ...] = ENTRY) -> Column:
    """60 bits of the SHA-256 of an entry's values as text; numbers count in units of their last place, nulls are `-`."""
    unit = lambda c: F.round(F.col(c) * 10 ** PLACES[c]).cast("bigint") if c in PLACES else F.col(c)
    text = F.concat_ws("|", *(F.coalesce(unit(c).cast("string"), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def headers(entries: DataFrame, sources: DataFrame, methodology_version: str) -> DataFrame:
    """(period, captured_at, source_fingerprint, methodology_version, max_match_date, n, digest_sum, digest_xor): a row a snapshot.

    Digests don't depend on order, so they are added up where entries lie; `sources` has fingerprint and max_match_date a period."""
    own = entries.select("period", "captured_at", row_digest().alias("h")).groupBy("period", "captured_at").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest_sum"), F.bit_xor("h").alias("digest_xor"))
    facts = sources.select("period", "source_fingerprint", "max_match_date")
    return own.join(F.broadcast(facts), "period", "left").withColumn("methodology_version", F.lit(methodology_version))  # one row a period


def verdicts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(period, changed, reason, captured_at, previous_at) for each period's current header beside its previous one.

    A snapshot is changed if there is none before it, or source fingerprint, methodology version or entries differ."""
    before = previous.select("period", F.struct("captured_at", *IDENTITY, "n", "digest_sum", "digest_xor").alias("_b"))
    same = lambda *cols: F.lit(True) if not cols else F.col(cols[0]).eqNullSafe(F.col(f"_b.{cols[0]}")) & same(*cols[1:])
    reason = (
        F.when(F.col("_b").isNull(), "first").when(~same("source_fingerprint"), "source").when(~same("methodology_version"), "methodology")
        .when(~same("n", "digest_sum", "digest_xor"), "entries").otherwise("unchanged")
    )
    return current.join(before, "period", "left").select("period", (reason != "unchanged").alias("changed"), reason.alias("reason"), "captured_at", F.col("_b.captured_at").alias("previous_at"))


def snapshot_changed(previous: DataFrame, current: DataFrame) -> bool:
    """Whether any period of `current` (headers) differs from `previous`: one row a period is compared, no entries."""
    return not verdicts(previous, current).filter("changed").isEmpty()


def changed_entries(before: DataFrame, after: DataFrame, judged: DataFrame) -> DataFrame:
    """(period, entity_id, change) of the periods that `judged` finds changed; entries of the others are not read into the join."""
    some = F.broadcast(judged.filter("changed").select("period"))  # one row a period
    side = lambda df, name: df.join(some, "period", "left_semi").select("period", "entity_id", F.struct(*ENTRY[1:]).alias(name))
    x = side(before, "_b").join(side(after, "_a"), ["period", "entity_id"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return x.select("period", "entity_id", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("altered").alias("change"))


def write_snapshot(entries: DataFrame, header: DataFrame, path: str, newest: int = 10) -> DataFrame:
    """Adds the snapshots of periods that changed since the last one at `path`, in folders of their own; returns the verdicts.

    A snapshot of a date replaces the one of the same date, so a job that runs again adds nothing. Only the `newest` of each
    period are read back by `read_history`."""
    spark = entries.sparkSession
    known = read_history(spark, path, newest)
    judged = verdicts(latest(known), header) if known is not None else header.select("period", F.lit(True).alias("changed"), F.lit("first").alias("reason"), "captured_at", F.lit(None).cast("date").alias("previous_at"))
    judged = written(judged, "parquet")
    new = F.broadcast(judged.filter("changed").select("period"))
    for name, rows in (("headers", header), ("entries", entries)):
        out = rows.join(new, "period", "left_semi").repartition("period", "captured_at")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "captured_at").parquet(f"{path}/{name}")
    return judged


def read_history(spark, path: str, newest: int | None = None, name: str = "headers") -> DataFrame | None:
    """Headers (or entries) of the snapshots at `path`, of each period the `newest`; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.parquet(f"{path}/{name}").withColumn("captured_at", F.to_date(F.col("captured_at").cast("string")))
    return prune(rows, newest) if newest else rows


def latest(snapshots: DataFrame) -> DataFrame:
    top = snapshots.groupBy("period").agg(F.max("captured_at").alias("captured_at"))
    return snapshots.join(F.broadcast(top), ["period", "captured_at"])  # one row a period


def prune(snapshots: DataFrame, newest: int) -> DataFrame:
    dates = snapshots.select("period", "captured_at").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("captured_at")))).filter(F.col("_r") <= newest).drop("_r")
    return snapshots.join(F.broadcast(dates), ["period", "captured_at"])  # `newest` rows a period


def rank_movement(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds previous_rank, previous_score, rank_change (positive: climbed) and score_change."""
    p = previous.select("entity_id", F.col("rank").alias("previous_rank"), F.col("score").alias("previous_score"))
    x = current.join(p, "entity_id", "left")
    return x.withColumns({"rank_change": F.col("previous_rank") - F.col("rank"), "score_change": F.round(F.col("score") - F.col("previous_score"), 1)})


def ranking_history(snapshots: DataFrame) -> DataFrame:
    """(entity_id, history): ranks oldest first, null ranks left out."""
    return snapshots.filter("rank is not null").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("captured_at", "rank"))).alias("history"))


def source_fingerprint(resources: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted (resource, content hash) pairs, of which there are few."""
    return resources.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "resource", "content_sha"))), "|"), 256).alias("fingerprint"))


def changes(before: DataFrame, after: DataFrame, key: str = "entity_id", compared: tuple[str, ...] = ("rank", "score", "rate", "exposure")) -> DataFrame:
    """(key, change): entries added, removed or altered in any of `compared`."""
    side = lambda df, name: df.select(F.col(key), F.struct(*compared).alias(name))
    x = side(before, "_b").join(side(after, "_a"), key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return x.select(key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("altered").alias("change"))
