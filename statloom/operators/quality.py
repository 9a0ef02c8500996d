"""Data-quality checks: issues, contracts between feeds, reconciliation and the ledger of refreshes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_quality(checks: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(severity, check_id, n) of the checks (severity, id, failing rows) that find something."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("severity"), F.lit(i).alias("check_id"), "n") for s, i, df in checks]
    return reduce(DataFrame.unionByName, rows).filter("n > 0")


def validation_status(issues: DataFrame) -> DataFrame:
    """One row: failed if an issue is an error, warnings if there is one, else passed."""
    worst = F.coalesce(F.max(F.when(F.col("n") > 0, F.when(F.col("severity") == "error", 2).otherwise(1)).otherwise(0)), F.lit(0))
    return issues.agg(F.when(worst == 2, "failed").when(worst == 1, "warnings").otherwise("passed").alias("status"))


def issue_row(rows: DataFrame, issue: str, key: Column, samples: int = 5) -> DataFrame:
    """(issue, n, keys): how many rows, and the `samples` smallest keys among them."""
    least = rows.select(key.cast("string").alias("k"), key.alias("o")).distinct().orderBy("o").limit(samples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]), ",").alias("keys"))
    return rows.agg(F.count("*").alias("n")).join(least).select(F.lit(issue).alias("issue"), "n", "keys")  # one row each


def duplicate_issue(rows: DataFrame, keys: list[str], label: str, samples: int = 5) -> DataFrame:
    """(severity, issue, n, keys): a warning for all rows that share their `keys` with another row, with the `samples` smallest of
    these keys; no row if there is none. Rows are counted before the shuffle, samples are a top-k."""
    met = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("k")).filter("n > 1")
    least = met.orderBy("k").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keys"))
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    out = total.join(least).filter("n > 0")  # one row each
    return out.select(F.lit("warning").alias("severity"), F.lit(f"duplicate_{label}").alias("issue"), "n", "keys")


def component_contract(rows: DataFrame, expected: list[str], required: list[str], name: str = "component") -> DataFrame:
    """(component, severity, n): components expected and absent are errors, unexpected ones warnings, rows that miss a required field errors."""
    seen = rows.groupBy(name).agg(F.count("*").alias("n"), F.count_if(reduce(Column.__or__, (F.col(c).isNull() for c in required))).alias("bad"))
    wanted = rows.sparkSession.createDataFrame([(c,) for c in expected], "_wanted string")
    x = seen.join(F.broadcast(wanted), F.col(name) == F.col("_wanted"), "full")
    severity = F.when(F.col(name).isNull() | (F.col("bad") > 0), "error").when(F.col("_wanted").isNull(), "warning")
    return x.select(F.coalesce(name, "_wanted").alias("component"), severity.alias("severity"), F.coalesce(F.when(F.col("_wanted").isNull(), F.col("n")).otherwise(F.col("bad")), F.lit(0)).alias("n")).filter("severity is not null")


def reconcile_exposure(season: DataFrame, matches: DataFrame, tolerance: float = 5) -> DataFrame:
    """(period, off, gap): entities whose matches' exposure differs from the season's by over `tolerance`, and the largest gap."""
    m = matches.groupBy("entity_id", "period").agg(F.sum("exposure").alias("_e"))
    gap = F.abs(F.col("exposure") - F.col("_e"))
    return season.join(m, ["entity_id", "period"]).groupBy("period").agg(F.count_if(gap > tolerance).alias("off"), F.max(gap).alias("gap"))


def reconcile_feeds(components: DataFrame, season: DataFrame, component: str, tolerance: float = 0.05) -> DataFrame:
    """(verdict, n, breaches, gap): one component's raw value of one feed against expected less conceded of the other.

    A difference is compared to 9 digits, so one of just the tolerance is no breach, in whatever order its sums were made."""
    raw = components.filter(F.col("component") == component).select("entity_id", "period", "raw_value")
    delta = F.abs(F.col("raw_value") - (F.col("expected") - F.col("conceded")))
    x = season.join(raw, ["entity_id", "period"]).filter(delta.isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.round(delta, 9) > tolerance).alias("breaches"), F.max(delta).alias("gap"))
    return x.select(F.when(F.col("n") == 0, "none").when(F.col("breaches") > 0, "warning").otherwise("ok").alias("verdict"), "n", "breaches", "gap")


def refresh_row(refresh: int, rows: DataFrame, status: DataFrame, issues: DataFrame) -> DataFrame:
    """One audit row: freshness and fingerprint of `rows` (entity_id, period, exposure, last_date), status and errors."""
    facts = rows.agg(F.max("last_date").alias("max_date"), F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.max("last_date").cast("date").cast("string"), F.count_distinct("entity_id").cast("string")), 256).alias("fingerprint"))
    errors = issues.agg(F.coalesce(F.sum(F.when(F.col("severity") == "error", 1)), F.lit(0)).alias("errors"))
    return facts.join(status).join(errors).select(F.lit(refresh).alias("refresh_id"), "status", "errors", "max_date", "n_rows", "fingerprint")  # one row each


def append_refresh(row: DataFrame, path: str) -> None:
    """Adds a refresh to the ledger; one that runs again replaces its own row."""
    append_run(row, path, "refresh_id")


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """Appends the rows of runs named by column `run`: each run's folder is replaced as a whole, so a retried job adds nothing."""
    rows.repartition(run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
