"""Bootstrap over matches with draws that any engine reproduces, and posterior intervals.

A draw's match index comes from integer hashing (three quadratic rounds modulo a prime), so resamples need no sort,
and no generator state. Each match is first reduced to (value, exposure)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.plans.params import Params

PRIME = 2147483647
#: Draws held at once: few enough for a core's own cache.
CELLS = 65_536


def draws(entity: int, period: int, b: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places drawn (0 to n - 1) of resamples `b`, a row each."""
    start = entity * 69621 + period * 7919 + seed
    x = (start + b * 1000003)[:, None] + np.arange(n) * 48271
    x = (x if start >= 0 else np.abs(np.fmod(x, PRIME))).view(np.uint64)  # squared next, so the sign is of no matter
    high = np.empty_like(x)

    def fold(x):
        """Modulo 2^31 - 1 by the two halves, in place: at most PRIME + 4 is left, and PRIME stands for 0 as well."""
        for _ in range(2):
            np.right_shift(x, np.uint64(31), out=high)
            np.bitwise_and(x, np.uint64(PRIME), out=x)
            np.add(x, high, out=x)

    fold(x)
    for r in (1, 2, 3):
        np.multiply(x, x, out=x)
        np.add(x, np.uint64(12345 + 777 * r), out=x)
        fold(x)
    x = x.astype(np.uint32)
    np.subtract(x, np.uint32(PRIME), out=x, where=x >= PRIME)
    return (x - x // np.uint32(n) * np.uint32(n)).astype(np.intp)


def resampled(matches: DataFrame, statistic, p: Params, least: int) -> DataFrame:
    """(entity_id, period, boot_low, boot_high, boot_se) of `matches` (entity_id, period, event_date, event_id, v, e).

    `statistic` takes matrices of v and e, a row each resample, with nan for null. The matches of one entity in one
    period are one row here, and its resamples are drawn and summed up in its place, in blocks of about CELLS draws."""
    rows = matches.groupBy("entity_id", "period").agg(F.sort_array(F.collect_list(F.struct("event_date", "event_id", F.col("v").cast("double").alias("v"), F.col("e").cast("double").alias("e")))).alias("m")).filter(F.size("m") >= least)
    tail = (1 - p.interval) / 2

    def run(batches):
        for batch in batches:
            out = []
            for entity, period, v, e in zip(*(batch.column(i).to_pylist() for i in range(4))):
                v, e, n = np.array(v, float), np.array(e, float), len(v)
                step = max(1, CELLS // n)
                blocks = (draws(entity, period, np.arange(at, min(at + step, p.resamples)), n, p.seed) for at in range(0, p.resamples, step))
                stats = np.concatenate([statistic(v[j], e[j]) for j in blocks])
                stats = stats[~np.isnan(stats)]
                low, high = np.quantile(stats, [tail, 1 - tail]).tolist() if len(stats) else (None, None)
                out.append((low, high, float(stats.std(ddof=1)) if len(stats) > 1 else None))
            low, high, se = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in (low, high, se))], ["entity_id", "period", "boot_low", "boot_high", "boot_se"])

    kinds = {c: matches.schema[c].dataType.simpleString() for c in ("entity_id", "period")}
    return rows.select("entity_id", "period", "m.v", "m.e").mapInArrow(run, f"entity_id {kinds['entity_id']}, period {kinds['period']}, boot_low double, boot_high double, boot_se double")


def total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, without nan; nan for a row of nothing else."""
    out = x.sum(1)
    odd = np.isnan(out)
    if odd.any():
        out[odd] = np.where(np.isnan(x[odd]).all(1), np.nan, np.nansum(x[odd], 1))
    return out


def quotient(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, nan where y is 0."""
    return x / np.where(y == 0, np.nan, y)


def bootstrap_rate(matches: DataFrame, p: Params, least: int = 2) -> DataFrame:
    """Interval and standard error of the total rate; a missing component value counts as 0 here only."""
    return resampled(matches, lambda v, e: quotient(total(v), total(e)) * p.basis, p, least)


def bootstrap_mean(matches: DataFrame, p: Params, least: int = 3) -> DataFrame:
    """Interval of the mean of match rates."""

    def mean(v, e):
        rate = quotient(v, e) * p.basis
        return quotient(total(rate), (~np.isnan(rate)).sum(1))

    return resampled(matches, mean, p, least)


def posterior_interval(totals: DataFrame, boot: DataFrame, total: DataFrame, p: Params) -> DataFrame:
    """Centre adj_total, sd from tau2 and the bootstrap's variance."""
    z = NormalDist().inv_cdf(0.5 + p.interval / 2)
    x = totals.join(boot, ["entity_id", "period"]).crossJoin(F.broadcast(total.select("total_tau2")))  # one row
    w = F.try_divide(F.col("total_tau2"), F.col("total_tau2") + F.col("boot_se") * F.col("boot_se"))
    x = x.withColumn("posterior_sd", F.sqrt((1 - w) * F.col("total_tau2")))
    return x.withColumns({"posterior_low": F.col("adj_total") - z * F.col("posterior_sd"), "posterior_high": F.col("adj_total") + z * F.col("posterior_sd")}).drop("total_tau2")
