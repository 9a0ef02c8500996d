"""Weighted percentiles, competition and average ranks, medians and running windows.

Everything that orders a whole period or metric rests on `positions`: rows are first summed per distinct value, the
values are dealt to tasks by range, and counts of the tasks give each its offset. So one period with all the rows is as
many tasks as any other input, and no window spans a period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.sources.payload import written

#: Sums nearer than this (beyond 1: this times the sum) differ by the order of their terms, and count as equal.
TIE = 1e-15


def _same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """`left` with the other columns of `right` where `cols` agree, nulls included."""
    other = right.select(*(F.col(c).alias(f"_r_{c}") for c in cols), *(c for c in right.columns if c not in cols))
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols))
    return left.join(other, on, how).drop(*(f"_r_{c}" for c in cols))


def positions(rows: DataFrame, keys: list[str], value: str, measures: dict[str, Column], near: Column | float | None = None) -> DataFrame:
    """(keys, value, m, m_upto, m_all for each measure m): its sum at a value, up to it in ascending order, and in its key.

    `value` may not be null; `keys` may. `measures` are aggregates. The table of distinct values is written to the
    shared folder, so that the ranges are cut once. Offsets have a row for each task and key in it.
    `near`: values of a key are one where each is nearer than that to the next (beyond 1: times the value); their
    measures, which may not be negative then, are those of all of them. 0 leaves a value alone."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.groupBy(*keys, value).agg(*(c.alias(m) for m, c in measures.items()))
    placed = written(sums.repartitionByRange(n, *keys, value).withColumn("_part", F.spark_partition_id()), "parquet")
    mine, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part", *keys).agg(*(F.sum(m).alias(f"_{m}") for m in measures))
    starts = starts.withColumns({f"{m}_all": F.sum(f"_{m}").over(mine) for m in measures} | {f"_b_{m}": F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)) for m in measures}).drop(*(f"_{m}" for m in measures))
    local = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"{m}_upto": F.sum(m).over(local) for m in measures})
    if near is not None:
        out, runs = _runs(out, placed, keys, value, near)
        starts = _same(starts, runs, ["_part", *keys], "inner")
    out = _same(out, starts, ["_part", *keys], "inner").withColumns({f"{m}_upto": F.col(f"{m}_upto") + F.col(f"_b_{m}") for m in measures})
    if near is not None:
        run = Window.partitionBy(*keys, F.when(F.col("_run") == F.col("_low"), F.col("_root")).otherwise(F.col("_run")))
        out = out.withColumns({m: F.sum(m).over(run) for m in measures} | {f"{m}_upto": F.max(f"{m}_upto").over(run) for m in measures})
    return out.select(*keys, value, *(c for m in measures for c in (m, f"{m}_upto", f"{m}_all")))


def _runs(out: DataFrame, placed: DataFrame, keys: list[str], value: str, near: Column | float) -> tuple[DataFrame, DataFrame]:
    """`out` with `_run`, the first value of the run of near ones within its task, and (_part, keys, _low, _root) for each task:
    its lowest value and the first value of the run that this is in, which may have begun some tasks before."""
    near = near if isinstance(near, Column) else F.lit(near)
    apart = lambda a, b: b - a >= near * F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1.0))
    v, local = F.col(value), Window.partitionBy("_part", *keys).orderBy(value)
    first = lambda df: df.withColumn("_first", F.when(F.coalesce(apart(F.lag(value).over(local), v), F.lit(True)), v))
    out = first(out).withColumn("_run", F.max("_first").over(local.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")
    ends = first(placed).groupBy("_part", *keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.max("_first").alias("_last"))
    before = lambda c: F.lag(c).over(Window.partitionBy(*keys).orderBy("_part"))
    begins = F.when(F.coalesce(apart(before("_high"), F.col("_low")), F.lit(True)), F.col("_low")).when(before("_last") != before("_low"), before("_last"))
    ends = ends.withColumn("_begins", begins).withColumn("_root", F.max("_begins").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    return out, ends.select("_part", *keys, "_low", "_root")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str = "pos") -> DataFrame:
    """`rows` with their number from 1 in `order` within `keys` (not null), as row_number gives it, without a task for a key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    placed = written(placed, "parquet").withColumn("_part", F.shiftright("_row", 33))
    starts = placed.groupBy("_part", *keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(starts, ["_part", *keys]).withColumn(out, F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_row", "_part", "_first", "_before")


def _pool_measures(weight: str, in_pool: str) -> dict[str, Column]:
    w = F.when(F.col(in_pool) & (F.col(weight) > 0), F.col(weight)).otherwise(0.0)
    return {"w": F.sum(w), "p": F.count_if(F.col(in_pool))}


def _percentile(x: str = "") -> Column:
    """(below + half of equal) / all of the pool's weight; of its rows where nothing weighs."""
    c = lambda n: F.col(f"{x}{n}")
    share = lambda m: F.try_divide(c(f"{m}_upto") - c(m) / 2, c(f"{m}_all"))
    return 100 * F.when(c("w_all") <= 0, share("p")).otherwise(share("w"))


def _competition(m: str, ascending: bool, x: str = "") -> Column:
    c = lambda n: F.col(f"{x}{n}")
    return 1 + (c(f"{m}_upto") - c(m) if ascending else c(f"{m}_all") - c(f"{m}_upto"))


def weighted_percentile(rows: DataFrame, keys: list[str], value: str, weight: str, in_pool: str, out: str = "pct", near: float | None = None) -> DataFrame:
    """(below + half of equal) / all * 100 of the pool's weight, for every row; rows outside the pool weigh nothing."""
    placed = positions(rows.filter(F.col(value).isNotNull()), keys, value, _pool_measures(weight, in_pool), near)
    return _same(rows, placed.select(*keys, value, _percentile().alias(out)), [*keys, value])


def competition_rank(rows: DataFrame, keys: list[str], value: str, out: str = "rank", ascending: bool = False, near: float | None = None) -> DataFrame:
    """Adds 1, 2, 2, 4; null for null."""
    placed = positions(rows.filter(F.col(value).isNotNull()), keys, value, {"n": F.count("*")}, near)
    return _same(rows, placed.select(*keys, value, _competition("n", ascending).alias(out)), [*keys, value])


def standings(rows: DataFrame, keys: list[str], ids: list[str], values: list[str], weight: str | None = None, in_pool: str | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `at_<value>`, a struct of each value's place among all of its key, from one pass for all values.

    Fields: n, n_upto, n_all (rows), and with a pool w and p likewise (its weight and rows). `ids` and `keys` name a row.
    Of the values, those in `sums` are ties where they differ by no more than the order of their terms."""
    numbers = F.array(*(F.struct(F.lit(v).alias("_metric"), F.col(v).cast("double").alias("_v")) for v in values))
    extra = [c for c in (weight, in_pool) if c]
    long = rows.select(*dict.fromkeys([*keys, *ids, *extra]), F.explode(numbers).alias("_x")).select("*", "_x.*").drop("_x").filter("_v IS NOT NULL")
    measures = {"n": F.count("*")} | (_pool_measures(weight, in_pool) if weight else {})
    placed = positions(long, [*keys, "_metric"], "_v", measures, F.when(F.col("_metric").isin(*sums), TIE).otherwise(0.0) if sums else None)
    fields = [f"{m}{s}" for m in measures for s in ("", "_upto", "_all")]
    joined = _same(long.select(*dict.fromkeys([*keys, *ids]), "_metric", "_v"), placed, [*keys, "_metric", "_v"], "inner")
    names = list(dict.fromkeys([*keys, *ids]))
    wide = joined.groupBy(*names).agg(*(F.first(F.when(F.col("_metric") == v, F.struct(*fields)), ignorenulls=True).alias(f"at_{v}") for v in values))
    return _same(rows, wide, names)


def percentile_of(value: str) -> Column:
    return _percentile(f"at_{value}.")


def rank_of(value: str, ascending: bool = False, pool: bool = False) -> Column:
    return _competition("p" if pool else "n", ascending, f"at_{value}.")


def average_rank_of(value: str) -> Column:
    """Mean rank of ties, as Spearman's correlation wants it."""
    return F.col(f"at_{value}.n_upto") - (F.col(f"at_{value}.n") - 1) / 2


def average_rank(rows: DataFrame, keys: list[str], ids: list[str], value: str, out: str = "r") -> DataFrame:
    return standings(rows, keys, ids, [value]).withColumn(out, average_rank_of(value)).drop(f"at_{value}")


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, median_<value>): exact medians of values that are not null, by selection from counts of distinct values."""
    numbers = F.array(*(F.struct(F.lit(v).alias("_metric"), F.col(v).cast("double").alias("_v")) for v in values))
    long = rows.select(*keys, F.explode(numbers).alias("_x")).select(*keys, "_x.*").filter("_v IS NOT NULL")
    placed = positions(long, [*keys, "_metric"], "_v", {"n": F.count("*")})
    reach = lambda k: F.min(F.when(F.col("n_upto") >= k, F.col("_v")))
    middle = (reach(F.floor((F.col("n_all") + 1) / 2)) + reach(F.floor(F.col("n_all") / 2) + 1)) / 2
    each = placed.groupBy(*keys, "_metric").agg(middle.alias("_m"))
    return each.groupBy(*keys).agg(*(F.first(F.when(F.col("_metric") == v, F.col("_m")), ignorenulls=True).alias(f"median_{v}") for v in values))


def add_ratings(totals: DataFrame, traditional: DataFrame) -> DataFrame:
    """Score, full ranks, pool ranks and rank disagreement per entity and period; totals nearer than TIE to the next are ties."""
    x = totals.join(traditional.select("entity_id", "period", "conceded_rate", "save_pct"), ["entity_id", "period"])
    x = standings(x, ["period"], ["entity_id"], ["adj_total", "obs_total", "conceded_rate", "save_pct"], "exposure", "in_pool", ("adj_total", "obs_total"))
    pool = lambda v, asc: F.when(F.col("in_pool"), rank_of(v, asc, pool=True))
    x = x.withColumns({
        "score": percentile_of("adj_total"), "observed_pct": percentile_of("obs_total"),
        "rank_adjusted": rank_of("adj_total"), "rank_observed": rank_of("obs_total"), "rank_conceded": rank_of("conceded_rate", True), "rank_save_pct": rank_of("save_pct"),
        "rank_conceded_pool": pool("conceded_rate", True), "rank_adjusted_pool": pool("adj_total", False), "rank_observed_pool": pool("obs_total", False),
    })
    return x.drop("at_adj_total", "at_obs_total", "at_conceded_rate", "at_save_pct").withColumn("rank_disagreement", F.col("rank_conceded_pool") - F.col("rank_adjusted_pool"))


def match_form(matches: DataFrame, keys: list[str], order: list[str], basis: float, window: int = 5) -> DataFrame:
    """Running totals and rate, mean rate and exposure-weighted rate of the last `window` matches."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - window, 0)
    v, e = F.coalesce("value", F.lit(0.0)), F.col("exposure")
    positive = lambda x: F.when(x > 0, x)
    return matches.withColumns({
        "match_no": F.row_number().over(w), "cum_value": F.sum(v).over(run), "cum_exposure": F.sum(e).over(run), "cum_rate": F.sum(v).over(run) / positive(F.sum(e).over(run)) * basis,
        "rolling_mean": F.avg(F.col("value") / positive(e) * basis).over(last), "rolling_weighted": F.sum(v).over(last) / positive(F.sum(e).over(last)) * basis,
    })
