"""Ties of totals by their neighbours, and joins whose pairs outgrow their tables."""

import random

import pytest
from pyspark.sql import functions as F

from statloom.operators import joins, rank, talent


def rated(spark, totals):
    rows = spark.createDataFrame([(i, 2000, v, v) for i, v in enumerate(totals)], "entity_id long, period int, adj_total double, obs_total double").withColumns({"exposure": F.lit(1.0), "in_pool": F.lit(True)})
    old = spark.createDataFrame([(i, 2000, float(i), 50.0) for i in range(len(totals))], "entity_id long, period int, conceded_rate double, save_pct double")
    return [r for r in rank.add_ratings(rows, old).orderBy("entity_id").collect()]


def test_totals_that_differ_by_little_are_no_ties(spark):
    a, b, c = rated(spark, [0.0123, 0.0123 + 2e-13, 0.0123 - 2e-13])
    assert [x.rank_adjusted for x in (a, b, c)] == [x.rank_observed for x in (a, b, c)] == [x.rank_adjusted_pool for x in (a, b, c)] == [2, 1, 3]
    assert b.score > a.score > c.score


def test_equal_totals_tie_wherever_their_digits_end(spark):
    at = 0.1234567890125  # rounding to 12 digits parts the doubles beside it
    got = rated(spark, [at - 2e-17, at + 2e-17, at + 3e-17, 0.1])
    assert [x.rank_adjusted for x in got] == [x.rank_observed for x in got] == [1, 1, 1, 4]
    assert len({x.score for x in got}) == 2


def test_talents_that_differ_by_little_are_no_ties(spark):
    rows = [(1, 0.0123 + 2e-13), (2, 0.0123), (3, 0.0123 + 1e-17), *((i, -float(i)) for i in range(4, 15))]
    t = spark.createDataFrame([(i, v, v - 1, v + 1, 1.0, True) for i, v in rows], "entity_id long, talent double, talent_low double, talent_high double, evidence_exposure double, in_live boolean")
    got = {r.entity_id: r for r in talent.rank_talent(t).collect()}
    assert [got[i].talent_rank for i in (1, 2, 3, 4)] == [1, 2, 2, 4] and got[1].talent_pct > got[2].talent_pct == got[3].talent_pct


@pytest.mark.parametrize("parts", ["1", "5", "23"])
def test_runs_of_near_values_across_tasks(spark, parts):
    """Runs that end where a task does, go on in the next ones or fill some, with keys that are null and values of every size."""
    rng, key = random.Random(7), "spark.sql.shuffle.partitions"
    values = {None: [0.5 + i * 2.0**-53 for i in range(40)] + [0.7, 0.7 + 4e-15], "a": [0.1, 0.2, 0.2 + 3e-17, -0.2, 1e9, 1e9 + 2.0**-23, 1e9 + 2.0**-18, float("inf"), float("nan")] + [x for i in range(30) for x in (i / 7, i / 7 + 5e-16)]}
    rows = [(k, v, rng.randint(0, 3)) for k, vs in values.items() for v in vs for _ in range(2)]
    before = spark.conf.get(key)
    spark.conf.set(key, parts)
    try:
        got = rank.positions(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", {"n": F.sum("n")}, rank.TIE).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == sum(len(set(vs)) for vs in values.values())
    for k in values:
        order = sorted({v for x, v, _ in rows if x == k and v == v}) + ([float("nan")] if k else [])
        runs = []
        for v in order:
            last = runs[-1][-1] if runs else None
            runs[-1].append(v) if runs and v - last < rank.TIE * max(min(abs(v), abs(last)), 1) else runs.append([v])
        upto = 0
        for run in runs:
            mine = sum(n for x, v, n in rows if x == k and str(v) in map(str, run))
            upto += mine
            found = [r for r in got if r.k == k and str(r.v) in map(str, run)]
            assert len(found) == len(run) and all((r.n, r.n_upto, r.n_all) == (mine, upto, sum(n for x, _, n in rows if x == k)) for r in found)


def test_pairs_of_blocks_are_few_rows(spark):
    """Generated code holds all rows of a pair of blocks, so a pair is some ten thousand rows, however large its class."""
    members = spark.range(3000).select(F.col("id").alias("roster_id"), F.array(F.lit("x")).alias("class"))
    met = spark.range(2000).select(F.array(F.lit("x")).alias("class"), F.col("id").alias("entity_id"), F.lit(1.5).alias("score"))
    rows = F.size("_m") * F.size("_e")
    most, all_rows = joins._block_pairs(members, met).agg(F.max(rows), F.sum(rows)).first()
    assert most < 50_000 and all_rows == 3000 * 2000
    assert joins._expanded(members, met).agg(F.count("*"), F.sum("roster_id"), F.sum("entity_id")).first() == (6_000_000, 2000 * 4_498_500, 3000 * 1_999_000)
