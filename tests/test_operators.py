"""Edge cases of single operators on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from statloom.functions import scalars
from statloom.operators import facts, joins, league, rank, rates, reliability, scouting, shrink, snapshots, talent
from statloom.plans.params import COMPONENTS, Params


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rate_of_zero_exposure_is_null(spark):
    df = spark.createDataFrame([(1.0, 96.0), (2.0, 0.0), (3.0, 48.0)], "v double, m double")
    assert rows(df.select(scalars.per_exposure(F.col("v"), F.col("m"), 96.0))) == [(1.0,), (None,), (6.0,)]


def test_missing_component_blocks_total(spark):
    df = spark.createDataFrame([(1, 2000, c, 1.0, 1.0, 2) for c in COMPONENTS] + [(2, 2000, c, None if c == "a_f" else 1.0, 1.0, 2) for c in COMPONENTS], "entity_id long, period int, component string, value double, raw_value double, opps long")
    got = {r.entity_id: r for r in rates.add_totals(df, ["entity_id", "period"], 6).collect()}
    assert got[1].total_value == 6 and got[1].components_complete
    assert got[2].total_value is None and got[2].total_opps == 12 and not got[2].components_complete


def test_save_percentage_needs_shots(spark):
    df = spark.createDataFrame([(90.0, 0, 0, 0, 0.0), (90.0, 10, 3, 7, 2.5)], "exposure double, shots long, conceded long, saves long, expected double")
    got = rates.traditional(df, 96.0).collect()
    assert got[0].save_pct is None and got[1].save_pct == 70 and got[1].prevented == -0.5


@pytest.mark.parametrize("values,want", [([1.0, 2.0, 3.0, 4.0, 5.0], [10.0, 30.0, 50.0, 70.0, 90.0]), ([0.1, 0.2, 0.2, 0.9], [12.5, 50.0, 50.0, 87.5])])
def test_percentile_midpoints(spark, values, want):
    df = spark.createDataFrame([(i, 1, v, 1.0, True) for i, v in enumerate(values)], "i int, k int, v double, w double, pool boolean")
    got = rank.weighted_percentile(df, ["k"], "v", "w", "pool").orderBy("i").collect()
    assert [round(r.pct, 9) for r in got] == want


def test_percentile_outside_pool_and_without_weight(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 2.0, True), (1, 1, 2.0, 9.0, False), (2, 1, 3.0, 2.0, True), (3, 2, 1.0, 0.0, True), (4, 2, 5.0, 0.0, True), (5, 3, 4.0, 1.0, False), (6, 1, None, 1.0, True)], "i int, k int, v double, w double, pool boolean")
    assert [r.pct for r in rank.weighted_percentile(df, ["k"], "v", "w", "pool").orderBy("i").collect()] == [25.0, 50.0, 75.0, 25.0, 75.0, None, None]


def test_competition_rank(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (1, 1.0), (1, None)], "k int, v double")
    assert sorted((r[0] or 0, r[1] or 9) for r in rows(rank.competition_rank(df, ["k"], "v").select("v", "rank"))) == [(0, 9), (1.0, 3), (3.0, 1), (3.0, 1)]


def test_weight(spark):
    df = spark.createDataFrame([(0,), (100,), (200,), (None,), (-5,)], "n long")
    assert [round(r[0], 6) for r in rows(df.select(shrink.reliability_weight(F.col("n"), F.lit(100.0))))] == [0, 0.5, round(2 / 3, 6), 0, 0]


def test_workload_shrinkage_can_be_off(spark):
    df = spark.createDataFrame([(10.0, 0.0), (None, 0.0), (10.0, 100.0)], "rate double, k double")
    got = rows(df.select(shrink.shrink_workload(F.col("rate"), F.lit(100.0), F.col("k"), F.lit(4.0))))
    assert got == [(10.0,), (4.0,), (7.0,)]


def test_qualification_of_live_and_final(spark):
    p = Params(final_bars=(900.0, 360.0), live_shares=(0.5, 0.2), live=2001)
    season = spark.createDataFrame([(1, 2000, 3000.0), (2, 2000, 500.0), (3, 2000, 24.0), (1, 2001, 1600.0)], "entity_id long, period int, exposure double")
    bars = {r.period: r for r in shrink.qualification(season, p).collect()}
    assert bars[2000].qualified_bar == 900 and bars[2001].qualified_bar == 800 and bars[2001].provisional_bar == 320
    got = {(r.entity_id, r.period): r.status for r in shrink.sample_status(season, shrink.qualification(season, p)).collect()}
    assert [got[i, 2000] for i in (1, 2, 3)] == ["qualified", "provisional", "limited"]


def test_pool_is_everybody_when_nobody_reaches_it(spark):
    season = spark.createDataFrame([(1, 2000, 24.0), (2, 2000, 30.0)], "entity_id long, period int, exposure double")
    assert all(r.in_pool for r in shrink.sample_status(season, shrink.qualification(season, Params())).collect())


def test_within_variance_equals_two_passes(spark):
    data = [(e, 2000, m, "a_f", 0.1 * ((e * 7 + m * 3) % 11), 1 + (e + m) % 4) for e in range(5) for m in range(6)]
    df = spark.createDataFrame(data, "entity_id long, period int, event_id long, component string, value double, opps long")
    num = den = 0
    for e in range(5):
        own = [(v, n) for x, _, _, _, v, n in data if x == e]
        g = sum(v for v, _ in own) / sum(n for _, n in own)
        num += sum((v - n * g) ** 2 / n for v, n in own)
        den += len(own) - 1
    cube = reliability.moments(df.selectExpr("*", "event_id AS event_date", "90.0D AS exposure"), 96.0)
    got = reliability.within_variance(cube, 3).first()
    assert math.isclose(got.s2, num / den) and got.n_groups == 5 and got.n_matches == 30


def test_moments_of_matches_with_gaps(spark):
    """Odd and even matches by date among those with a value and opportunities; sums leave out what an estimator can't use."""
    data = [(3, 1.0, 2, 90.0), (1, 4.0, 1, 80.0), (2, None, 5, 70.0), (4, 8.0, 0, 60.0), (5, 16.0, 4, 0.0), (6, 32.0, None, 50.0)]  # date, value, opps, exposure
    df = spark.createDataFrame([(1, 2000, d, "a", v, n, d, e) for d, v, n, e in data], "entity_id long, period int, event_id long, component string, value double, opps long, event_date int, exposure double")
    r = reliability.moments(df, 10.0).first()
    assert (r.w_m, r.w_q, r.w_v, r.w_n) == (3, 0.5 + 16 + 64, 21.0, 7)
    assert (r.h_m, r.h_v1, r.h_n1, r.h_v2, r.h_n2) == (4, 4.0 + 8.0, 1, 1.0 + 16.0, 6)  # in order 1, 3, 4, 5
    rates = [(n / e * 10, e) for _, _, n, e in data if n is not None and e > 0]
    assert r.x_m == 4 and math.isclose(r.x_q, sum(x * x * e for x, e in rates)) and math.isclose(r.x_r, sum(x * e for x, e in rates)) and r.x_e == 300.0
    assert (r.value, r.opps) == (61.0, 12)


def test_new_entity_starts_at_the_prior(spark):
    totals = spark.createDataFrame([(i, 2000, 3000.0, 0.1 * i, 0.02) for i in range(1, 6)] + [(99, 2001, 90.0, 5.0, 30.0), (1, 2001, 3000.0, 1.0, 0.01)], "entity_id long, period int, exposure double, obs_total double, sampling_variance double")
    total = spark.createDataFrame([(0.04, 0.01, "empirical")], "total_tau2 double, total_drift double, total_source string")
    got = {r.entity_id: r for r in talent.current_talent(totals, total, Params()).collect()}
    assert got[99].prior_source == "new" and got[99].weight_prior == 0 and abs(got[99].talent - got[99].league_mean) < 0.2
    assert got[1].weight_live > got[1].weight_prior
    assert all(math.isclose(r.weight_league + r.weight_prior + r.weight_live, 1) for r in got.values())


def test_slugs(spark):
    df = spark.createDataFrame([("b", "Roman Bürki"), ("c", "André Blake"), ("a", "André Blake"), ("d", "!!!")], "id string, name string")
    got = dict(rows(facts.dedupe_slugs(df, "id", "name")))
    assert got == {"b": "roman-burki", "a": "andre-blake", "c": "andre-blake-c", "d": "entity"}


def test_age_on_leap_day(spark):
    df = spark.createDataFrame([("2000-02-29",), ("2000-02-28",)], "b string").select(F.to_date("b").alias("b"))
    assert rows(df.select(scalars.age_years(F.col("b"), F.lit("2025-02-28").cast("date")))) == [(24,), (25,)]


def test_stints_are_consecutive(spark):
    df = spark.createDataFrame([(1, d, t, 90.0) for d, t in enumerate("AABBA")], "e long, event_date int, team string, exposure double")
    got = facts.stints(df, ["e"], "team", ["event_date"]).orderBy("stint").collect()
    assert [(r.team, r.appearances) for r in got] == [("A", 2), ("B", 2), ("A", 1)]


def test_snapshot_change_and_movement(spark):
    a = spark.createDataFrame([(1, 5, 60.0)], "entity_id long, rank int, score double")
    b = spark.createDataFrame([(1, 2, 75.0), (2, 1, 80.0)], "entity_id long, rank int, score double")
    got = {r.entity_id: r for r in snapshots.rank_movement(b, a).collect()}
    assert (got[1].rank_change, got[1].score_change, got[2].rank_change) == (3, 15.0, None)


def test_equal_profiles_are_fully_similar(spark):
    p = spark.createDataFrame([(e, c, float(10 + i + 5 * (e == 3) * i)) for e in (1, 2, 3) for i, c in enumerate("abc")] + [(4, "a", 1.0)], "entity_id long, component string, pct double")
    got = dict(rows(scouting.cosine_to(p, p.filter("entity_id = 1"))))
    assert math.isclose(got[1], 1) and math.isclose(got[2], 1) and got[3] < 1 and 4 not in got


def test_fuzzy_join_equals_nested_loop(spark):
    roster = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo"), (3, "Xu Marin"), (4, "carl")], "roster_id long, roster_name string")
    names = spark.createDataFrame([(10, "Sven Leeson"), (11, "BOB"), (12, "Di Marino"), (13, "Carl"), (14, "ann lee")], "entity_id long, name string")
    assert set(rows(joins.fuzzy_name_join(roster, names))) == {(1, 10), (1, 14), (2, 11), (3, 12), (4, 13)}


def test_unparsable_numbers_are_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,), ("2.5",)], "t string")
    assert [r[0] for r in rows(df.select(scalars.parse_number(F.col("t"))))] == [1.5, None, None, None, None, 2.5]
    assert [r[0] for r in rows(df.select(scalars.parse_whole(F.col("t"))))] == [2, None, None, None, None, 2]


def test_current_team_is_that_of_the_last_stint(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "c"), (3, 1, "d"), (3, 2, None)], "k long, stint long, team string")
    assert sorted(rows(facts.current_team(df, ["k"], "team"))) == [(1, "a", 3, True), (2, "c", 1, False), (3, None, 2, True)]
    assert facts.current_team(df.limit(0), ["k"], "team").count() == 0


def test_projection_casts_and_fills_missing_columns(spark):
    df = spark.createDataFrame([(1, "2.5", "x")], "id int, v string, other string")
    out = facts.project(df, {"id": "bigint", "v": "double", "born": "date"}, version="1")
    assert out.dtypes == [("id", "bigint"), ("v", "double"), ("born", "date"), ("version", "string")] and rows(out) == [(1, 2.5, None, "1")]


def test_league_reference_places_the_average(spark):
    ratings = spark.createDataFrame([(1, 1.0, 1.0, 10.0, True), (1, 2.0, 3.0, 30.0, True), (1, 9.0, 9.0, 99.0, False), (1, None, 1.0, 5.0, True)], "period int, adj_total double, obs_total double, exposure double, in_pool boolean")
    ratings = ratings.withColumns({"conceded_rate": F.col("adj_total"), "save_pct": F.lit(50.0)})
    baseline = spark.createDataFrame([(1, "a", 0.5, 2.0, "period_pool"), (1, "b", 0.25, 2.0, "period_pool")], "period int, component string, mu double, league_workload double, baseline_source string")
    (r,) = league.league_reference(ratings, baseline).collect()
    assert (r.average_adjusted, r.average_score, r.pool_size, r.adj_median, r.obs_max) == (1.5, 25.0, 2, 1.5, 3.0)


def test_identity_is_of_the_live_period_first(spark):
    p = Params()
    seen = spark.createDataFrame([(1, p.final, "qualified"), (1, p.live, "limited"), (2, p.final, "provisional"), (2, p.final - 1, "limited")], "entity_id long, period int, status string")
    people = spark.createDataFrame([(1, "n1", "t1"), (2, "n2", "t2")], "entity_id long, name string, team string")
    out = talent.with_identity(spark.createDataFrame([(1,), (2,), (3,)], "entity_id long"), seen, people, p)
    assert sorted(rows(out)) == [(1, "limited", "n1", "t1"), (2, "provisional", "n2", "t2"), (3, None, None, None)]
