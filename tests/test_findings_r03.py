"""Ties of sums in another order, whole fuzzy joins without a shuffle of the result, and tasks that grow with the input."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import joins, quality, rank, talent
from statloom.plans import registry, workload

SF = "/root/testdata/sf0.001"


def test_totals_summed_in_another_order_tie(spark):
    totals = spark.createDataFrame([(1, 2000, 0.1 + 0.2, 0.1 + 0.2), (2, 2000, 0.3, 0.3), (3, 2000, 0.1, 0.1)], "entity_id long, period int, adj_total double, obs_total double").withColumns({"exposure": F.lit(1.0), "in_pool": F.lit(True)})
    old = spark.createDataFrame([(i, 2000, float(i), 50.0) for i in (1, 2, 3)], "entity_id long, period int, conceded_rate double, save_pct double")
    got = {r.entity_id: r for r in rank.add_ratings(totals, old).collect()}
    assert [got[i].rank_adjusted for i in (1, 2, 3)] == [got[i].rank_observed for i in (1, 2, 3)] == [got[i].rank_adjusted_pool for i in (1, 2, 3)] == [1, 1, 3]
    assert got[1].score == got[2].score and got[1].observed_pct == got[2].observed_pct and got[1].adj_total == 0.1 + 0.2


def test_talents_summed_in_another_order_tie(spark):
    rows = [(1, 0.1 + 0.2), (2, 0.3), *((i, -float(i)) for i in range(3, 15))]
    t = spark.createDataFrame([(i, v, v - 1, v + 1, 1.0, True) for i, v in rows], "entity_id long, talent double, talent_low double, talent_high double, evidence_exposure double, in_live boolean")
    got = {r.entity_id: r for r in talent.rank_talent(t).collect()}
    assert (got[1].talent_rank, got[2].talent_rank, got[3].talent_rank) == (1, 1, 3) and got[1].talent_pct == got[2].talent_pct and got[1].talent == 0.1 + 0.2


def test_a_difference_of_just_the_tolerance_is_no_breach(spark):
    season = spark.createDataFrame([(1, 2000, 1.0, 0), (2, 2000, 1.0, 0)], "entity_id long, period int, expected double, conceded long")
    feed = spark.createDataFrame([(1, 2000, "x", 1.05), (2, 2000, "x", 1.051)], "entity_id long, period int, component string, raw_value double")
    assert abs(1.05 - 1.0) > 0.05 and quality.reconcile_feeds(feed, season, "x").first().breaches == 1


def test_fuzzy_pairs_of_many_blocks(spark, monkeypatch):
    """Classes of many members, ids with several names, blank names, and columns that come along; the pairs are not shuffled."""
    monkeypatch.setattr(joins, "BLOCK", 3)
    rng = random.Random(5)
    roster = [(i % 60, f"any {rng.choice(['00', '1', 'b2', 'zz'])}") for i in range(90)] + [(70, " "), (71, ""), (71, "x 1"), (None, "x b2"), (72, None), (73, "N 1")]
    names = [(i, f"n {i:03d}b2", float(i)) for i in range(40)] + [(50, "n 1", None), (51, " ", 2.0), (52, None, 1.0)]
    got = joins.fuzzy_name_join(spark.createDataFrame(roster, "roster_id long, roster_name string"), spark.createDataFrame(names, "entity_id long, name string, score double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and "HashAggregate" not in plan[: plan.index("Generate")]
    want = {(r, e, s) for r, w in roster for e, n, s in names if w is not None and n is not None and (w.lower() == n.lower() or w.strip() and w.lower().split()[-1] in n.lower())}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_roster_query_rounds_before_pairs_are_made(spark, monkeypatch):
    w = SimpleNamespace(
        table=lambda t: spark.createDataFrame([(41,), (141,)], "p_partkey long"), entities=spark.createDataFrame([(9, "Supplier#000000041")], "entity_id long, name string"),
        ratings=spark.createDataFrame([(9, 2000, 1.123456789)], "entity_id long, period int, score double"),
    )
    monkeypatch.setattr(registry, "workload", lambda *_: w)
    got = registry.QUERIES["qry7_roster_fuzzy"](spark, "")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan[: plan.index("Exchange")]
    assert sorted(map(tuple, got.collect())) == [(41, 9, 1.12345679), (141, 9, 1.12345679)]


def test_silhouette_query_is_euclidean(spark):
    w = workload.workload(spark, SF)
    z, c = w.z.orderBy("entity_id", "component").collect(), {r.entity_id: r.cluster for r in w.clusters.collect()}
    ids = sorted(c)
    x, own = np.array([r.z for r in z]).reshape(len(ids), -1), np.array([c[i] for i in ids])
    s = []
    for i in range(len(ids)):
        d, mine = np.sqrt(((x - x[i]) ** 2).sum(1)), own == own[i]
        a, b = d[mine].sum() / max(1, mine.sum() - 1), min((d[own == k].mean() for k in set(own) - {own[i]}), default=None)
        s.append(0.0 if mine.sum() == 1 or b is None else (b - a) / max(a, b))
    assert abs(registry.QUERIES["clu3_silhouette"](spark, SF).first().silhouette - np.mean(s)) < 1e-7 and "sqrt(sum((p.z" in registry.ORACLE["clu3_silhouette"]


@pytest.mark.parametrize("rows", [500, 100])
def test_tasks_of_facts_grow_with_the_input(spark, monkeypatch, rows):
    monkeypatch.setattr(workload, "ROWS_A_TASK", rows)
    w = workload.Workload(spark, SF)
    n = w.table("lineitem").count()
    assert w.tasks == -(-n // rows) > 4
    sizes = [r["count"] for r in w.facts.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > n // rows // 2 and max(sizes) < 4 * rows
    placed = w.facts.select("entity_id", "period", F.input_file_name().alias("f")).distinct()
    spread = placed.groupBy("entity_id", "period").count().agg(F.avg("count")).first()[0]
    assert spread < n / rows / 4  # an entity's period lies in few files
    assert "Exchange" not in w.match_totals._jdf.queryExecution().executedPlan().toString()


def test_tables_are_written_in_partitions_that_grow_with_the_input(spark, monkeypatch):
    """Totals, ratings and percentiles, and the ranges of ranks, have as many tasks as facts; the session keeps its own number."""
    seen, key = [], "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    monkeypatch.setattr(workload, "ROWS_A_TASK", 500)
    real = rank.positions
    monkeypatch.setattr(rank, "positions", lambda rows, *a: seen.append(int(spark.conf.get(key))) or real(rows, *a))
    workload.reset()
    try:
        assert registry.QUERIES["win4_rank_among"](spark, SF).count() > 0
        w = workload.workload(spark, SF)
        assert seen and set(seen) == {w.tasks} and w.tasks > int(before)
    finally:
        workload.reset()
    assert spark.conf.get(key) == before
