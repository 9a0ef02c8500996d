"""Distributed ranks against brute force, with one key that holds nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from statloom.operators import rank


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, "hot" if i % 50 else f"k{i % 3}", rng.choice([None, -0.0, 0.0, 1.5, float(rng.randrange(400)), rng.random()]), rng.choice([0.0, 1.0, 2.5]), rng.random() < 0.7) for i in range(4000)]
    data += [(9000 + i, None, float(i % 3), 1.0, True) for i in range(7)] + [(9100, "dry", 1.0, 0.0, True), (9101, "dry", 2.0, 0.0, True), (9102, "out", 3.0, 1.0, False)]
    return data


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, k string, v double, w double, pool boolean").repartition(7)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_ranks_of_a_hot_key(spark, rows, frame):
    got = {r.i: r for r in rank.standings(frame, ["k"], ["i"], ["v"]).withColumns({"down": rank.rank_of("v"), "up": rank.rank_of("v", True), "mean": rank.average_rank_of("v")}).collect()}
    assert len(got) == len(rows)
    for k, own in groups(rows).items():
        values = sorted(r[2] for r in own if r[2] is not None)
        above, upto = {}, {}
        for n, v in enumerate(values):
            above.setdefault(v, n)
            upto[v] = n + 1
        for i, _, v, *_ in own:
            want = (None, None, None) if v is None else (len(values) - upto[v] + 1, above[v] + 1, (above[v] + 1 + upto[v]) / 2)
            assert (got[i].down, got[i].up, got[i].mean) == want, (k, v)


def test_no_window_spans_a_key(frame):
    """Rows of one key meet in no task: the only windows are by task and key, or over the counts of tasks."""
    for out in (rank.weighted_percentile(frame, ["k"], "v", "w", "pool"), rank.competition_rank(frame, ["k"], "v"), rank.standings(frame, ["k"], ["i"], ["v"], "w", "pool")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("_part" in line or "_n" in line or "_w" in line or "_p" in line for line in windows)


def test_weighted_percentiles(rows, frame):
    got = {r.i: r.pct for r in rank.weighted_percentile(frame, ["k"], "v", "w", "pool").collect()}
    for own in groups(rows).values():
        pool = [(r[2], r[3]) for r in own if r[4] and r[2] is not None]
        if not sum(w for _, w in pool):
            pool = [(v, 1) for v, _ in pool]
        total = sum(w for _, w in pool)
        for i, _, v, *_ in own[:200]:
            want = None if v is None or not total else 100 * (sum(w for x, w in pool if x < v) + sum(w for x, w in pool if x == v) / 2) / total
            assert got[i] == want or abs(got[i] - want) < 1e-9


def test_medians_by_selection(rows, frame):
    import statistics

    got = {r.k: (r.median_v, r.median_w) for r in rank.medians(frame, ["k"], ["v", "w"]).collect()}
    for k, own in groups(rows).items():
        values = [r[2] for r in own if r[2] is not None]
        assert got[k] == (statistics.median(values) if values else None, statistics.median(r[3] for r in own))


def test_numbered_like_row_number(rows, frame):
    some = frame.filter("k IS NOT NULL")
    got = {r.i: r.pos for r in rank.numbered(some, ["k"], [F.col("v").desc_nulls_last(), F.col("i")]).collect()}
    for k, own in groups(rows).items():
        if k is not None:
            order = sorted(own, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
            assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    assert rank.numbered(some.limit(0), [], [F.col("i")]).count() == 0
