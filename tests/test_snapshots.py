import datetime as dt

import pytest
from pyspark.sql import functions as F

from statloom.operators import snapshots, talent
from statloom.plans.params import Params

DAY = dt.date(2024, 1, 1)


def entries(spark, rows, day=DAY):
    return spark.createDataFrame([(p, day, *r) for p, *r in rows], "period int, captured_at date, entity_id long, rank int, score double, rate double, exposure double")


def header(spark, rows, day=DAY, source="abc", version="1.0.0"):
    sources = spark.createDataFrame([(p, source, day) for p in {r[0] for r in rows}], "period int, source_fingerprint string, max_match_date date")
    return snapshots.headers(entries(spark, rows, day), sources, version)


ROWS = [(2024, 1, 1, 90.0, 0.2, 2000.0), (2024, 2, 2, 50.0, None, 900.0), (2023, 1, None, 10.0, 0.1, 90.5)]


def reason(spark, **other):
    now = header(spark, other.pop("rows", ROWS), dt.date(2024, 2, 1), **other)
    return {r.period: r.reason for r in snapshots.verdicts(header(spark, ROWS), now).collect()}


def test_the_three_rules(spark):
    assert reason(spark) == {2024: "unchanged", 2023: "unchanged"}
    assert reason(spark, rows=ROWS[::-1]) == {2024: "unchanged", 2023: "unchanged"}  # order is nothing
    assert set(reason(spark, source="abd").values()) == {"source"}
    assert set(reason(spark, version="1.0.1").values()) == {"methodology"}
    assert reason(spark, rows=[ROWS[0], (2024, 2, 3, 50.0, None, 900.0), ROWS[2]]) == {2024: "entries", 2023: "unchanged"}
    assert reason(spark, rows=[ROWS[0], ROWS[2]])[2024] == "entries"  # one removed
    assert reason(spark, rows=[*ROWS, ROWS[0]])[2024] == "entries"  # one twice
    assert reason(spark, rows=[*ROWS, (2025, 1, 1, 1.0, 1.0, 1.0)])[2025] == "first"
    assert not snapshots.snapshot_changed(header(spark, ROWS), header(spark, ROWS, dt.date(2024, 3, 1)))


def test_only_changed_snapshots_are_written_and_twice_is_once(spark, tmp_path):
    path, later = f"file://{tmp_path}/history", dt.date(2024, 2, 1)
    write = lambda rows, day, **k: {r.period: r.reason for r in snapshots.write_snapshot(entries(spark, rows, day), header(spark, rows, day, **k), path).collect()}
    assert write(ROWS, DAY) == {2024: "first", 2023: "first"}
    assert write(ROWS, later) == {2024: "unchanged", 2023: "unchanged"}
    moved = [(2024, 1, 2, 80.0, 0.2, 2000.0), ROWS[1], ROWS[2]]
    for _ in range(2):
        write(moved, later)
    rows = snapshots.read_history(spark, path, name="entries")
    assert sorted((r.period, str(r.captured_at), r.n) for r in rows.groupBy("period", "captured_at").agg(F.count("*").alias("n")).collect()) == [(2023, "2024-01-01", 1), (2024, "2024-01-01", 2), (2024, "2024-02-01", 2)]
    before, after = rows.filter(F.col("captured_at") == F.lit(DAY)), entries(spark, moved, later)
    judged = snapshots.verdicts(header(spark, ROWS), header(spark, moved, later))
    assert [tuple(r) for r in snapshots.changed_entries(before.select(after.columns), after, judged).collect()] == [(2024, 1, "altered")]
    assert {str(r.captured_at) for r in snapshots.read_history(spark, path, 1).filter("period = 2024").collect()} == {"2024-02-01"}


def test_talent_without_a_variance_says_so(spark):
    totals = spark.createDataFrame([(1, 2000, 0.1, 900.0, 0.01)], "entity_id long, period int, obs_total double, exposure double, sampling_variance double")
    total = spark.createDataFrame([(0.0, 0.0, "unavailable")], "total_tau2 double, total_drift double, total_source string")
    with pytest.raises(Exception, match="not identified"):
        talent.current_talent(totals, total, Params()).collect()
