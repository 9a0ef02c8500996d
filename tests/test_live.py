from datetime import datetime

from pyspark.sql import functions as F

from statloom.streaming import live
from statloom.streaming.live import refreshed

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def test_part_files_and_batches_far_apart(spark, tmp_path):
    path = f"file://{tmp_path}/events.parquet"
    new = [(1, 7, datetime(2024, 1, 1), 1.0), (2, 7, datetime(2024, 1, 2), 2.0)]
    old = [(3, 7, datetime(2020, 1, 1), 4.0), (1, 7, datetime(2024, 1, 1), 1.0), (4, 8, datetime(2019, 1, 1), 8.0)]
    for rows in (new, old):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for per_batch in (1, 1000):
        assert sorted(map(tuple, refreshed(spark, path, per_batch).collect())) == [(7, 3, 7.0), (8, 1, 8.0)]


def test_a_single_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"event_id": [1, 1, 2], "user_id": [5, 5, 5], "ts": pa.array([datetime(2024, 1, 1)] * 3, pa.timestamp("us", "UTC")), "value": [1.0, 1.0, 2.0]}), f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in refreshed(spark, f"file://{tmp_path}/events.parquet").collect()] == [(5, 2, 3.0)]


def batch_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def direct(rows):
    """Standings by the rule: of an id the first batch's earliest row."""
    seen, out = {}, {}
    for batch in rows:
        for r in sorted(batch, key=lambda r: (r[2], r[1], r[3])):
            if r[0] not in seen:
                seen[r[0]] = r
    for _, user, _, value in seen.values():
        n, v = out.get(user, (0, 0.0))
        out[user] = n + 1, v + value
    return out


def test_changed_standings_equal_the_difference_of_whole_ones(spark, tmp_path):
    state, day = f"file://{tmp_path}/state", lambda d: datetime(2024, 1, d)
    batches = [
        [(1, 7, day(5), 1.0), (2, 7, day(6), 2.0), (3, 8, day(6), 4.0), (1, 7, day(5), 1.0)],
        [(4, 9, day(1), 8.0), (2, 7, day(6), 2.0)],  # an id again, and a late row of a new user
        [(1, 7, day(9), 99.0), (3, 8, day(6), 4.0)],  # nothing new
        [(5, 8, day(2), 16.0), (6, 8, day(2), 32.0), (6, 8, day(1), 64.0)],
    ]
    for k, rows in enumerate(batches):
        for _ in range(2 if k in (1, 3) else 1):  # run again, as after a failure
            live.merge(batch_of(spark, rows), k, state, compact_every=2)
        before, after = direct(batches[:k]), direct(batches[: k + 1])
        assert {r.user_id: (r.n, r.value) for r in live.standings(spark, state).collect()} == after
        assert {r.user_id: (r.n, r.value) for r in live.changes(spark, state, k).collect()} == {u: x for u, x in after.items() if before.get(u) != x}
    live.merge(batch_of(spark, batches[2]), 2, state, compact_every=2)  # an older batch again leaves the later ones as they are
    assert {r.user_id: (r.n, r.value) for r in live.standings(spark, state).collect()} == direct(batches)


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    path, state = f"file://{tmp_path}/events.parquet", f"file://{tmp_path}/state"
    first = [(1, 7, datetime(2024, 1, 1), 1.0), (2, None, datetime(2024, 1, 2), 2.0)]
    later = [(3, 7, datetime(2020, 1, 1), 4.0), (1, 7, datetime(2024, 1, 1), 1.0)]
    batch_of(spark, first).coalesce(1).write.parquet(path)
    live.refresh(spark, path, state)
    live.refresh(spark, path, state)
    assert {r.user_id: r.n for r in live.standings(spark, state).collect()} == {7: 1, None: 1}
    batch_of(spark, later).coalesce(1).write.mode("append").parquet(path)
    live.refresh(spark, path, state)
    assert {r.user_id: (r.n, r.value) for r in live.standings(spark, state).collect()} == {7: (2, 5.0), None: (1, 2.0)}
    last = live.standings(spark, state).agg(F.max("batch")).first()[0]
    assert [tuple(r) for r in live.changes(spark, state, last).collect()] == [(7, 2, 5.0)]


def test_a_run_that_is_tried_again_adds_nothing(spark, tmp_path):
    from statloom.operators.quality import append_run

    path = f"file://{tmp_path}/ledger"
    rows = lambda run, n: spark.createDataFrame([(run, i) for i in range(n)], "run int, i int")
    for run, n in ((1, 3), (2, 5), (2, 5), (1, 2)):  # the last one has fewer rows this time
        append_run(rows(run, n), path, "run")
    assert {r.run: r.n for r in spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 5}
