import numpy as np
from pyspark.sql import functions as F

from statloom.llm import topk


def brute(rows, k, every):
    """Every row that is a query against every row but itself and those of other lengths."""
    out = []
    for own, (qid, q) in enumerate(rows):
        if q is None or qid is None or qid % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(q, x)), i) for j, (i, x) in enumerate(rows) if j != own and x is not None and len(x) == len(q)), key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
        out += [(qid, r, i, s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out, key=str)


def test_matches_brute_force_with_ties_and_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(400)] + [(8, [1, 2, 3, 1, 2, 3]), (41, [0] * 6), (41, [0] * 6)]
    # a query id twice with other vectors, one three times with the same, null ids, another length
    rows += [(40, [9] * 6), *[(60, [9, 0, 9, 0, 9, 0])] * 3, (None, [9] * 6), (None, [9] * 6), (100, [3, 2]), (80, [1, 1]), (7, [5, -1])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(df, F.col("id") % 20 == 0, 5, least_block=45, most_block=90)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5, 20)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0, 5).count() == 0
    clashing = df.selectExpr("id AS vec_id", "cast(v AS array<float>) AS embedding", "'x' AS id", "'y' AS v", "1 AS rank")
    assert topk.top_k(topk.quantized(clashing, 1), F.col("id") % 20 == 0, 5).count() == len(brute(rows, 5, 20))


def test_exact_beyond_doubles():
    big = np.array([[2**40, 1], [2**40, 2], [2**40, 3]], np.int64)
    block = topk.Block(np.array([1, 2, 3]), big, [np.zeros(2)])
    ((best, scores),) = block.best(np.array([[2**20, 1]], np.int64), 2, np.array([topk.LEAST]))
    assert block.ids[best].tolist() == [3, 2] and scores.tolist() == [2**60 + 3, 2**60 + 2]


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [0.5, 0.25]), (1, [1.0, float("nan")]), (2, None), (3, [1.0, None]), (4, [float("inf"), 1.0]), (5, [0.1, -0.1]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.id: r.v for r in topk.quantized(df).collect()} == {0: [32, 16], 5: [6, -7], 6: [64]}
    assert topk.quantized(df.limit(0)).count() == 0
    got = topk.top_k(topk.quantized(df), F.col("id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 32 * 6 - 16 * 7)]


def test_far_blocks_are_skipped_and_nothing_is_lost(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 301, (12, 8))
    rows = [(i, (centres[i % 12] + rng.integers(-4, 5, 8)).tolist()) for i in range(600)] + [(700 + i, centres[0].tolist()) for i in range(300)]
    rows += [(1000, [2**40] * 8), (1020, [-(2**40)] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(df, F.col("id") % 20 == 0, 5, least_block=20, most_block=20)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in clamped(rows)), key=str)


def clamped(rows):
    """As `brute`, but ranked by scores cut to 64 bits."""
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    for own, (qid, q) in enumerate(rows):
        if qid % 20 == 0:
            scored = sorted(((cut(sum(a * b for a, b in zip(q, x))), i) for j, (i, x) in enumerate(rows) if j != own), key=lambda s: (-s[0], s[1]))[:5]
            yield from ((qid, r, i, s) for r, (s, i) in enumerate(scored, 1))


def test_ranges_send_queries_to_few_blocks():
    pivots = [np.array([0.0, 0.0]), np.array([1000.0, 0.0])]
    x = np.array([[3, 4], [900, 10], [905, 0]], float)
    d = topk.distances(x, pivots)
    assert np.allclose(d[0], [5, np.hypot(900, 10), 905])
    import pyarrow as pa

    ranges = pa.table({"block": pa.array([0, 1], pa.int32()), "most": [25.0, 905.0**2], "shortest": pa.array([2, 2], pa.int32()), "longest": pa.array([2, 2], pa.int32()), **{f"low{p}": [d[p][0], d[p][1:].min()] for p in (0, 1)}, **{f"high{p}": [d[p][0], d[p][1:].max()] for p in (0, 1)}})
    query = lambda least: pa.RecordBatch.from_pydict({"block": pa.array([1], pa.int32()), "id": [7], "v": [[900, 10]], "least": pa.array([least], pa.int64()), "d": [d[:, 1].tolist()], "square": [900.0**2 + 100], "size": pa.array([2], pa.int32())})
    run = topk.Ranges(ranges, 2).reach
    assert sum(b.num_rows for b in run([query(100_000)])) == 0
    assert sum(b.num_rows for b in run([query(None)])) == 1
