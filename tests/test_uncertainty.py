"""Bootstrap queries against DuckDB, and their number of resamples."""

import math

import duckdb
import numpy as np
import pytest

from statloom.operators import uncertainty
from statloom.plans.params import DEFAULT

SF = "/root/testdata/sf0.001"


def test_as_many_resamples_as_the_reference():
    assert DEFAULT.resamples == 2000


@pytest.mark.parametrize("name", ["unc1_bootstrap_rate", "unc2_posterior_interval", "unc4_bootstrap_mean"])
def test_intervals_match_duckdb(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    want = {r[:2]: r[2:] for r in con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()}
    have = {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()}
    assert have.keys() == want.keys() and have
    for key, row in have.items():
        assert row == pytest.approx(want[key], abs=2e-8, nan_ok=True), key


def test_draws_are_the_plain_ones_and_few_are_held_at_once():
    """rounds by halves of a word give what % gives, negative and large numbers too, in a few MB."""
    import tracemalloc

    for n in (2, 7, 80, 70_000):
        for entity, period, seed in ((5, 2000, 20260101), (10**9, 2001, 20260101), (-40_000, 1999, 3), (0, 0, 0), (2**31 - 1, 0, 0)):
            x = [[int(math.fmod(entity * 69621 + period * 7919 + b * 1000003 + i * 48271 + seed, uncertainty.PRIME)) for i in range(min(n, 90))] for b in (0, 1, 1999)]
            for r in (1, 2, 3):
                x = [[(y * y + 12345 + 777 * r) % uncertainty.PRIME for y in row] for row in x]
            assert uncertainty.draws(entity, period, np.array([0, 1, 1999]), n, seed)[:, :90].tolist() == [[y % n for y in row] for row in x]
    tracemalloc.start()
    uncertainty.draws(5, 2000, np.arange(uncertainty.CELLS // 80), 80, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
