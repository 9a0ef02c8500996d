"""Registered queries: names, SQL for them, and one compared end to end."""

import importlib
import sys

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_survives_without_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("statloom.llm") or m in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "statloom.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert e.queries() and not any(n.startswith("op1_") for n in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["agg14_estimate_reliability", "win3_add_ratings", "tal3_rank_talent"])
def test_matches_duckdb(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    want = con.execute(e.oracle_sql()[name]).df()[got.columns]
    near = lambda x: None if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(map(near, r)) for r in got.toPandas().astype(object).values.tolist()), key=key) == sorted((tuple(map(near, r)) for r in want.astype(object).values.tolist()), key=key)


def test_imports_without_a_session():
    import subprocess

    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, timeout=120)
