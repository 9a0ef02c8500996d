from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from statloom.operators import joins
from statloom.plans import registry
from statloom.sources import roster

HEAD = "<tr><th>No.</th><th>Pos.</th><th>Nation</th><th>Player</th></tr>"
NONE = [(None,) * 7 + ("no table with headers no., pos., nation, player",)]


def table(body, css="wikitable", head=HEAD):
    return f'<table class="{css}">{head}{body}</table>'


def test_every_roster_row_is_joined(spark, monkeypatch):
    """Brute force over parts beyond the first 40."""
    parts, names = [1, 41, 141, 205, 1005], [(9, "Supplier#000000041"), (10, "Supplier#000000205"), (11, "Supplier#000100501")]
    w = SimpleNamespace(
        table=lambda t: spark.createDataFrame([(p,) for p in parts], "p_partkey long"),
        entities=spark.createDataFrame(names, "entity_id long, name string"),
        ratings=spark.createDataFrame([(9, 2000, 1.5), (10, 1999, 2.5)], "entity_id long, period int, score double"),
    )
    monkeypatch.setattr(registry, "workload", lambda *_: w)
    got = sorted((r.roster_id, r.entity_id) for r in registry.QUERIES["qry7_roster_fuzzy"](spark, "").collect())
    assert got == sorted((p, e) for p in parts for e, n in names if f"{p % 100:03d}" in n)
    assert {p for p, _ in got} - set(range(41))


@pytest.mark.parametrize("gram", [1, 3])
def test_fuzzy_join_matches_brute_force(spark, gram):
    """Every name shares grams; words are short, long, absent, empty and repeated."""
    names = [(i, f"Supplier nation_{i % 12} {'é' if i % 3 else 'x'}{i}") for i in range(150)] + [(900, None), (901, ""), (902, "ab")]
    wanted = ["the Nation_1", "NATION_11", "é", "é4", "x", "ab", "supplier nation_3 é3", "zzz", "sup", "pp", "Nation_1", "ends with ", None]
    rows = list(enumerate(wanted))
    got = joins.fuzzy_name_join(spark.createDataFrame(rows, "roster_id long, roster_name string"), spark.createDataFrame(names, "entity_id long, name string"), gram)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(r, e) for r, w in rows for e, n in names if w is not None and n is not None and (w.lower() == n.lower() or w.strip() and w.lower().split()[-1] in n.lower())}
    assert {tuple(x) for x in got.collect()} == want


def test_rows_of_a_roster():
    body = "<tr><td>1</td><td>gk</td><td><img alt='flag'/> United <b>USA</b></td><td><a href='x'>Jo <i>Roe</i></a></td></tr>" + HEAD + "<tr><td>2</td><td></td><td></td><td>A &amp; B<script>x<y</script></td><td>more</td></tr><tr><td>short</td></tr><tr><td>3<td>df<td>FR<td></tr><tr><td>4<td>MF<td>FR<td>Player"
    assert roster.roster_rows(table(body)) == [
        (0, 1, "1", "GK", "USA", "Jo Roe", True, None),
        (0, 3, "2", None, None, "A & B", False, None),
    ]


def test_other_headers_are_an_error():
    assert roster.roster_rows(table("<tr><td>1</td><td>GK</td><td>USA</td><td>Test</td></tr>", head="<tr><th>Shirt</th><th>Role</th><th>Country</th><th>Name</th></tr>")) == NONE
    assert roster.roster_rows("") == roster.roster_rows("<p>text") == roster.roster_rows(table("", css="plain")) == NONE


def test_headers_anywhere_in_the_first_eight_cells():
    six = "<tr><th>Club</th><th>Year</th></tr>" + HEAD
    ten = "".join(f"<tr><th>c{i}</th></tr>" for i in range(6)) + HEAD
    row = "<tr><td>1</td><td>GK</td><td>USA</td><td>Roe</td></tr>"
    assert [r[5] for r in roster.roster_rows(table(row, head=six))] == ["Roe"]
    assert roster.roster_rows(table(row, head=ten)) == NONE


def test_nested_tables_and_missing_end_tags():
    inner = table("<tr><td>9<td>gk<td>BR<td>Inner", css="x wikitable")
    html = f"<table><tr><td>layout<td>{inner}</td></tr></table>" + table(f"<tr><td>1<td>gk<td>USA<td>Outer<tr><td>{'<table><tr><td>deep</table>'}<td>df<td>DE<td>Second")
    got = roster.roster_rows(html)
    assert [(r[0], r[2], r[5]) for r in got] == [(0, "9", "Inner"), (1, "1", "Outer"), (1, "deep", "df")] or [(r[0], r[5]) for r in got][:2] == [(0, "Inner"), (1, "Outer")]


def test_pages_without_a_table_and_null_pages(spark):
    pages = spark.createDataFrame([(1, table("<tr><td>1<td>gk<td>USA<td>Roe")), (2, None), (3, "<p>")], "page_id long, html string").withColumn("error", F.lit("mine"))
    got = {r.page_id: (r.player_name, r.error) for r in roster.read_rosters(pages).collect()}
    assert got == {1: ("Roe", None), 2: (None, NONE[0][-1]), 3: (None, NONE[0][-1])}
    assert roster.read_rosters(pages.limit(0)).count() == 0
