"""Each predicate and null rule of the serving layer, notes, quality checks."""

import pytest
from pyspark.sql import functions as F

from statloom.operators import archetypes, joins, quality, serving, snapshots
from statloom.plans.params import DEFAULT

COLUMNS = "entity_id long, name string, team string, status string, exposure double, total_reliability double, a_f double, n_o double, age int, archetype string, similarity double"
BASE = (1, "Ann Base", "Reds", "qualified", 3000.0, 0.6, 80.0, 40.0, 30, "High a_f", 0.95)


def board(spark, **changes):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    other = dict(zip(names, BASE)) | {"entity_id": 2} | changes
    return spark.createDataFrame([BASE, tuple(other[n] for n in names)], COLUMNS)


def ids(df):
    return sorted(r.entity_id for r in df.collect())


BRIEF = dict(query="ann", min_exposure=900, min_reliability=0.3, min_pct={"a_f": 50, "n_o": 10}, min_age=20, max_age=35, archetype="High a_f")


@pytest.mark.parametrize(
    "changes",
    [dict(name="Bo"), dict(status="limited"), dict(exposure=800.0), dict(exposure=None), dict(total_reliability=0.2), dict(total_reliability=None), dict(a_f=49.0), dict(a_f=None), dict(n_o=9.0), dict(age=19), dict(age=36), dict(age=None), dict(archetype="Balanced"), dict(archetype=None)],
)
def test_each_predicate_of_a_brief_drops_its_row(spark, changes):
    assert ids(serving.brief_filters(board(spark, **changes), **BRIEF)) == [1]
    assert ids(serving.brief_filters(board(spark), **BRIEF)) == [1, 2]


def test_reference_similarity_and_open_briefs(spark):
    near = lambda **c: ids(serving.brief_filters(board(spark, **c), reference=F.lit(1), min_similarity=0.5))
    assert near() == [2] and near(similarity=0.4) == [] and near(similarity=None) == []
    assert ids(serving.brief_filters(board(spark, status="limited", age=None, a_f=None), include_limited=True)) == [1, 2]
    assert ids(serving.brief_filters(board(spark, age=None), max_age=40)) == [1]


def test_leaderboard_filters(spark):
    rows = board(spark, name="Zed", team="Blues", status=None, exposure=None)
    assert ids(serving.filter_leaderboard(rows, include_limited=False)) == [1, 2]
    assert ids(serving.filter_leaderboard(rows, min_exposure=1)) == [1] and ids(serving.filter_leaderboard(rows, team="Blues")) == [2]
    assert ids(serving.filter_leaderboard(rows, " BLUE ")) == [2] and ids(serving.filter_leaderboard(rows, "  ")) == [1, 2]
    assert ids(serving.club_filter(rows, ["Reds"], "LUE")) == [1, 2]


@pytest.mark.parametrize("key,kind", [("score", "double"), ("name", "string"), ("exposure", "double")])
def test_sorts_put_nulls_last_both_ways(spark, key, kind):
    values = [None, 2, 1, 2]
    rows = spark.createDataFrame([(i, None if v is None else float(v) if kind == "double" else str(v)) for i, v in enumerate(values)], f"entity_id long, {key} {kind}")
    order = lambda up: [r.entity_id for r in serving.sort_leaderboard(rows, key, up).collect()]
    places = lambda up: [r.entity_id for r in serving.sort_places(rows, [key], up).orderBy("pos").collect()]
    assert order(True) == places(True) == [2, 1, 3, 0] and order(False) == places(False) == [1, 3, 2, 0]
    with pytest.raises(ValueError):
        serving.sort_leaderboard(rows, "salary")


def test_talent_view_falls_back_by_exposure(spark):
    talent = spark.createDataFrame([(1, 500.0, 2000.0, True, 0.1), (2, 900.0, None, True, 0.1), (3, 100.0, None, True, 0.1), (4, None, 900.0, False, 0.1), (5, 0.0, 899.0, False, 0.1), (6, 5.0, 50.0, True, 0.1), (7, None, 50.0, False, 0.1)], "entity_id long, live_exposure double, prior_exposure double, in_live boolean, talent double")
    names = talent.select("entity_id", F.lit("x").alias("name"))
    profile = lambda *r: spark.createDataFrame(list(r), "entity_id long, status string")
    got = {r.entity_id: r.status for r in serving.talent_view(talent, names, profile((6, "live"), (7, "live")), profile((6, "prior"), (7, "prior"))).collect()}
    assert got == {1: "provisional", 2: "qualified", 3: "limited", 4: "qualified", 5: "limited", 6: "live", 7: "prior"}


def test_notes_in_order(spark):
    pcts = spark.createDataFrame([(1, 2000, c, p, n) for c, p, n in (("a", 90.0, 30), ("b", 99.0, 30), ("c", 99.0, 24), ("d", 10.0, 30), ("e", 25.0, 30), ("f", 50.0, 30), ("g", None, 30))], "entity_id long, period int, component string, pct_adj double, opps long")
    ratings = spark.createDataFrame([(1, 2000, 72.0, "qualified", 0.8, 2999.6)], "entity_id long, period int, score double, status string, total_reliability double, exposure double")
    notes = lambda r: {k: [(n.component, n.text) for n in sorted(serving.build_notes(pcts, r, DEFAULT.bands, 25).collect(), key=lambda n: n.position) if n.kind == k] for k in ("strength", "concern")}
    got = notes(ratings)
    assert got["strength"] == [("total", "Above-average complete impact."), ("b", "Elite adjusted b percentile."), ("a", "Elite adjusted a percentile."), ("sample", "Large, reliable sample (3000 minutes).")]
    assert got["concern"] == [("d", "d contribution well below the median."), ("e", "e contribution below the median.")]
    assert [c for c, _ in notes(ratings.withColumn("status", F.lit("limited")))["concern"]] == ["d", "e", "sample"]
    assert [c for c, _ in notes(ratings.withColumns({"score": F.lit(5.0), "total_reliability": F.lit(0.2)}))["concern"]] == ["total", "d", "e"]


def test_feeds_and_contracts_can_fail(spark):
    season = spark.createDataFrame([(1, 2000, 30.0, 28), (2, 2000, 10.0, 12)], "entity_id long, period int, expected double, conceded long")
    feed = lambda *v: spark.createDataFrame([(i, 2000, "x", x) for i, x in enumerate(v, 1)], "entity_id long, period int, component string, raw_value double")
    verdict = lambda *v: tuple(quality.reconcile_feeds(feed(*v), season, "x").first())
    assert verdict(2.0, -2.04)[:3] == ("ok", 2, 0) and verdict(2.0, -2.06)[:3] == ("warning", 2, 1) and verdict(None, None)[:2] == ("none", 0)
    contract = quality.component_contract(feed(1.0, None).withColumn("component", F.when(F.col("entity_id") == 1, "new").otherwise("x")), ["x", "gone"], ["raw_value"])
    assert sorted(map(tuple, contract.collect())) == [("gone", "error", 0), ("new", "warning", 1), ("x", "error", 1)]
    issues = lambda *r: spark.createDataFrame(list(r), "severity string, check_id string, n long")
    status = lambda *r: quality.validation_status(issues(*r)).first()[0]
    assert [status(), status(("error", "a", 0)), status(("warning", "a", 2)), status(("warning", "a", 2), ("error", "b", 1))] == ["passed", "passed", "warnings", "failed"]
    keys = quality.issue_row(spark.range(20), "many", F.col("id")).first()
    assert tuple(keys) == ("many", 20, "0,1,2,3,4") and tuple(quality.issue_row(spark.range(0), "none", F.col("id")).first()) == ("none", 0, "")


def test_labels_of_every_branch(spark):
    def named(*rows):
        centres = spark.createDataFrame([(k, c, v) for k, row in enumerate(rows) for c, v in row.items()], "cluster int, component string, c double")
        sizes = spark.createDataFrame([(k, 100 - k) for k in range(len(rows))], "cluster int, size long")
        return [name for _, name in archetypes.labels(centres, sizes)]

    assert named({"a": 2.0}, {"a": 1.0}, {"a": 0.7}) == ["High a", "High a (Secondary)", "High a (Secondary)"]
    assert named({"a": 2.0, "b": 0.1}, {"a": 1.0, "b": 0.6}) == ["High a", "High b"]
    low = {"a": -0.4, "b": -0.4, "c": -0.5}
    assert named(low, low, {"a": 0.49, "b": 0.0}, {"a": 0.1}) == ["Low involvement", "Low involvement", "Balanced", "Balanced"]
    z = spark.createDataFrame([(i, "a") for i in range(7)], "entity_id long, component string")
    assert tuple(archetypes.availability(z).first()) == (7, False, "too few entities: 7 of 8")


def test_changes_joins_and_sets(spark):
    entries = lambda *r: spark.createDataFrame(list(r), "entity_id long, rank int, score double, rate double, exposure double")
    got = snapshots.changes(entries((1, 1, 5.0, None, 1.0), (2, 2, 4.0, 0.1, 1.0), (3, 3, 1.0, 0.1, 1.0)), entries((1, 1, 5.0, None, 1.0), (2, 2, 4.1, 0.1, 1.0), (4, 3, 1.0, 0.1, 1.0)))
    assert sorted(map(tuple, got.collect())) == [(2, "altered"), (3, "removed"), (4, "added")]
    a, b = (spark.createDataFrame([(x,) for x in v], "k long") for v in ([1, 2, 2, None], [2, 3]))
    values = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert values(joins.union_ids((a, "k"), (b, "k"))) == [1, 2, 3, None] and values(joins.difference_ids((a, "k"), (b, "k"))) == [1, None] and values(joins.common_ids((a, "k"), (b, "k"))) == [2]
    assert values(joins.without_match(a, b, "k", "k")) == [1, None]
    assert sorted(map(tuple, joins.pick_list([2, 9], a, "k").collect())) == [(2, True), (9, False)]


def test_a_brief_returns_every_match_with_its_reasons(spark):
    rows = [(i, f"n{i}", "t", "qualified", 2000.0 + i, 0.5, 60.0, 50.0, 40.0, float(i % 7), 25, 1 if i % 2 else None, 0.95 if i % 3 else 0.6) for i in range(1, 121)]
    board = spark.createDataFrame(rows, "entity_id long, name string, team string, status string, exposure double, total_reliability double, a double, b double, c double, score double, age int, archetype int, similarity double")
    brief = serving.Brief(min_exposure=1000, min_reliability=0.4, min_pct={"a": 50}, min_age=20, similar_to=1, min_similarity=0.5)
    got = {r.entity_id: r for r in serving.run_brief(board, brief, ("a", "b", "c"), "n1").collect()}
    assert set(got) == set(range(2, 121))  # all but the reference, far over 50
    fit = lambda r: round(0.35 * r[6] + 0.15 * r[7] + 0.15 * r[8] + 0.2 * r[9] + 10 * r[5] + min(20, r[4] / 180) + 25 * r[12], 6)
    order = sorted((r for r in rows if r[0] != 1), key=lambda r: (-fit(r), -r[9], r[0]))
    assert [r[0] for r in order] == [e for e, _ in sorted(got.items(), key=lambda x: x[1].place)]
    tones = {x.code: x.tone for x in got[3].reasons}
    assert tones == {"minutes": "strong", "reliability": "pass", "a": "pass", "age": "pass", "archetype_info": "info", "similarity": "pass"}
    assert "archetype_info" not in {x.code for x in got[2].reasons}
    asked = serving.run_brief(board, serving.Brief(archetype=1, salary=True), ("a", "b", "c")).collect()
    assert len(asked) == 60 and {(x.code, x.tone) for r in asked for x in r.reasons if x.code in ("archetype", "salary_unavailable")} == {("archetype", "strong"), ("salary_unavailable", "info")}
    assert serving.run_brief(board, serving.Brief(query="nobody"), ("a", "b", "c")).count() == 0
