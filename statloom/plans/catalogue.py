"""The registered queries, in the order of the operator inventory."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import scalars
from statloom.operators import archetypes, facts, joins, league, quality, rank, rates, reliability, scouting, serving, shrink, snapshots, talent, uncertainty
from statloom.plans.oracle import Z, corr, pct, tilt
from statloom.plans.params import COMPONENTS, DEFAULT, Params
from statloom.plans.registry import ORACLE, apart, both, query, spark_column
from statloom.sources import pages, payload, roster

P = DEFAULT
C = F.col
HISTORY = f"period BETWEEN {P.history[0]} AND {P.history[1]}"
hist = lambda df: df.filter(HISTORY)

# --- SQL that several queries share
_REF = "(SELECT min(entity_id) AS e FROM ratings WHERE period = 2000 AND status = 'qualified')"
_SIM = f"(SELECT p.entity_id, sum(p.pct_adj * q.pct_adj) / sqrt(sum(p.pct_adj ** 2) * sum(q.pct_adj ** 2)) AS similarity FROM component_pcts p JOIN component_pcts q ON p.component = q.component AND q.period = 2000 AND q.entity_id = {_REF} WHERE p.period = 2000 GROUP BY p.entity_id HAVING sum(p.pct_adj ** 2) > 0 AND sum(q.pct_adj ** 2) > 0)"
_FIT = f"""(SELECT r.entity_id, r.score, r.status, r.total_reliability, r.exposure, s.similarity, a_f, n_o, r_f, 0.35 * coalesce(a_f, 0) + 0.15 * coalesce(n_o, 0) + 0.15 * coalesce(r_f, 0) + 0.2 * coalesce(score, 50) + 10 * coalesce(total_reliability, 0) + least(20, exposure / 180) + 25 * coalesce(similarity, 0) AS fit
    FROM ratings r JOIN (SELECT entity_id, max(pct_adj) FILTER (component = 'a_f') AS a_f, max(pct_adj) FILTER (component = 'n_o') AS n_o, max(pct_adj) FILTER (component = 'r_f') AS r_f FROM component_pcts WHERE period = 2000 GROUP BY entity_id) p ON r.entity_id = p.entity_id LEFT JOIN {_SIM} s ON r.entity_id = s.entity_id WHERE r.period = 2000)"""
_DQ = """SELECT 'error' AS severity, 'DQ-02' AS check_id, count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) a UNION ALL SELECT 'error', 'DQ-03', count(*) FROM {ratings} WHERE score < 0 OR score > 100
UNION ALL SELECT 'warning', 'DQ-05', count(*) FROM {events} e LEFT JOIN {customer} c ON e.user_id = c.c_custkey WHERE c.c_custkey IS NULL UNION ALL SELECT 'warning', 'DQ-08', count(*) FROM (SELECT period FROM {status} GROUP BY period HAVING sum(CASE WHEN status = 'qualified' THEN 1 ELSE 0 END) = 0) d"""
_CANDIDATES = f"(SELECT f.*, e.name, e.team, c.cluster AS archetype, CASE WHEN f.entity_id % 7 <> 0 THEN 20 + f.entity_id % 20 END AS age FROM {_FIT} f JOIN entities e ON f.entity_id = e.entity_id LEFT JOIN clusters c ON f.entity_id = c.entity_id)"
def _band_sql(v):
    return f"CASE WHEN {v} >= 85 THEN 'elite' WHEN {v} >= 70 THEN 'strong' WHEN {v} <= 15 THEN 'poor' WHEN {v} <= 30 THEN 'weak' END"


_NOTES = f"""SELECT *, row_number() OVER (PARTITION BY entity_id, period, kind ORDER BY part, CASE WHEN kind = 'strength' THEN -percentile ELSE percentile END NULLS FIRST, component) AS position FROM (
    SELECT entity_id, period, component, percentile, band, opportunities, 1 AS part, CASE WHEN band IN ('elite', 'strong') THEN 'strength' ELSE 'concern' END AS kind,
        CASE band WHEN 'elite' THEN 'Elite adjusted ' || component || ' percentile.' WHEN 'strong' THEN 'Strong ' || component || ' contribution.' WHEN 'poor' THEN component || ' contribution well below the median.' ELSE component || ' contribution below the median.' END AS text
    FROM (SELECT entity_id, period, component, round(pct_adj, 1) AS percentile, {_band_sql("pct_adj")} AS band, CAST(opps AS BIGINT) AS opportunities FROM component_pcts WHERE opps >= {P.min_claim_opps}) WHERE band IS NOT NULL
    UNION ALL SELECT entity_id, period, 'total', round(score, 1), band, NULL, 0, CASE WHEN band IN ('elite', 'strong') THEN 'strength' ELSE 'concern' END,
        CASE band WHEN 'elite' THEN 'Top-tier complete impact.' WHEN 'strong' THEN 'Above-average complete impact.' WHEN 'poor' THEN 'Complete impact well below the median.' ELSE 'Complete impact below the median.' END FROM (SELECT *, {_band_sql("score")} AS band FROM ratings) r WHERE band IS NOT NULL
    UNION ALL SELECT entity_id, period, 'sample', NULL, 'sample', NULL, 2, CASE WHEN status = 'qualified' THEN 'strength' ELSE 'concern' END,
        CASE status WHEN 'limited' THEN 'Limited sample (' WHEN 'provisional' THEN 'Provisional sample (' ELSE 'Large, reliable sample (' END || CAST(CAST(round(exposure) AS BIGINT) AS VARCHAR) || ' minutes).' FROM ratings WHERE status <> 'qualified' OR total_reliability >= 0.75)"""

# --- scans, sources, sinks
apart("src2_read_tables", "name #n", lambda w: _table_sizes(w, ["supplier", "lineitem", "orders"]),
      "SELECT 'supplier' AS name, count(*) AS n FROM {supplier} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'orders', count(*) FROM {orders}")
query("src1_read_payload", "resource #event_id event_type *value", lambda w: payload.read_events_payload(w), "(SELECT 'events' AS resource, event_id, event_type, value FROM events) x")
_SOURCES = "(SELECT period, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(CAST(max(last_date) AS DATE) AS VARCHAR), CAST(CAST(sum(shots) AS BIGINT) AS VARCHAR))) AS source_fingerprint, max(last_date) AS max_match_date FROM season GROUP BY period)"
query("src3_read_snapshots", "#period @captured_at source_fingerprint methodology_version #entity_id #rank *score", lambda w: payload.snapshot_rows(w),
      f"(SELECT s.period, CAST(captured_at AS VARCHAR) AS captured_at, source_fingerprint, '{P.methodology}' AS methodology_version, entity_id, rank, score FROM snapshots s JOIN {_SOURCES} f ON s.period = f.period) x")
query("src4_flatten_actions", "#entity_id #period *a_f_value *n_o_value *r_f_value #a_f_opps #n_o_opps #r_f_opps", lambda w: facts.pivot_components(payload.flatten_actions(payload.nested_actions(w.season_c), COMPONENTS), ["entity_id", "period"], ["value", "opps"], COMPONENTS),
      "(SELECT entity_id, period, " + ", ".join(f"max({v}) FILTER (component = '{c}') AS {c}_{v}" for c in ("a_f", "n_o", "r_f") for v in ("value", "opps")) + " FROM season_c GROUP BY entity_id, period) x")
query("src5_parse_number", "#event_id *number #whole", lambda w: w.table("events").select("event_id", F.concat_ws("", F.when(C("event_id") % 5 == 0, F.lit("x")).otherwise(F.lit("")), F.round("value", 2).cast("string")).alias("t")).select("event_id", scalars.parse_number(C("t")).alias("number"), scalars.parse_whole(C("t")).alias("whole")),
      "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 2) END AS number, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round_even(round(value, 2), 0) END AS whole FROM events) x")
query("src6_parse_event_date", "#o_orderkey @d", lambda w: w.table("orders").select("o_orderkey", F.when(C("o_orderkey") % 7 == 0, "n/a").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).alias("t")).select("o_orderkey", scalars.event_date(C("t")).alias("d")),
      "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) x")
query("src7_html_rows", "#page_id #row_no href label is_target", lambda w: pages.html_rows(w.table("pages")),
      "(SELECT page_id, unnest(range(len(h))) AS row_no, unnest(h) AS href, unnest(l) AS label, unnest(list_transform(l, lambda v: length(v) <= 3)) AS is_target FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2) AS l FROM pages WHERE html LIKE '%<nav>%' AND html LIKE '%<article>%')) x")
_NAV = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2)"


def _roster_pages(w):
    """Pages with a roster of their menu's entries; a third of the way a repeated header, short rows, and on some pages other headers."""
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    row = lambda v, i: F.concat(
        F.when((C("page_id") % 7 != 3) & (i % 3 == 2), "<tr><th>No.<th>Pos.<th>Nation<th>Player</tr><tr><td>short</td></tr>").otherwise(""), F.lit("<tr>"), cell(i.cast("string")),
        cell(F.lit("<b>"), F.when(i % 2 == 0, "gk").otherwise("df"), F.lit("</b>")), cell(F.lit("<img alt=flag>the "), F.when(i % 4 == 1, "").otherwise(v)), F.lit("<td><a href=x>"), v, F.lit("</a> jr."))
    head = F.when(C("page_id") % 7 == 3, "<tr><th>Shirt</th><th>Role</th><th>Country</th><th>Name</th></tr>").otherwise("<tr><th>No.</th><th>Pos.</th><th> Nation </th><th>Player</th></tr>")
    labels = F.regexp_extract_all("html", F.lit(pages.ROW), F.lit(2))
    html = F.concat(F.lit('<p>a<table><tr><td>1<td>GK<td>x<td>no roster</table><table class="wide wikitable"><tbody>'), head, F.array_join(F.transform(labels, row), ""), F.lit("</table>"), "html")
    return w.table("pages").select("page_id", html.alias("html"))


query("src7_roster_rows", "#page_id #table_no #jersey_number position_code nationality player_name is_target error", lambda w: roster.read_rosters(_roster_pages(w)),
      f"(SELECT page_id, 0 AS table_no, i AS jersey_number, CASE WHEN i % 2 = 0 THEN 'GK' ELSE 'DF' END AS position_code, CASE WHEN i % 4 = 1 OR trim(v) = '' THEN 'the' ELSE v END AS nationality, v || ' jr.' AS player_name, i % 2 = 0 AS is_target, NULL::VARCHAR AS error FROM (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS v FROM (SELECT page_id, {_NAV} AS l FROM pages WHERE page_id % 7 <> 3)) UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, 'no table with headers no., pos., nation, player' FROM pages WHERE page_id % 7 = 3) x")
query("src8_page_schema_guard", "#page_id fingerprint has_markers", lambda w: pages.schema_guard(w.table("pages")),
      "(SELECT page_id, substr(sha256(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(trim(x))))), '|')), 1, 16) AS fingerprint, html LIKE '%<nav>%' AND html LIKE '%<article>%' AS has_markers FROM pages) x")
query("snk1_write_tables", "#entity_id #period *exposure", lambda w: payload.written(w.season.select("entity_id", "period", "exposure"), "parquet", ["period"]), "season")
query("snk2_append_rows", "#entity_id #n", lambda w: payload.appended(w.entities.select("entity_id"), quality.append_run).groupBy("entity_id").agg(F.count("*").alias("n")), "(SELECT entity_id, 2 AS n FROM entities) x")
def _documents(w):
    index, points = serving.player_index(w.ratings, w.entities, w.talent), w.ratings.filter((C("period") == P.final) & C("in_pool")).select("entity_id", "score", "conceded_rate")
    kinds = {"season": (serving.season_documents(w.ratings, w.entities, w.component_pcts), F.size("components")), "timeline": (serving.timelines(w.form), F.size("timeline")), "components": (serving.component_maps(w.component_pcts), F.size("components")),
             "index": (index, F.size("periods")), "profile": (serving.profile_documents(w.ratings, w.talent), F.size("seasons")), "methodology": (serving.methodology_document(w.params), F.size("components")), "points": (points, F.lit(1))}
    out = [payload.written(df, "json").agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum(size).alias("parts")) for k, (df, size) in kinds.items()]
    return reduce(DataFrame.unionByName, out)


apart("snk3_write_documents", "kind #n #parts", _documents, " UNION ALL ".join(f"SELECT '{k}' AS kind, {n} AS n, {parts} AS parts FROM {t} t" for k, n, parts, t in (
    ("season", "count(DISTINCT (entity_id, period))", "count(*)", "component_pcts"), ("components", "count(DISTINCT (entity_id, period))", "count(*)", "component_pcts"), ("timeline", "count(DISTINCT (entity_id, period))", "count(*)", "form"),
    ("index", "count(DISTINCT entity_id)", "count(*)", "ratings"), ("profile", "count(DISTINCT entity_id)", "count(*)", "ratings"), ("methodology", "1", "count(*)", "params"), ("points", "count(*)", "count(*)", f"(SELECT * FROM ratings WHERE period = {P.final} AND in_pool)"))))
query("snk4_write_tidy_csv", "#entity_id #period *exposure", lambda w: payload.written(w.season.select("entity_id", "period", "exposure"), "csv"), "season")
def _ledger(w):
    path = payload.place(w.spark)
    for refresh, last in enumerate((P.final, P.live), 1):
        row = quality.refresh_row(refresh, w.season.filter(C("period") <= last), quality.validation_status(_issues(w)), _issues(w))
        for _ in range(refresh):  # the second is tried twice
            quality.append_refresh(row, path)
    return w.spark.read.parquet(path)


apart("snk5_refresh_ledger", "#refresh_id status #errors @max_date #n_rows fingerprint", _ledger,
      " UNION ALL ".join(f"SELECT {i} AS refresh_id, (SELECT CASE WHEN max(CASE WHEN severity = 'error' AND n > 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END) = 2 THEN 'failed' WHEN max(CASE WHEN n > 0 THEN 1 ELSE 0 END) = 1 THEN 'warnings' ELSE 'passed' END FROM ({{_DQ}}) q) AS status, (SELECT count_if(severity = 'error' AND n > 0) FROM ({{_DQ}}) q) AS errors, max(last_date) AS max_date, count(*) AS n_rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(CAST(max(last_date) AS DATE) AS VARCHAR), CAST(count(DISTINCT entity_id) AS VARCHAR))) AS fingerprint FROM season WHERE period <= {last}".replace("{_DQ}", _DQ) for i, last in ((1, P.final), (2, P.live))))


# --- conforming
query("can1_conform_teams", "#team_id name short_name", lambda w: facts.keep_first(w.table("nation").select(C("n_nationkey").alias("team_id"), F.trim("n_name").alias("name"), F.coalesce(F.nullif(F.trim(F.when(C("n_nationkey") % 2 == 0, F.substring("n_name", 1, 3)).otherwise("")), F.lit("")), F.trim("n_name")).alias("short_name")), ["team_id"], ["name"]),
      "(SELECT n_nationkey AS team_id, trim(n_name) AS name, CASE WHEN n_nationkey % 2 = 0 THEN trim(substr(n_name, 1, 3)) ELSE trim(n_name) END AS short_name FROM nation) x")
query("can2_conform_players", "#user_id #event_id event_type", lambda w: facts.keep_first(w.table("events").filter("trim(event_type) <> ''"), ["user_id"], [F.desc("ts"), F.desc("event_id")]),
      "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE trim(event_type) <> '') WHERE n = 1) x")
apart("can3_conform_games", "#event_id @d status *price", lambda w: w.table("orders").select(C("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("d"), C("o_orderstatus").alias("status"), C("o_totalprice").alias("price")),
      "SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS status, o_totalprice AS price FROM {orders}")
query("can4_slugify", "#c_custkey slug", lambda w: w.table("customer").select("c_custkey", scalars.slug(F.concat_ws(" É", "c_name", "c_mktsegment")).alias("slug")), "(SELECT c_custkey, trim(regexp_replace(lower(strip_accents(c_name || ' É' || c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer) x")
query("can5_dedupe_slugs", "#id slug", lambda w: facts.dedupe_slugs(w.table("part").select("p_partkey", "p_type"), "p_partkey", "p_type"),
      """(SELECT id, CASE WHEN m = 1 THEN s ELSE s || '-' || m END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n > 1, CAST(id AS VARCHAR)) AS m FROM (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || substr(CAST(id AS VARCHAR), 1, 6) END AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY base ORDER BY CAST(id AS VARCHAR)) AS n FROM (SELECT p_partkey AS id, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part))))) x""")
query("can6_dedupe_first", "#l_orderkey #l_linenumber *l_quantity *l_extendedprice", lambda w: facts.keep_first(w.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], [C(x) for x in ("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")]),
      "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1) x")
query("can6_duplicate_keys", "#l_orderkey #l_linenumber #n", lambda w: facts.duplicate_keys(w.table("lineitem"), ["l_orderkey", "l_linenumber"]), "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) x")
query("can6_duplicate_issue", "severity issue #n keys", lambda w: quality.duplicate_issue(w.table("lineitem"), ["l_orderkey", "l_linenumber"], "line"),
      """(WITH d AS (SELECT concat_ws('/', l_orderkey, l_linenumber) AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      SELECT 'warning' AS severity, 'duplicate_line' AS issue, (SELECT sum(n) FROM d) AS n,
      (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM d ORDER BY k LIMIT 5)) AS keys WHERE EXISTS (FROM d)) x""")
query("can7_attach_traditional", "#entity_id #period *total_value #conceded *expected", lambda w: facts.attach_one_to_one(w.totals.select("entity_id", "period", "total_value"), w.season.select("entity_id", "period", "conceded", "expected"), ["entity_id", "period"], ["conceded"]), "(SELECT entity_id, period, total_value, conceded, expected FROM totals JOIN season USING (entity_id, period)) x")
query("can8_label_unknown", "#event_id #user_id name", lambda w: facts.label_unknown(w.table("events").select("event_id", "user_id"), w.table("customer").select(C("c_custkey").alias("user_id"), C("c_name").alias("name")), "user_id", "name"), "(SELECT event_id, user_id, coalesce(c_name, 'Unknown (' || user_id || ')') AS name FROM events LEFT JOIN customer ON user_id = c_custkey) x")
query("can9_placeholder_rows", "#user_id name", lambda w: facts.placeholder_rows(w.table("customer").select(C("c_custkey").alias("user_id"), C("c_name").alias("name")), "user_id", "name", w.table("events").select("user_id"), w.table("supplier").select((C("s_suppkey") + 1_000_000).alias("user_id"))),
      "(SELECT c_custkey AS user_id, c_name AS name FROM customer UNION ALL SELECT user_id, 'Unknown (' || user_id || ')' FROM (SELECT user_id FROM events UNION SELECT s_suppkey + 1000000 FROM supplier) WHERE user_id NOT IN (SELECT c_custkey FROM customer)) x")
query("can10_union_periods", "#entity_id #period *exposure", lambda w: facts.keep_first(w.season.filter("period <= 1997").unionByName(w.season.filter("period >= 1997").drop("expected"), allowMissingColumns=True), ["entity_id", "period"], ["expected"]), "season")
query("can11_attach_dates", "#undated #dated", lambda w: w.table("lineitem").join(w.table("orders").filter("o_orderkey % 11 <> 0"), C("l_orderkey") == C("o_orderkey"), "left").agg(F.count_if(C("o_orderdate").isNull()).alias("undated"), F.count("o_orderdate").alias("dated")), "(SELECT count_if(o_orderdate IS NULL) AS undated, count(o_orderdate) AS dated FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) ON l_orderkey = o_orderkey) x")
query("can12_components_long", "#entity_id #period component *value", lambda w: facts.unpivot_components(facts.pivot_components(w.season_c, ["entity_id", "period"], ["value", "opps"], COMPONENTS), ["entity_id", "period"], "value", COMPONENTS), "(SELECT entity_id, period, component, value FROM dense) x")
_SEASON = {
    "entity_id": "bigint", "period": "int", "team_id": "bigint", "exposure": "double", "appearances": "bigint", "shots": "bigint", "conceded": "bigint", "saves": "bigint",
    **dict.fromkeys(("expected", "save_pct", "prevented", "conceded_rate", "shots_rate", "prevented_rate", "total_value", "total_rate"), "double"), "components_complete": "boolean",
}
_MATCH = {
    "entity_id": "bigint", "event_id": "bigint", "period": "int", "team_id": "bigint", "event_date": "date", "matchday": "int", "exposure": "double",
    "shots": "bigint", "conceded": "bigint", "saves": "bigint", **dict.fromkeys(("expected", "prevented", "total_value", "total_rate"), "double"),
}


def _marked(types):
    return " ".join({"double": "*", "bigint": "#", "int": "#", "date": "@"}.get(t, "") + c for c, t in types.items())


def _season_stats(w):
    key = ["entity_id", "period"]
    played = w.match.groupBy(*key).agg(F.count("*").alias("appearances"))
    rows = w.traditional.join(played, key).join(w.totals.select(*key, "total_value", "total_rate", "components_complete"), key, "left")
    return facts.project(rows.join(w.entities.select("entity_id", "team_id"), "entity_id", "left"), _SEASON)


def _match_stats(w):
    """The tables have no matchday; a match's total is the sum of its components."""
    rows = w.match_totals.withColumns({"event_date": F.to_date("event_date"), "prevented": C("expected") - C("conceded"), "total_value": C("value")})
    rows = rows.withColumn("total_rate", scalars.per_exposure(C("value"), C("exposure"), P.basis))
    return facts.project(rows.join(w.entities.select("entity_id", "team_id"), "entity_id", "left"), _MATCH)


apart("can13_project_season", _marked(_SEASON), _season_stats, """SELECT g.*, e.team_id, m.appearances, t.total_value, t.total_rate, t.components_complete FROM {traditional} g
      JOIN (SELECT entity_id, period, count(*) AS appearances FROM {matches} GROUP BY ALL) m USING (entity_id, period)
      LEFT JOIN {totals} t ON t.entity_id = g.entity_id AND t.period = g.period LEFT JOIN {entities} e ON e.entity_id = g.entity_id""")
apart("can13_project_matches", _marked(_MATCH), _match_stats, f"""SELECT m.entity_id, m.event_id, m.period, e.team_id, CAST(m.event_date AS DATE) AS event_date, NULL AS matchday, m.exposure, m.shots, m.conceded, m.saves, m.expected,
      m.expected - m.conceded AS prevented, m.value AS total_value, m.value / m.exposure * {P.basis} AS total_rate FROM {{match_totals}} m LEFT JOIN {{entities}} e ON e.entity_id = m.entity_id""")
VERSION = "1"


def _rated(w):
    final = w.clusters.select("entity_id", F.lit(P.final).alias("period"), C("cluster").alias("archetype"))
    return w.ratings.join(facts.current_team(w.stints, ["entity_id", "period"], "club"), ["entity_id", "period"]).join(final, ["entity_id", "period"], "left")


apart("can13_project_ratings", "#entity_id #period status *score *adj_total *obs_total *total_reliability #rank_adjusted #rank_observed #rank_conceded #rank_disagreement #archetype changed_teams methodology_version",
      lambda w: facts.project(_rated(w), {"entity_id": "bigint", "period": "int", "status": "string", "score": "double", "adj_total": "double", "obs_total": "double", "total_reliability": "double", "rank_adjusted": "int", "rank_observed": "int", "rank_conceded": "int", "rank_disagreement": "int", "archetype": "int", "changed_teams": "boolean"}, methodology_version=VERSION),
      f"SELECT r.*, c.cluster AS archetype, s.n > 1 AS changed_teams, '{VERSION}' AS methodology_version FROM {{ratings}} r JOIN (SELECT entity_id, period, count(*) AS n FROM {{stints}} GROUP BY ALL) s ON r.entity_id = s.entity_id AND r.period = s.period LEFT JOIN {{clusters}} c ON r.entity_id = c.entity_id AND r.period = {P.final}")
apart("can13_project_talent", "#entity_id *talent *talent_low *talent_high *talent_sd *talent_pct #talent_rank *weight_league *weight_prior *weight_live *prior_rate *live_rate *prior_exposure *live_exposure *league_mean prior_source in_live methodology_version",
      lambda w: facts.project(w.talent_ranked, {"entity_id": "bigint", **dict.fromkeys(("talent", "talent_low", "talent_high", "talent_sd", "talent_pct"), "double"), "talent_rank": "int", **dict.fromkeys(("weight_league", "weight_prior", "weight_live", "prior_rate", "live_rate", "prior_exposure", "live_exposure", "league_mean"), "double"), "prior_source": "string", "in_live": "boolean"}, methodology_version=VERSION),
      f"SELECT *, '{VERSION}' AS methodology_version FROM {{talent_ranked}}")
apart("can13_project_players", "#entity_id name slug @birth_date nationality #height_ft",
      lambda w: facts.project(w.entities.select("entity_id", "name", scalars.slug(C("name")).alias("slug"), C("team").alias("nationality")), {"entity_id": "bigint", "name": "string", "slug": "string", "birth_date": "date", "nationality": "string", "height_ft": "int"}),
      "SELECT entity_id, name, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, NULL AS birth_date, team AS nationality, NULL AS height_ft FROM {entities}")
apart("can13_project_games", "#event_id #period @date_utc status",
      lambda w: facts.project(w.table("orders").select(C("o_orderkey").alias("event_id"), F.year("o_orderdate").alias("period"), C("o_orderdate").alias("date_utc"), C("o_orderstatus").alias("status")), {"event_id": "bigint", "period": "int", "date_utc": "date", "status": "string"}),
      "SELECT o_orderkey AS event_id, year(o_orderdate) AS period, CAST(o_orderdate AS DATE) AS date_utc, o_orderstatus AS status FROM {orders}")
query("can14_age_years", "#o_orderkey #age", lambda w: w.table("orders").select("o_orderkey", scalars.age_years(F.to_date("o_orderdate"), F.lit("2025-02-28").cast("date")).alias("age")), "(SELECT o_orderkey, 2025 - year(o_orderdate) - CASE WHEN (month(o_orderdate), day(o_orderdate)) > (2, 28) THEN 1 ELSE 0 END AS age FROM orders) x")
query("can15_display_round", "#entity_id #period *r", lambda w: w.totals.select("entity_id", "period", scalars.display_round(C("total_raw"), 3).alias("r")), "(SELECT entity_id, period, round(total_raw, 3) AS r FROM totals) x")

# --- filters
def _board(w, period):
    """The leaderboard of a period."""
    return w.ratings.filter(C("period") == period).join(w.entities.select("entity_id", "name", "team"), "entity_id")


def _table_sizes(w, names):
    return reduce(DataFrame.unionByName, [w.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


def _reference_id(w):
    """The reference of briefs: one row."""
    return F.lit(w.ratings.filter(C("period") == P.final).filter("status = 'qualified'").agg(F.min("entity_id")).first()[0])


def _candidates(w):
    """Board rows with component percentiles, similarity, an age and an archetype."""
    age = F.when(C("entity_id") % 7 != 0, 20 + C("entity_id") % 20)
    return _fit(w).join(w.entities.select("entity_id", "name", "team"), "entity_id").join(w.clusters.select("entity_id", C("cluster").alias("archetype")), "entity_id", "left").withColumn("age", age)


def _issues(w):
    return quality.run_quality([
        ("error", "DQ-02", facts.duplicate_keys(w.table("lineitem"), ["l_orderkey", "l_linenumber"])),
        ("error", "DQ-03", w.ratings.filter("score < 0 OR score > 100")),
        ("warning", "DQ-05", joins.without_match(w.table("events"), w.table("customer"), "user_id", "c_custkey")),
        ("warning", "DQ-08", w.status.groupBy("period").agg(F.count_if(C("status") == "qualified").alias("q")).filter("q = 0")),
    ])


LEADER = "SELECT r.entity_id, r.period, e.name, e.team, r.score, r.status, r.exposure, r.rank_adjusted FROM {ratings} r JOIN {entities} e ON r.entity_id = e.entity_id"
apart("flt1_filter_leaderboard", "#entity_id name team *score", lambda w: serving.filter_leaderboard(_board(w, P.final), " ion_1 ", 1900, "all", False),
      f"SELECT * FROM ({LEADER}) b WHERE period = 2000 AND status <> 'limited' AND exposure >= 1900 AND (lower(team) LIKE '%ion\\_1%' ESCAPE '\\' OR lower(name) LIKE '%ion\\_1%' ESCAPE '\\')")
apart("flt2_brief_filters", "#entity_id *score *total_reliability", lambda w: serving.brief_filters(_candidates(w), "a", False, 1800, 0.1, {"a_f": 25, "n_o": 5, "r_f": 5}, 21, 38, None, _reference_id(w), 0.5),
      f"SELECT f.* FROM {_CANDIDATES} f WHERE (lower(name) LIKE '%a%' OR lower(team) LIKE '%a%') AND status <> 'limited' AND exposure >= 1800 AND total_reliability >= 0.1 AND a_f >= 25 AND n_o >= 5 AND r_f >= 5 AND age >= 21 AND age <= 38 AND similarity >= 0.5 AND entity_id <> {_REF}")
apart("flt2_brief_profile", "#entity_id #archetype #age", lambda w: serving.brief_filters(_candidates(w), include_limited=True, archetype=1, max_age=35), f"SELECT * FROM {_CANDIDATES} c WHERE archetype = 1 AND age <= 35")
apart("flt3_search_text", "#entity_id name", lambda w: serving.search_text(w.entities, " ION_2 ", ["name", "team"]),
      "SELECT entity_id, name FROM {entities} WHERE lower(concat_ws(' ', name, team)) LIKE '%ion\\_2%' ESCAPE '\\'")
apart("flt4_club_filter", "#entity_id team", lambda w: serving.club_filter(w.entities, ["NATION_3", "NATION_7"], "Tion_1"),
      "SELECT entity_id, team FROM {entities} WHERE team IN ('NATION_3', 'NATION_7') OR lower(team) LIKE '%tion\\_1%' ESCAPE '\\'")

# --- rates
query("rat1_per_exposure", "#entity_id #period component *value_rate", lambda w: w.rates, "rates")
query("rat2_add_totals", "#entity_id #period *total_value *total_raw #total_opps components_complete", lambda w: w.totals, "totals")
query("rat3_add_rates", "#entity_id #period component *value_rate *opp_rate", lambda w: w.rates, "rates")
query("rat4_traditional", "#entity_id #period *conceded_rate *shots_rate *expected_rate *save_pct *prevented *prevented_rate", lambda w: w.traditional, "traditional")

# --- estimators
query("agg1_weighted_mean", "component *m", lambda w: w.season_c.groupBy("component").agg(reliability.weighted_mean(C("value") / C("opps"), C("opps")).alias("m")), "(SELECT component, sum(value) / sum(opps) AS m FROM season_c GROUP BY component) x")
query("agg2_within_variance", "component *s2 #n_groups #n_matches", lambda w: reliability.within_variance(hist(w.cube), P.min_matches), "within")
query("agg3_between_variance", "component *tau2 *mean #n_used", lambda w: reliability.between_variance(hist(w.cube), reliability.within_variance(hist(w.cube), P.min_matches), P), "between_")
query("agg4_pool_mean", "component *pool_mean", lambda w: reliability.pool_mean(hist(w.season_c), ["component"]), "pool_means")
query("agg5_pool_rate", "component *pool_rate", lambda w: reliability.pool_rate(hist(w.season_c), ["component"], P.basis), "(SELECT component, league_rate AS pool_rate FROM pool_means) x")
query("agg6_volume_reliability", "component *k_exposure volume_source *sampling *talent *league_rate #volume_groups", lambda w: reliability.volume_reliability(hist(w.cube), P), "volumes")
query("agg7_k_gate", "component *k source reason", lambda w: w.params, "params")
query("agg8_split_half", "component *split_half", lambda w: reliability.split_half(hist(w.cube), P.min_matches), "halves")
query("agg9_spearman_brown", "component *spearman_brown", lambda w: w.params, "params")
query("agg10_year_over_year", "component *year_over_year", lambda w: reliability.year_over_year(hist(w.season_c), P), "yoy")
query("agg11_drift_variance", "component *drift drift_source", lambda w: w.params, "params")
query("agg12_total_variance", "*total_tau2 *total_drift total_source", lambda w: w.total, "total")
query("agg13_median_opportunities", "component *median_opps *reliability_at_median", lambda w: w.params, "params")
query("agg14_estimate_reliability", "component *k source *s2 *tau2 *mean #n_groups #n_matches *median_opps *split_half *spearman_brown *year_over_year *drift drift_source *k_exposure *league_rate", lambda w: w.params, "params")
query("agg15_league_baseline", "#period component *mu *league_workload #pool_size baseline_source", lambda w: w.baseline, "baseline")
query("agg16_league_mean_total", "*league_mean", lambda w: talent.league_mean_total(w.shrunk_totals.filter(C("period") == P.final), P), "league")
query("agg17_sample_counts", "#period #qualified #provisional #limited", lambda w: w.status.groupBy("period").pivot("status", ["qualified", "provisional", "limited"]).count().fillna(0), "(SELECT period, count_if(status = 'qualified') AS qualified, count_if(status = 'provisional') AS provisional, count_if(status = 'limited') AS limited FROM status GROUP BY period) x")
query("agg18_season_summary", "#period #entities #events #rows_ @max_date *exposure", lambda w: w.match.groupBy("period").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("event_id").alias("events"), F.count("*").alias("rows_"), F.max("event_date").alias("max_date"), F.sum("exposure").alias("exposure")), "(SELECT period, count(DISTINCT entity_id) AS entities, count(DISTINCT event_id) AS events, count(*) AS rows_, max(event_date) AS max_date, sum(exposure) AS exposure FROM matches GROUP BY period) x")
apart("agg19_league_reference", "#period *average_adjusted *average_score baseline_source #pool_size *adj_median *adj_min *adj_max *obs_median *obs_min *obs_max *conceded_median *save_pct_median", lambda w: league.league_reference(w.ratings, w.baseline),
      """SELECT r.period, a.average_adjusted, 100 * sum(CASE WHEN adj_total < a.average_adjusted THEN exposure WHEN adj_total = a.average_adjusted THEN exposure / 2 ELSE 0 END) / sum(exposure) AS average_score, any_value(a.baseline_source) AS baseline_source, count(*) AS pool_size,
      median(adj_total) AS adj_median, min(adj_total) AS adj_min, max(adj_total) AS adj_max, median(obs_total) AS obs_median, min(obs_total) AS obs_min, max(obs_total) AS obs_max, median(conceded_rate) AS conceded_median, median(save_pct) AS save_pct_median
      FROM {ratings} r JOIN (SELECT period, sum(mu * league_workload) AS average_adjusted, min(baseline_source) AS baseline_source FROM {baseline} GROUP BY period) a ON r.period = a.period WHERE in_pool AND adj_total IS NOT NULL GROUP BY r.period, a.average_adjusted""")
METRICS = ("score", "conceded_rate", "save_pct", "exposure", "observed_pct", "total_reliability")
PAIRS = [("score", "conceded_rate"), ("score", "save_pct"), ("score", "exposure"), ("observed_pct", "conceded_rate"), ("observed_pct", "save_pct"), ("score", "observed_pct")]


def _spearman_pairs(w):
    x = w.ratings.filter("in_pool and period = 2000")
    x = x.select("entity_id", "period", *(F.round(m, 9).alias(m) for m in METRICS))
    x = rank.standings(x, ["period"], ["entity_id"], list(METRICS)).withColumns({f"r_{m}": rank.average_rank_of(m) for m in METRICS})
    return x.agg(F.array(*(F.struct(F.lit(f"{a}~{b}").alias("pair"), scalars.guarded_corr(C(f"r_{a}").cast("double"), C(f"r_{b}").cast("double"), 5).alias("r")) for a, b in PAIRS)).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def _avg_rank(m, keys=None):
    part = f"PARTITION BY {keys} " if keys else ""
    return f"rank() OVER ({part}ORDER BY {m}) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}{m}) - 1) / 2.0"


query("agg20_spearman_pairs", "pair *r", _spearman_pairs, "(" + " UNION ALL ".join(f"SELECT '{a}~{b}' AS pair, {corr('x', 'y', 5)} AS r FROM (SELECT {_avg_rank(f'round({a}, 9)')} AS x, {_avg_rank(f'round({b}, 9)')} AS y FROM ratings WHERE in_pool AND period = 2000)" for a, b in PAIRS) + ") x")


def _component_corr(w):
    x = w.component_pcts.filter("status = 'qualified' and period = 2000 and obs_rate is not null").select("entity_id", "component", F.round("obs_rate", 9).alias("v"))
    a, b = x.select("entity_id", C("component").alias("a"), C("v").alias("va")), x.select("entity_id", C("component").alias("b"), C("v").alias("vb"))
    j = a.join(b, "entity_id").filter("a < b")
    j = rank.standings(j, ["a", "b"], ["entity_id"], ["va", "vb"]).withColumns({"x": rank.average_rank_of("va"), "y": rank.average_rank_of("vb")})
    return j.groupBy("a", "b").agg(scalars.guarded_corr(C("x").cast("double"), C("y").cast("double"), 3).alias("r"))


query("agg21_component_corr_matrix", "a b *r", _component_corr, f"(SELECT a, b, {corr('x', 'y', 3)} AS r FROM (SELECT a, b, {_avg_rank('va', 'a, b')} AS x, {_avg_rank('vb', 'a, b')} AS y FROM (SELECT p.component AS a, q.component AS b, round(p.obs_rate, 9) AS va, round(q.obs_rate, 9) AS vb FROM component_pcts p JOIN component_pcts q ON p.entity_id = q.entity_id AND p.component < q.component AND p.period = 2000 AND q.period = 2000 WHERE p.status = 'qualified' AND p.obs_rate IS NOT NULL AND q.obs_rate IS NOT NULL)) GROUP BY a, b) x")


def _stability(w):
    a = w.ratings.select("entity_id", C("period").alias("pa"), F.round("score", 9).alias("va"))
    j = a.join(w.ratings.select("entity_id", C("period").alias("pb"), F.round("score", 9).alias("vb")), "entity_id").filter("pa < pb")
    j = rank.standings(j, ["pa", "pb"], ["entity_id"], ["va", "vb"]).withColumns({"x": rank.average_rank_of("va"), "y": rank.average_rank_of("vb")})
    return j.groupBy("pa", "pb").agg(scalars.guarded_corr(C("x").cast("double"), C("y").cast("double"), 3).alias("r"), F.count("*").alias("n"))


query("agg22_yoy_stability", "#pa #pb *r #n", _stability, f"(SELECT pa, pb, {corr('x', 'y', 3)} AS r, count(*) AS n FROM (SELECT pa, pb, {_avg_rank('va', 'pa, pb')} AS x, {_avg_rank('vb', 'pa, pb')} AS y FROM (SELECT p.period AS pa, q.period AS pb, round(p.score, 9) AS va, round(q.score, 9) AS vb FROM ratings p JOIN ratings q ON p.entity_id = q.entity_id AND p.period < q.period)) GROUP BY pa, pb) x")
apart("agg23_linear_fit", "*slope *intercept *r2", lambda w: joins.next_period(w.ratings, ["entity_id"], ["score"]).agg(F.regr_slope("next_score", "score").alias("slope"), F.regr_intercept("next_score", "score").alias("intercept"), F.regr_r2("next_score", "score").alias("r2")),
      "SELECT regr_slope(b.score, a.score) AS slope, regr_intercept(b.score, a.score) AS intercept, regr_r2(b.score, a.score) AS r2 FROM {ratings} a JOIN {ratings} b ON a.entity_id = b.entity_id AND b.period = a.period + 1")
query("agg24_component_pivot", "#entity_id *a_f *n_o *r_f", lambda w: w.component_pcts.filter("period = 2000").groupBy("entity_id").pivot("component", list(COMPONENTS)).agg(F.max("pct_adj")).orderBy(F.desc(F.round("a_f", 9)), "entity_id").limit(20), "(SELECT * FROM (SELECT entity_id, " + ", ".join(f"max(CASE WHEN component = '{c}' THEN pct_adj END) AS {c}" for c in ("a_f", "n_o", "r_f")) + " FROM component_pcts WHERE period = 2000 GROUP BY entity_id) ORDER BY round(a_f, 9) DESC, entity_id LIMIT 20) x")
apart("agg25_count_by_status", "#period status #n", lambda w: w.status.groupBy("period", "status").agg(F.count("*").alias("n")),
      "SELECT period, status, count(*) AS n FROM {status} GROUP BY period, status")
apart("agg26_distinct_teams", "team", lambda w: w.entities.select("team").distinct(),
      "SELECT DISTINCT team FROM {entities}")
query("agg27_archetype_profile", "#cluster component #size *mean_involvement *median_score", lambda w: archetypes.profiles(w.z, w.clusters, w.ratings.filter(C("period") == P.final)),
      f"(SELECT cluster, component, count(*) AS size, avg(x) AS mean_involvement, median(score) AS median_score FROM z JOIN clusters USING (entity_id) LEFT JOIN (SELECT entity_id, score FROM ratings WHERE period = {P.final}) USING (entity_id) GROUP BY ALL) x")
for _d, _name in ((0.0, "flat"), (0.01, "strong")):
    query(f"agg7_k_gate_{_name}", "component source reason", lambda w, d=_d: type(w)(w.spark, w.dir, Params(signal=d)).params, "params")
    ORACLE[f"agg7_k_gate_{_name}"] = ORACLE[f"agg7_k_gate_{_name}"].replace(tilt(P.signal), tilt(_d))

# --- shrinkage and rating
query("shr1_reliability_weight", "#entity_id #period component *weight", lambda w: w.shrunk, "shrunk")
query("shr2_shrink_workload", "#entity_id #period component *adj_opp_rate", lambda w: w.shrunk, "shrunk")
query("shr3_apply_shrinkage", "#entity_id #period component *adj_value *adj_rate *base_rate", lambda w: w.shrunk, "shrunk")
query("shr4_sampling_variance", "#entity_id #period *sampling_variance", lambda w: w.shrunk_totals, "shrunk_totals")
query("shr5_total_reliability", "#entity_id #period *total_reliability *adj_total *base_total", lambda w: w.shrunk_totals, "shrunk_totals")
query("qua1_qualification_rule", "#period mode *qualified_bar *provisional_bar *max_exposure", lambda w: shrink.qualification(w.season, P), "bars")
query("qua2_sample_status", "#entity_id #period status in_pool", lambda w: w.status, "status")
apart("qua3_talent_view_row", "#entity_id name status *talent", lambda w: serving.talent_view(w.talent, w.entities, w.ratings.filter(C("period") == P.live), w.ratings.filter(C("period") == P.final)),
      "SELECT t.entity_id, e.name, coalesce(CASE WHEN coalesce(live_exposure, 0) > 0 THEN coalesce(l.status, p.status) ELSE coalesce(p.status, l.status) END, CASE WHEN t.in_live AND coalesce(live_exposure, 0) >= 826 THEN 'qualified' WHEN t.in_live AND coalesce(live_exposure, 0) >= 270 THEN 'provisional' WHEN t.in_live THEN 'limited' WHEN coalesce(prior_exposure, 0) >= 900 THEN 'qualified' ELSE 'limited' END) AS status, t.talent FROM {talent} t JOIN {entities} e ON t.entity_id = e.entity_id LEFT JOIN (SELECT entity_id, status FROM {ratings} WHERE period = 2001) l ON t.entity_id = l.entity_id LEFT JOIN (SELECT entity_id, status FROM {ratings} WHERE period = 2000) p ON t.entity_id = p.entity_id")
query("tal1_current_talent", "#entity_id *talent *talent_sd *weight_league *weight_prior *weight_live prior_source", lambda w: w.talent, "talent")
query("tal2_talent_interval", "#entity_id *talent_low *talent_high", lambda w: w.talent, "talent")
apart("tal3_rank_talent", "#entity_id name team status *evidence_exposure in_live #talent_rank *talent_pct *talent_pct_low *talent_pct_high", lambda w: talent.with_identity(w.talent_ranked, w.ratings, w.entities, P),
      f"SELECT t.*, e.name, e.team, CASE WHEN l.status IS NOT NULL THEN l.status ELSE f.status END AS status FROM {{talent_ranked}} t LEFT JOIN {{entities}} e ON t.entity_id = e.entity_id LEFT JOIN (SELECT * FROM ratings WHERE period = {P.live}) l ON t.entity_id = l.entity_id LEFT JOIN (SELECT * FROM ratings WHERE period = {P.final}) f ON t.entity_id = f.entity_id")
apart("tal4_model_context", "*total_tau2 *total_drift total_source *league_mean", lambda w: w.total.join(w.talent.agg(F.max("league_mean").alias("league_mean"))),
      "SELECT t.total_tau2, t.total_drift, t.total_source, (SELECT max(league_mean) FROM {talent}) AS league_mean FROM {total} t")
query("unc1_bootstrap_rate", "#entity_id #period *boot_low *boot_high *boot_se", lambda w: w.boot, "boot")


def _posterior(w):
    return uncertainty.posterior_interval(w.shrunk_totals, w.boot, w.total, P)


_POST = f"(SELECT *, adj_total - {Z!r} * posterior_sd AS posterior_low, adj_total + {Z!r} * posterior_sd AS posterior_high FROM (SELECT t.*, sqrt((1 - total_tau2 / (total_tau2 + boot_se * boot_se)) * total_tau2) AS posterior_sd FROM shrunk_totals t JOIN boot USING (entity_id, period)))"
query("unc2_posterior_interval", "#entity_id #period *posterior_sd *posterior_low *posterior_high", _posterior, f"{_POST} x")
query("unc3_interval_on_score", "#entity_id #period *low_pct", lambda w: talent.interval_percentiles(_posterior(w).select("entity_id", "period", C("posterior_low").alias("v")), w.shrunk_totals.filter("in_pool"), "adj_total", "exposure", ["period"]).withColumnRenamed("pct", "low_pct"),
      f"(SELECT p.entity_id, p.period, 100 * sum(CASE WHEN t.adj_total < p.posterior_low THEN t.exposure WHEN t.adj_total = p.posterior_low THEN t.exposure / 2 ELSE 0 END) / sum(t.exposure) AS low_pct FROM {_POST} p JOIN shrunk_totals t ON t.period = p.period AND t.in_pool GROUP BY p.entity_id, p.period) x")
query("unc4_bootstrap_mean", "#entity_id #period *boot_low *boot_high", lambda w: uncertainty.bootstrap_mean(w.resampled, P), "boot_mean")

# --- windows and ranks
query("win1_weighted_percentile", "#entity_id #period component *pct_adj *pct_obs", lambda w: w.component_pcts, "component_pcts")
query("win2_competition_rank", "#entity_id #period #rank_adjusted #rank_conceded", lambda w: w.ratings, "ratings")
query("win3_add_ratings", "#entity_id #period *score *observed_pct #rank_adjusted #rank_observed #rank_conceded #rank_save_pct #rank_conceded_pool #rank_adjusted_pool #rank_observed_pool #rank_disagreement", lambda w: w.ratings, "ratings")
_RANKED = {"score": True, "save_pct": True, "conceded_rate": False, "total_reliability": True}


def _metrics(w):
    return w.ratings.filter("period = 2000").unpivot("entity_id", [F.round(m, 9).alias(m) for m in _RANKED], "metric", "value")


_METRIC_SQL = "(" + " UNION ALL ".join(f"SELECT entity_id, '{m}' AS metric, round({m}, 9) AS value FROM ratings WHERE period = 2000" for m in _RANKED) + ")"
_PLAYER_RANKS = {"adj_total": True, "obs_total": True, "exposure": True, "appearances": True, "conceded": False, "conceded_rate": False, "save_pct": True, "prevented": True, "prevented_rate": True, "total_reliability": True, "shots": True, "saves": True}


def _player_metrics(w):
    """Every metric of a player page in one long table: its own, and each component's adjusted rate and opportunities."""
    now = lambda df: df.filter(C("period") == P.final)
    own = now(w.ratings).select("entity_id", "adj_total", "obs_total", "exposure", "total_reliability").join(now(w.traditional).drop("exposure", "period"), "entity_id").join(now(w.match).groupBy("entity_id").agg(F.count("*").alias("appearances")), "entity_id")
    parts = now(w.component_pcts).unpivot(["entity_id", "component"], [C("adj_rate").cast("double").alias("adj"), C("opps").cast("double").alias("opps")], "part", "value")
    parts = parts.select("entity_id", F.concat_ws("_", "component", "part").alias("metric"), F.round("value", 9).alias("value"))
    return own.unpivot("entity_id", [F.round(C(m).cast("double"), 9).alias(m) for m in _PLAYER_RANKS], "metric", "value").unionByName(parts)


_PLAYER_SQL = f"(SELECT r.entity_id, adj_total, obs_total, r.exposure, total_reliability, t.conceded, t.conceded_rate, t.save_pct, prevented, prevented_rate, shots, saves, appearances FROM ratings r JOIN traditional t ON r.entity_id = t.entity_id AND r.period = t.period JOIN (SELECT entity_id, count(*) AS appearances FROM matches WHERE period = {P.final} GROUP BY entity_id) m ON r.entity_id = m.entity_id WHERE r.period = {P.final})"
_PLAYER_LONG = " UNION ALL ".join([*(f"SELECT entity_id, '{m}' AS metric, round(CAST({m} AS DOUBLE), 9) AS value FROM {_PLAYER_SQL} p" for m in _PLAYER_RANKS), *(f"SELECT entity_id, component || '_{n}', round(CAST({v} AS DOUBLE), 9) FROM component_pcts WHERE period = {P.final}" for n, v in (("adj", "adj_rate"), ("opps", "opps")))])
query("win4_rank_among", "#entity_id metric #rank #of", lambda w: scouting.rank_among(_player_metrics(w), _PLAYER_RANKS | {f"{c}_{part}": True for c in COMPONENTS for part in ("adj", "opps")}),
      f"(SELECT entity_id, metric, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('conceded', 'conceded_rate') THEN -value ELSE value END DESC NULLS LAST) END AS rank, count(value) OVER (PARTITION BY metric) AS of FROM ({_PLAYER_LONG}) m) x")
query("win5_rank_archetypes", "#cluster component #rank", lambda w: rank.competition_rank(w.seeds.withColumn("c", F.round("c", 9)), ["component"], "c"), "(SELECT cluster, component, rank() OVER (PARTITION BY component ORDER BY round(c, 9) DESC) AS rank FROM seeds) x")
query("win6_cumulative_form", "#entity_id #period #event_id #match_no *cum_value *cum_exposure ~cum_rate", lambda w: w.form, "form")
query("win7_rolling_mean", "#entity_id #period #event_id ~rolling_mean", lambda w: w.form, "form")
query("win8_rolling_weighted", "#entity_id #period #event_id ~rolling_weighted", lambda w: w.form, "form")
apart("win9_period_change", "#entity_id #period *score *score_change", lambda w: serving.period_change(w.ratings),
      "SELECT entity_id, period, score, score - lag(score) OVER (PARTITION BY entity_id ORDER BY period) AS score_change FROM {ratings}")
query("win10_stints", "#entity_id #period #stint #club #appearances *exposure @first_date @last_date", lambda w: w.stints, "stints")
apart("win10_current_team", "#entity_id #period #current_team #n_stints changed_teams", lambda w: facts.current_team(w.stints, ["entity_id", "period"], "club"),
      "SELECT entity_id, period, club AS current_team, stint AS n_stints, stint > 1 AS changed_teams FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period ORDER BY last_date DESC, stint DESC) AS n FROM {stints}) s WHERE n = 1")
query("win11_first_per_key", "#entity_id #period", lambda w: facts.keep_first(w.ratings.filter(C("period").isin(P.final, P.live)), ["entity_id"], [C("period").desc()]).select("entity_id", "period"), "(SELECT entity_id, max(period) AS period FROM ratings WHERE period IN (2000, 2001) GROUP BY entity_id) x")
query("win12_average_rank", "#entity_id #period *r", lambda w: rank.average_rank(w.season.select("entity_id", "period", "shots"), ["period"], ["entity_id"], "shots"), f"(SELECT entity_id, period, {_avg_rank('shots', 'period')} AS r FROM season) x")

# --- sort, limit, top-k
apart("srt1_sort_leaderboard", "#entity_id key #pos", lambda w: serving.sort_places(_board(w, P.final).join(_candidates(w).select("entity_id", "a_f", "n_o", "r_f"), "entity_id"), list(serving.SORT_KEYS)),
      " UNION ALL ".join(f"SELECT entity_id, '{k}' AS key, row_number() OVER (ORDER BY {k if k == 'name' else f'round({k}, 9)'} DESC NULLS LAST, entity_id) AS pos FROM (SELECT r.*, c.name, a_f, n_o, r_f FROM ratings r JOIN {_CANDIDATES} c ON r.entity_id = c.entity_id WHERE r.period = {P.final}) b" for k in serving.SORT_KEYS))
query("srt1_ascending", "#entity_id *score", lambda w: serving.sort_leaderboard(_board(w, P.final), "score", True).limit(10), f"(SELECT entity_id, score FROM ratings WHERE period = {P.final} ORDER BY round(score, 9) ASC NULLS LAST, entity_id LIMIT 10) x")
apart("srt2_top_disagreement", "direction #entity_id #rank_disagreement", lambda w: serving.top_disagreement(w.ratings.filter(C("period") == P.final)),
      "SELECT direction, entity_id, rank_disagreement FROM (SELECT CASE WHEN rank_disagreement > 0 THEN 'up' ELSE 'down' END AS direction, entity_id, rank_disagreement, row_number() OVER (PARTITION BY rank_disagreement > 0 ORDER BY abs(rank_disagreement) DESC, entity_id) AS n FROM {ratings} WHERE period = 2000 AND rank_disagreement <> 0) t WHERE n <= 10")
apart("srt3_largest_abs_gap", "#entity_id #gap", lambda w: serving.largest_abs_gap(w.ratings.filter(C("period") == P.final)),
      "SELECT entity_id, abs(rank_disagreement) AS gap FROM {ratings} WHERE period = 2000 AND rank_disagreement IS NOT NULL ORDER BY abs(rank_disagreement) DESC, entity_id LIMIT 12")
apart("srt4_top_n_board", "#entity_id *score", lambda w: serving.top_n_board(w.ratings.filter(C("period") == P.final)),
      "SELECT entity_id, score FROM {ratings} WHERE period = 2000 AND status <> 'limited' ORDER BY round(score, 9) DESC, entity_id LIMIT 5")
apart("srt5_underrated", "#entity_id *score #rank_conceded", lambda w: serving.underrated(w.ratings.filter(C("period") == P.final)),
      "SELECT entity_id, score, rank_conceded FROM {ratings} WHERE period = 2000 AND rank_disagreement > 0 ORDER BY rank_disagreement DESC, entity_id LIMIT 15")
apart("srt6_top_k_per_period", "#period #entity_id #n", lambda w: serving.top_k_per_period(w.ratings),
      "SELECT period, entity_id, n FROM (SELECT period, entity_id, row_number() OVER (PARTITION BY period ORDER BY rank_adjusted, entity_id) AS n FROM {ratings} WHERE status = 'qualified') t WHERE n <= 5")

# --- joins and sets
apart("joi1_inner_join", "#entity_id #period name", lambda w: joins.attach(w.season, w.entities, ["entity_id"], ["name"]),
      "SELECT s.entity_id, s.period, e.name FROM {season} s JOIN {entities} e ON s.entity_id = e.entity_id")
apart("joi2_left_join", "#entity_id #period *exposure team", lambda w: joins.attach(joins.attach(w.ratings.drop("exposure"), w.season, ["entity_id", "period"], ["exposure"], "left"), w.entities, ["entity_id"], ["team"], "left"),
      "SELECT r.entity_id, r.period, s.exposure, e.team FROM {ratings} r LEFT JOIN {season} s ON r.entity_id = s.entity_id AND r.period = s.period LEFT JOIN {entities} e ON r.entity_id = e.entity_id")
query("joi3_fuzzy_name_join", "#roster_id #entity_id", lambda w: joins.fuzzy_name_join(
          w.table("nation").select(C("n_nationkey").alias("roster_id"), F.concat_ws(" ", F.lit("of"), "n_name").alias("roster_name")),
          w.table("customer").select(C("c_custkey").alias("entity_id"), F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("Nation_"), C("c_nationkey")), "c_name").alias("name"))),
      "(SELECT n_nationkey AS roster_id, c_custkey AS entity_id FROM nation JOIN (SELECT c_custkey, lower(c_mktsegment || ' nation_' || c_nationkey || ' ' || c_name) AS nm FROM customer) ON contains(nm, lower(n_name))) x")
apart("joi4_anti_join", "#c_custkey", lambda w: joins.without_match(w.table("customer"), w.table("events"), "c_custkey", "user_id"),
      "SELECT c_custkey FROM {customer} c LEFT JOIN (SELECT DISTINCT user_id FROM {events}) e ON e.user_id = c.c_custkey WHERE e.user_id IS NULL")
apart("joi5_semi_top1", "#entity_id #period", lambda w: joins.of_largest(w.season, "exposure"),
      "SELECT entity_id, period FROM {season} WHERE entity_id IN (SELECT entity_id FROM (SELECT entity_id FROM {season} GROUP BY entity_id ORDER BY sum(exposure) DESC, entity_id LIMIT 1) t)")
query("joi6_next_period", "#entity_id #period *exposure *next_exposure", lambda w: joins.next_period(w.season, ["entity_id"], ["exposure"]), "(SELECT a.entity_id, a.period, a.exposure, b.exposure AS next_exposure FROM season a JOIN season b ON a.entity_id = b.entity_id AND b.period = a.period + 1) x")
apart("joi7_full_outer", "#entity_id *prior *live", lambda w: joins.side_by_side(w.season.filter(C("period") == P.final), w.season.filter(C("period") == P.live), "exposure", ("prior", "live")),
      "SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, a.exposure AS prior, b.exposure AS live FROM (SELECT * FROM {season} WHERE period = 2000) a FULL OUTER JOIN (SELECT * FROM {season} WHERE period = 2001) b ON a.entity_id = b.entity_id")
apart("joi8_lookup", "#entity_id team #rank_adjusted", lambda w: joins.attach(w.ratings.filter(C("period") == P.live), w.entities, ["entity_id"], ["team"], "left"),
      "SELECT r.entity_id, e.team, r.rank_adjusted FROM {ratings} r LEFT JOIN {entities} e ON r.entity_id = e.entity_id WHERE r.period = 2001")
apart("joi9_pick_list", "#wanted found", lambda w: joins.pick_list([1, 5, 7, -1], w.ratings.filter(C("period") == P.final)),
      "SELECT p.wanted, r.entity_id IS NOT NULL AS found FROM (VALUES (1), (5), (7), (-1)) AS p(wanted) LEFT JOIN (SELECT entity_id FROM {ratings} WHERE period = 2000) r ON r.entity_id = p.wanted")
apart("set1_union_ids", "#id", lambda w: joins.union_ids((w.season, "entity_id"), (w.table("events"), "user_id")),
      "SELECT entity_id AS id FROM {season} UNION SELECT user_id FROM {events}")
apart("set2_difference", "#id", lambda w: joins.difference_ids((w.table("customer"), "c_custkey"), (w.table("events"), "user_id")),
      "SELECT DISTINCT c_custkey AS id FROM {customer} EXCEPT SELECT user_id FROM {events}")
apart("set3_intersection", "#id", lambda w: joins.common_ids((w.season.filter(C("period") == P.final), "entity_id"), (w.season.filter(C("period") == P.live), "entity_id")),
      "SELECT entity_id AS id FROM {season} WHERE period = 2000 INTERSECT SELECT entity_id FROM {season} WHERE period = 2001")

# --- data quality
both("dq1_orphan_season_rows", "#n", "SELECT count(*) AS n FROM {season} s LEFT JOIN {entities} e ON s.entity_id = e.entity_id WHERE e.entity_id IS NULL")
both("dq2_duplicate_keys", "#l_orderkey #l_linenumber #n", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
both("dq3_score_range", "#n", "SELECT count(*) AS n FROM {ratings} WHERE score < 0 OR score > 100")
both("dq4_zero_exposure_rate", "#n", "SELECT count(*) AS n FROM {rates} WHERE exposure <= 0 AND value_rate IS NOT NULL")
both("dq5_orphan_events", "#n", "SELECT count(*) AS n FROM {events} e LEFT JOIN {customer} c ON e.user_id = c.c_custkey WHERE c.c_custkey IS NULL")
both("dq6_unknown_component", "component", f"SELECT DISTINCT component FROM {{season_c}} WHERE component NOT IN ({', '.join(repr(c) for c in COMPONENTS[:4])})")
both("dq7_weights_sum", "#n", "SELECT count(*) AS n FROM {talent} WHERE abs(weight_league + weight_prior + weight_live - 1) > 0.02")
both("dq8_period_without_qualified", "#period", "SELECT period FROM {status} GROUP BY period HAVING sum(CASE WHEN status = 'qualified' THEN 1 ELSE 0 END) = 0")
apart("dq9_run_quality", "severity check_id #n", lambda w: _issues(w), f"SELECT * FROM ({_DQ}) q WHERE n > 0")
query("dq10_required_fields", "table_name field", lambda w: payload.missing_fields(w.table("events"), "events", ["event_id", "user_id", "minutes"]), "(SELECT 'events' AS table_name, 'minutes' AS field) x")
apart("dq11_component_contract", "component severity #n", lambda w: quality.component_contract(w.component_pcts, [*COMPONENTS[:5], "x_x"], ["value", "opps"]),
      f"SELECT coalesce(a.c, b.component) AS component, CASE WHEN b.component IS NULL OR bad > 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN b.component IS NULL THEN 0 WHEN a.c IS NULL THEN n ELSE bad END AS n FROM (VALUES {', '.join(f'({c!r})' for c in (*COMPONENTS[:5], 'x_x'))}) AS a(c) FULL OUTER JOIN (SELECT component, count(*) AS n, count_if(value IS NULL OR opps IS NULL) AS bad FROM {{component_pcts}} GROUP BY component) b ON a.c = b.component WHERE a.c IS NULL OR b.component IS NULL OR bad > 0")
apart("dq12_minutes_reconciliation", "#period #off *gap", lambda w: quality.reconcile_exposure(w.season, w.match),
      "SELECT s.period, sum(CASE WHEN abs(s.exposure - m.e) > 5 THEN 1 ELSE 0 END) AS off, max(abs(s.exposure - m.e)) AS gap FROM {season} s JOIN (SELECT entity_id, period, sum(exposure) AS e FROM {matches} GROUP BY entity_id, period) m ON s.entity_id = m.entity_id AND s.period = m.period GROUP BY s.period")
apart("dq13_feed_reconciliation", "verdict #n #breaches *gap", lambda w: quality.reconcile_feeds(w.season_c, w.season, "a_f"),
      "SELECT CASE WHEN n = 0 THEN 'none' WHEN breaches > 0 THEN 'warning' ELSE 'ok' END AS verdict, n, breaches, gap FROM (SELECT count(*) AS n, count_if(d > 0.05) AS breaches, max(d) AS gap FROM (SELECT abs(c.raw_value - (s.expected - s.conceded)) AS d FROM {season} s JOIN {season_c} c USING (entity_id, period) WHERE c.component = 'a_f') WHERE d IS NOT NULL) y")
apart("dq14_issue_rows", "issue #n keys", lambda w: quality.issue_row(w.match.filter("event_date IS NULL"), "undated", C("event_id")).unionByName(quality.issue_row(w.match.filter("exposure <= 10"), "short", C("event_id"))).unionByName(quality.issue_row(joins.without_match(w.table("events"), w.table("customer"), "user_id", "c_custkey"), "no_metadata", C("event_id"))),
      " UNION ALL ".join(f"SELECT '{i}' AS issue, (SELECT count(*) FROM {t}) AS n, (SELECT coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') FROM (SELECT DISTINCT event_id AS k FROM {t} ORDER BY k LIMIT 5)) AS keys" for i, t in (("undated", "(SELECT * FROM {matches} WHERE event_date IS NULL) u"), ("short", "(SELECT * FROM {matches} WHERE exposure <= 10) u"), ("no_metadata", "(SELECT * FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)) u"))))
apart("dq15_validation_status", "status", lambda w: quality.validation_status(_issues(w)), f"SELECT CASE WHEN max(CASE WHEN severity = 'error' AND n > 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END) = 2 THEN 'failed' WHEN max(CASE WHEN n > 0 THEN 1 ELSE 0 END) = 1 THEN 'warnings' ELSE 'passed' END AS status FROM ({_DQ}) q")

# --- snapshots
query("snp1_build_snapshot", "#period @captured_at #entity_id #rank *score *rate *exposure", lambda w: w.snapshots, "snapshots")
query("snp2_changed_entries", "#entity_id change", lambda w: snapshots.changes(w.snapshots.filter(C("period") == P.final - 1), w.snapshots.filter(C("period") == P.final)),
      f"(SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN b.entity_id IS NULL THEN 'added' WHEN a.entity_id IS NULL THEN 'removed' ELSE 'altered' END AS change FROM (SELECT * FROM snapshots WHERE period = {P.final}) a FULL JOIN (SELECT * FROM snapshots WHERE period = {P.final - 1}) b ON a.entity_id = b.entity_id WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR (a.rank, a.score, a.rate, a.exposure) IS DISTINCT FROM (b.rank, b.score, b.rate, b.exposure)) x")


def _recaptured(w):
    """A month later: of every third period nothing is other, of the next its source, of the next some entries."""
    x = w.snapshots.withColumn("captured_at", F.date_add("captured_at", 30)).filter("period % 3 <> 2 OR entity_id % 10 <> 3")
    x = x.withColumn("rank", F.when((C("period") % 3 == 2) & (C("entity_id") % 10 == 4), C("rank") + 1).otherwise(C("rank")))
    sources = w.sources.withColumn("source_fingerprint", F.when(C("period") % 3 == 1, "other").otherwise(C("source_fingerprint")))
    return x, snapshots.headers(x, sources, P.methodology)


def _judged(w):
    path = payload.place(w.spark)
    snapshots.write_snapshot(w.snapshots, snapshots.headers(w.snapshots, w.sources, P.methodology), path)
    return snapshots.write_snapshot(*_recaptured(w), path)


query("snp2_snapshot_changed", "#period changed reason @captured_at @previous_at", _judged,
      "(SELECT period, period % 3 <> 0 AS changed, CASE period % 3 WHEN 1 THEN 'source' WHEN 2 THEN 'entries' ELSE 'unchanged' END AS reason, any_value(captured_at) + 30 AS captured_at, any_value(captured_at) AS previous_at FROM snapshots GROUP BY period) x")
query("snp2_all_changed_entries", "#period #entity_id change", lambda w: snapshots.changed_entries(w.snapshots, _recaptured(w)[0], _judged(w)),
      "(SELECT period, entity_id, CASE WHEN entity_id % 10 = 3 THEN 'removed' ELSE 'altered' END AS change FROM snapshots WHERE period % 3 = 2 AND (entity_id % 10 = 3 OR entity_id % 10 = 4 AND rank IS NOT NULL)) x")
query("snp3_latest_snapshot", "#period @captured_at #entity_id #rank", lambda w: snapshots.latest(w.snapshots), "snapshots")
query("snp4_prune", "#period #n", lambda w: snapshots.prune(w.snapshots.unionByName(w.snapshots.withColumn("captured_at", F.date_add("captured_at", 30))), 1).groupBy("period").agg(F.count("*").alias("n")), "(SELECT period, count(*) AS n FROM snapshots GROUP BY period) x")
query("snp5_rank_movement", "#entity_id #rank #previous_rank #rank_change *score_change", lambda w: snapshots.rank_movement(w.snapshots.filter("period = 2001"), w.snapshots.filter("period = 2000")), "(SELECT a.entity_id, a.rank, b.rank AS previous_rank, b.rank - a.rank AS rank_change, round(a.score - b.score, 1) AS score_change FROM snapshots a LEFT JOIN snapshots b ON a.entity_id = b.entity_id AND b.period = 2000 WHERE a.period = 2001) x")
query("snp6_ranking_history", "#entity_id history", lambda w: snapshots.ranking_history(w.snapshots).select("entity_id", F.array_join(F.transform("history", lambda h: F.concat_ws(":", F.date_format(h["captured_at"], "yyyy-MM-dd"), h["rank"].cast("string"))), ",").alias("history")), "(SELECT entity_id, string_agg(strftime(captured_at, '%Y-%m-%d') || ':' || rank, ',' ORDER BY captured_at) AS history FROM snapshots WHERE rank IS NOT NULL GROUP BY entity_id) x")
apart("snp7_rank_change_vs_final", "#entity_id #change", lambda w: serving.rank_change(w.ratings.filter(C("period") == P.live), w.ratings.filter(C("period") == P.final)),
      "SELECT l.entity_id, f.rank_adjusted - l.rank_adjusted AS change FROM {ratings} l LEFT JOIN (SELECT entity_id, rank_adjusted FROM {ratings} WHERE period = 2000) f ON l.entity_id = f.entity_id WHERE l.period = 2001")
query("snp8_source_fingerprint", "fingerprint", lambda w: snapshots.source_fingerprint(w.table("nation").select(C("n_name").alias("resource"), F.sha2("n_name", 256).alias("content_sha"))), "(SELECT sha256(array_to_string(list_sort(list(n_name || ':' || sha256(n_name))), '|')) AS fingerprint FROM nation) x")

# --- clustering
query("clu1_standardise", "#entity_id component *z", lambda w: w.z, "z")


query("clu2_fit_kmeans", "#entity_id #cluster #k", lambda w: archetypes.fit_kmeans(w.z, seed=P.seed), "km_chosen")
query("clu3_silhouette", "*silhouette", lambda w: archetypes.euclidean_silhouette(w.z, w.clusters.select("entity_id", "cluster")),
      """(SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT entity_id, max(s / nullif(n - 1, 0)) FILTER (cluster = cb) AS a, min(s / n) FILTER (cluster <> cb) AS b
      FROM (SELECT entity_id, cluster, cb, sum(d) AS s, count(*) AS n FROM (SELECT p.entity_id, cp.cluster, q.entity_id AS other, cq.cluster AS cb, sqrt(sum((p.z - q.z) ** 2)) AS d
      FROM z p JOIN z q USING (component) JOIN clusters cp ON p.entity_id = cp.entity_id JOIN clusters cq ON q.entity_id = cq.entity_id GROUP BY ALL) GROUP BY ALL) GROUP BY entity_id)) x""")
query("clu4_assign_cluster", "#entity_id #cluster *d2", lambda w: w.clusters, "clusters")


def _labels(w):
    sizes = w.clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return w.spark.createDataFrame(archetypes.labels(w.seeds, sizes), "cluster int, label string")


query("clu5_label_cluster", "#cluster label", _labels, None)
apart("clu6_archetype_members", "#cluster #entity_id *score", lambda w: w.clusters.join(w.ratings.filter(C("period") == P.final).select("entity_id", "score"), "entity_id"),
      "SELECT c.cluster, c.entity_id, r.score FROM {clusters} c JOIN {ratings} r ON c.entity_id = r.entity_id AND r.period = 2000")
apart("clu7_availability", "#usable available reason", lambda w: archetypes.availability(w.z), "SELECT n AS usable, n > 7 AS available, CASE WHEN n <= 7 THEN 'too few entities: ' || CAST(n AS VARCHAR) || ' of 8' END AS reason FROM (SELECT count(DISTINCT entity_id) AS n FROM {z}) y")

# --- scouting


def _profiles(w):
    return w.component_pcts.filter("period = 2000").select("entity_id", "component", F.round("pct_adj", 9).alias("pct"))


def _reference(w):
    ref = w.ratings.filter("period = 2000 and status = 'qualified'").agg(F.min("entity_id").alias("e"))
    return _profiles(w).join(F.broadcast(ref), C("entity_id") == C("e")).select("component", "pct")


query("sco1_cosine_similarity", "#entity_id *similarity", lambda w: scouting.cosine_to(_profiles(w), _reference(w)).filter("similarity is not null"), f"{_SIM} x")


def _fit(w):
    p = w.component_pcts.filter("period = 2000").groupBy("entity_id").pivot("component", list(COMPONENTS)).agg(F.first("pct_adj"))
    x = w.ratings.filter("period = 2000").join(p, "entity_id").join(scouting.cosine_to(_profiles(w), _reference(w)), "entity_id", "left")
    return x.withColumn("fit", scouting.fit_score(C("a_f"), C("n_o"), C("r_f"), C("score"), C("total_reliability"), C("exposure"), C("similarity"), F.lit(False)))


query("sco2_fit_score", "#entity_id *fit", _fit, f"{_FIT} x")


#: The brief of the registered queries; whom it is compared with is the first qualified entity of the period.
ASKED = serving.Brief(min_exposure=900, min_reliability=0.05, min_pct={"a_f": 15, "n_o": 5}, min_age=20, max_age=38, min_similarity=0.5, salary=True)
_BRIEF = f"""(SELECT *, row_number() OVER (ORDER BY round(fit, 6) DESC, round(score, 6) DESC, entity_id) AS place FROM {_CANDIDATES} c
    WHERE status <> 'limited' AND exposure >= 900 AND coalesce(total_reliability, 0) >= 0.05 AND a_f >= 15 AND n_o >= 5 AND age BETWEEN 20 AND 38 AND similarity >= 0.5 AND entity_id <> {_REF})"""


def _brief(w):
    return serving.run_brief(_candidates(w).drop("fit"), replace(ASKED, similar_to=_reference_id(w)), ("a_f", "n_o", "r_f"), "the reference")


query("sco3_run_brief", "#place #entity_id *fit *score", _brief, f"{_BRIEF} x")
_REASONS = {
    "minutes": ("Minutes", "CAST(CAST(round(exposure) AS BIGINT) AS VARCHAR) || ' minutes meets the 900 threshold'", "CASE WHEN exposure >= 1800 THEN 'strong' ELSE 'pass' END", "true"),
    "reliability": ("Reliability", "'Total reliability of at least 0.05'", "CASE WHEN total_reliability >= 0.2 THEN 'strong' ELSE 'pass' END", "true"),
    **{p: (p, f"'{p} percentile ' || CAST(CAST(round({p}) AS BIGINT) AS VARCHAR) || ' of at least {v}'", f"CASE WHEN {p} >= {v + 20} THEN 'strong' ELSE 'pass' END", "true") for p, v in (("a_f", 15), ("n_o", 5))},
    "age": ("Age", "'Age ' || age || ' is in the range asked for (from 20 to 38)'", "'pass'", "true"),
    "archetype_info": ("Archetype", "'Is of archetype ' || archetype", "'info'", "archetype IS NOT NULL"),
    "similarity": ("Profile similarity", "CAST(CAST(round(100 * similarity) AS BIGINT) AS VARCHAR) || '% component-percentile similarity to the reference (at least 50%)'", "CASE WHEN similarity >= 0.9 THEN 'strong' ELSE 'pass' END", "similarity IS NOT NULL"),
    "salary_unavailable": ("Salary", "'Salaries are not in the data, so they filter nothing'", "'info'", "true"),
}
apart("sco4_match_reasons", "#entity_id code label detail tone", lambda w: _brief(w).select("entity_id", F.explode("reasons").alias("x")).select("entity_id", "x.*"),
      " UNION ALL ".join(f"SELECT entity_id, '{k}' AS code, '{label}' AS label, {detail} AS detail, {tone} AS tone FROM {_BRIEF} b WHERE {when}" for k, (label, detail, tone, when) in _REASONS.items()))
query("sco5_shortlist_table", "#place #entity_id name *a_f *n_o *r_f *fit reasons", lambda w: _brief(w).withColumn("reasons", F.array_join(F.transform("reasons", lambda x: F.concat_ws(":", x["code"], x["tone"])), ",")),
      "(SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN '{k}:' || {tone} END" for k, (_, _, tone, when) in _REASONS.items()) + f") AS reasons FROM {_BRIEF}) x")
_PROFILE_NUMBERS = ("exposure", "score", "score_low", "score_high", "adj_total", "obs_total", "total_reliability", "posterior_low", "posterior_high", "conceded_rate", "save_pct", "prevented", "prevented_rate", "expected", *(f"{c}_{v}" for c in COMPONENTS for v in ("adj", "pct")), "talent_score", "talent", "weight_league", "weight_prior", "weight_live")
_PROFILE_COLUMNS = "#entity_id name team nationality #age #period status #archetype #appearances #conceded #shots #saves " + " ".join("*" + n for n in _PROFILE_NUMBERS)


def _profile_table(w):
    post = _posterior(w)
    long = post.unpivot(["entity_id", "period"], [C("posterior_low").alias("score_low"), C("posterior_high").alias("score_high")], "bound", "v")
    on_score = talent.interval_percentiles(long, w.shrunk_totals.filter("in_pool"), "adj_total", "exposure", ["period"])
    bounds = on_score.groupBy("entity_id", "period").pivot("bound", ["score_low", "score_high"]).agg(F.first("pct"))
    intervals = post.select("entity_id", "period", "posterior_low", "posterior_high").join(bounds, ["entity_id", "period"])
    people = w.entities.select("entity_id", "name", "team", C("team").alias("nationality"), F.when(C("entity_id") % 7 != 0, 20 + C("entity_id") % 20).alias("age")).join(w.clusters.select("entity_id", C("cluster").alias("archetype")), "entity_id", "left")
    now = lambda df: df.filter(C("period") == P.final)
    return serving.profile_table(now(w.ratings), w.traditional, now(w.component_pcts), intervals, people, now(w.match).groupBy("entity_id", "period").agg(F.count("*").alias("appearances")), w.talent_ranked, COMPONENTS)


def _on_score(bound):
    return f"100 * sum(CASE WHEN t.adj_total < p.{bound} THEN t.exposure WHEN t.adj_total = p.{bound} THEN t.exposure / 2 ELSE 0 END) / sum(t.exposure)"


query("sco6_profile_table", _PROFILE_COLUMNS, _profile_table, f"""(SELECT r.*, e.name, e.team, e.team AS nationality, CASE WHEN r.entity_id % 7 <> 0 THEN 20 + r.entity_id % 20 END AS age, c.cluster AS archetype, m.appearances, g.conceded, g.shots, g.saves, g.prevented, g.prevented_rate, g.expected, i.score_low, i.score_high, i.posterior_low, i.posterior_high,
    {", ".join(f"k.{c}_{v}" for c in COMPONENTS for v in ("adj", "pct"))}, q.talent_pct AS talent_score, q.talent, q.weight_league, q.weight_prior, q.weight_live
    FROM ratings r JOIN entities e ON r.entity_id = e.entity_id JOIN (SELECT * FROM traditional WHERE period = {P.final}) g ON r.entity_id = g.entity_id JOIN (SELECT entity_id, count(*) AS appearances FROM matches WHERE period = {P.final} GROUP BY entity_id) m ON r.entity_id = m.entity_id
    JOIN (SELECT entity_id, {", ".join(f"max({v}) FILTER (component = '{c}') AS {c}_{n}" for c in COMPONENTS for n, v in (("adj", "adj_rate"), ("pct", "pct_adj")))} FROM component_pcts WHERE period = {P.final} GROUP BY entity_id) k ON r.entity_id = k.entity_id
    LEFT JOIN (SELECT p.entity_id, any_value(p.posterior_low) AS posterior_low, any_value(p.posterior_high) AS posterior_high, {_on_score("posterior_low")} AS score_low, {_on_score("posterior_high")} AS score_high FROM {_POST} p JOIN shrunk_totals t ON t.period = p.period AND t.in_pool WHERE p.period = {P.final} GROUP BY p.entity_id) i ON r.entity_id = i.entity_id
    LEFT JOIN clusters c ON r.entity_id = c.entity_id LEFT JOIN talent_ranked q ON r.entity_id = q.entity_id WHERE r.period = {P.final}) x""")
query("sco7_compare_matrix", "#entity_id metric *value is_best", lambda w: scouting.compare_matrix(_metrics(w).filter("entity_id <= 4"), {"score": True, "save_pct": True, "conceded_rate": False, "total_reliability": None}), f"(SELECT *, coalesce(value = CASE WHEN metric IN ('score', 'save_pct') THEN max(value) OVER (PARTITION BY metric) WHEN metric = 'conceded_rate' THEN min(value) OVER (PARTITION BY metric) END, false) AS is_best FROM {_METRIC_SQL} WHERE entity_id <= 4) x")
query("sco8_dashboard", "#size *upper_median", lambda w: serving.dashboard(_brief(w)), f"(SELECT count(*) AS size, list_sort(list(coalesce(score, 0)) FILTER (place <= 10))[count(*) FILTER (place <= 10) // 2 + 1] AS upper_median FROM {_BRIEF}) x")
apart("sco9_recommendation", "#place #entity_id role risks", lambda w: serving.recommendation(_brief(w)).withColumn("risks", F.array_join("risks", ",")),
      f"SELECT place, entity_id, CASE WHEN place = 1 THEN 'primary' ELSE 'alternative' END AS role, concat_ws(',', CASE WHEN status <> 'qualified' THEN 'not_qualified' END, CASE WHEN total_reliability < 0.25 THEN 'low_reliability' END) AS risks FROM {_BRIEF} b WHERE place <= 3")
apart("sco10_leaderboard_table", "#rank_adjusted #entity_id name team *score status", lambda w: _board(w, P.final),
      f"SELECT * FROM ({LEADER}) b WHERE period = 2000")
apart("sco11_coverage_status", "#period metric #v", lambda w: w.season.groupBy("period").agg(F.count("*").alias("entities"), F.sum("shots").alias("matches")).unpivot("period", ["entities", "matches"], "metric", "v"),
      "SELECT period, 'entities' AS metric, count(*) AS v FROM {season} GROUP BY period UNION ALL SELECT period, 'matches', sum(shots) FROM {season} GROUP BY period")
apart("not1_band", "#entity_id #period component band", lambda w: w.component_pcts.withColumn("band", scalars.band(C("pct_adj"), P.bands)),
      "SELECT entity_id, period, component, CASE WHEN pct_adj >= 85 THEN 'elite' WHEN pct_adj >= 70 THEN 'strong' WHEN pct_adj <= 15 THEN 'poor' WHEN pct_adj <= 30 THEN 'weak' END AS band FROM {component_pcts}")
apart("not2_strengths_concerns", "#entity_id #period kind #position component *percentile band #opportunities text", lambda w: serving.build_notes(w.component_pcts, w.ratings, P.bands, P.min_claim_opps), _NOTES)
apart("doc1_timeline", "#entity_id #period #match_no #event_id *exposure *value *cum_value *cum_rate *rolling_mean *rolling_weighted", lambda w: serving.timelines(w.form).select("entity_id", "period", F.explode("timeline").alias("x")).select("entity_id", "period", "x.*"), "SELECT * FROM {form}")
apart("doc2_component_map", "#entity_id #period component *value *raw_value #opps *obs_rate *adj_rate *adj_value *weight *base_rate *pct_adj *pct_obs", lambda w: serving.component_maps(w.component_pcts).select("entity_id", "period", F.explode("components").alias("component", "x")).select("entity_id", "period", "component", "x.*"), "SELECT * FROM {component_pcts}")
apart("doc3_season_document", "#entity_id #period name team *score *adj_total #rank_adjusted status *total_reliability component *pct_adj", lambda w: payload.written(serving.season_documents(w.ratings, w.entities, w.component_pcts), "json").select("entity_id", "period", "identity.*", "rating.*", "sample.*", F.explode("components").alias("component", "x")).withColumn("pct_adj", C("x.pct_adj")),
      "SELECT r.*, e.name, e.team, c.component, c.pct_adj FROM {ratings} r JOIN {entities} e ON r.entity_id = e.entity_id JOIN {component_pcts} c ON r.entity_id = c.entity_id AND r.period = c.period")
apart("doc4_player_index", "#entity_id name team #latest periods *talent", lambda w: serving.player_index(w.ratings, w.entities, w.talent).withColumn("periods", F.array_join("periods", ",")),
      "SELECT r.entity_id, any_value(e.name) AS name, any_value(e.team) AS team, max(period) AS latest, string_agg(DISTINCT CAST(period AS VARCHAR), ',' ORDER BY CAST(period AS VARCHAR) DESC) AS periods, any_value(t.talent) AS talent FROM {ratings} r JOIN {entities} e ON r.entity_id = e.entity_id LEFT JOIN {talent} t ON r.entity_id = t.entity_id GROUP BY r.entity_id")
apart("doc5_profile_document", "#entity_id season *score #rank_adjusted status *exposure *talent *talent_low *talent_high", lambda w: payload.written(serving.profile_documents(w.ratings, w.talent), "json").select("entity_id", "talent.*", F.explode("seasons").alias("season", "x")).select("*", "x.*"),
      "SELECT r.*, CAST(period AS VARCHAR) AS season, talent, talent_low, talent_high FROM {ratings} r LEFT JOIN {talent} t ON r.entity_id = t.entity_id")
apart("doc6_methodology_document", "component *k source *s2 *tau2 *mean *split_half *drift", lambda w: payload.written(serving.methodology_document(w.params), "json").select(F.explode("components").alias("component", "x")).select("component", "x.*"), "SELECT * FROM {params}")
apart("doc7_traditional_points", "#entity_id *score *conceded_rate", lambda w: w.ratings.filter((C("period") == P.final) & C("in_pool")),
      "SELECT entity_id, score, conceded_rate FROM {ratings} WHERE period = 2000 AND in_pool")

# --- views and analyst queries
_V1 = "SELECT r.entity_id, r.period, e.name, e.team, r.score, r.rank_adjusted, r.status, s.exposure, s.shots, s.conceded FROM {ratings} r JOIN {entities} e ON r.entity_id = e.entity_id LEFT JOIN {season} s ON r.entity_id = s.entity_id AND r.period = s.period"
both("vie1_season_leaderboard", "#entity_id #period name team *score #rank_adjusted status *exposure #shots #conceded", _V1)
both("vie2_component_matrix", "#entity_id #period component *adj_rate *pct_adj *score", "SELECT c.entity_id, c.period, c.component, c.adj_rate, c.pct_adj, r.score FROM {component_pcts} c JOIN {ratings} r ON c.entity_id = r.entity_id AND c.period = r.period")
both("vie3_rank_disagreement", "#entity_id #period #rank_disagreement direction #rank_adjusted #rank_conceded", "SELECT entity_id, period, rank_disagreement, CASE WHEN rank_disagreement > 0 THEN 'underrated' WHEN rank_disagreement < 0 THEN 'overrated' ELSE 'agree' END AS direction, rank_adjusted, rank_conceded FROM {ratings} WHERE status IN ('qualified', 'provisional') AND rank_disagreement IS NOT NULL")
both("vie4_talent_board", "#entity_id name #talent_rank *talent *talent_pct", "SELECT t.entity_id, e.name, t.talent_rank, t.talent, t.talent_pct FROM {talent_ranked} t JOIN {entities} e ON t.entity_id = e.entity_id")
query("vie5_match_form", "#entity_id #period #event_id @event_date ~cum_rate ~rolling_mean ~rolling_weighted", lambda w: w.form, "form")
query("vie6_scraped_rows", "#page_id label", lambda w: pages.html_rows(w.table("pages")).filter("is_target"), "(SELECT page_id, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2)) AS label FROM pages WHERE html LIKE '%<nav>%' AND html LIKE '%<article>%') WHERE length(label) <= 3) x")
apart("qry1_club_evaluation", "#entity_id #period name *score", lambda w: serving.club_filter(w.ratings.filter("status IN ('qualified', 'provisional')").join(w.entities, "entity_id"), ["NATION_3", "NATION_21"], "tion_1"),
      "SELECT r.entity_id, r.period, e.name, r.score FROM {ratings} r JOIN {entities} e ON r.entity_id = e.entity_id WHERE r.status IN ('qualified', 'provisional') AND (team IN ('NATION_3', 'NATION_21') OR contains(lower(team), 'tion_1'))")
both("qry2_underrated", "#entity_id *score #rank_disagreement", "SELECT entity_id, score, rank_disagreement FROM {ratings} WHERE period = 2000 AND rank_disagreement IS NOT NULL ORDER BY rank_disagreement DESC, entity_id LIMIT 15")
both("qry3_component_profile", "#entity_id *a_f *n_o", "SELECT entity_id, max(CASE WHEN component = 'a_f' THEN pct_adj END) AS a_f, max(CASE WHEN component = 'n_o' THEN pct_adj END) AS n_o FROM {component_pcts} WHERE period = 2000 GROUP BY entity_id")
both("qry4_year_over_year", "#entity_id #period *score *d_score *d_rate", "WITH r AS (SELECT entity_id, period, score, adj_total FROM {ratings}) SELECT entity_id, period, score, score - lag(score) OVER (PARTITION BY entity_id ORDER BY period) AS d_score, adj_total - lag(adj_total) OVER (PARTITION BY entity_id ORDER BY period) AS d_rate FROM r")
both("qry5_talent_shortlist", "#entity_id *talent #talent_rank", "SELECT entity_id, talent, talent_rank FROM {talent_ranked} ORDER BY talent_rank, entity_id LIMIT 20")
both("qry6_rolling_form", "#event_id ~rolling_weighted", "SELECT event_id, rolling_weighted FROM {form} WHERE period = 2000 AND entity_id IN (SELECT entity_id FROM (SELECT s.entity_id FROM {season} s JOIN {entities} e ON s.entity_id = e.entity_id WHERE s.period = 2000 AND e.team LIKE '%A%' ORDER BY s.exposure DESC, s.entity_id LIMIT 1) t) ORDER BY event_date DESC, event_id DESC LIMIT 8")
query("qry7_roster_fuzzy", "#roster_id #entity_id *score", lambda w: joins.fuzzy_name_join(w.table("part").select(C("p_partkey").cast("bigint").alias("roster_id"), F.concat_ws(" ", F.lit("Any"), F.lpad((C("p_partkey") % 100).cast("string"), 3, "0")).alias("roster_name")), w.entities.select(spark_column("#entity_id"), "name").join(w.ratings.filter("period = 2000").select("entity_id", spark_column("*score")), "entity_id", "left")),
      "(SELECT m.roster_id, m.entity_id, r.score FROM (SELECT DISTINCT p_partkey AS roster_id, entity_id FROM part JOIN entities ON contains(lower(name), lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0'))) m LEFT JOIN ratings r ON r.entity_id = m.entity_id AND r.period = 2000) x", ready=True)
both("qry8_report_pulls", "#entity_id #period *score #rank_adjusted", "SELECT entity_id, period, score, rank_adjusted FROM {ratings} WHERE period >= 1999 AND status = 'qualified'")
both("evt1_user_day_form", "#user_id @day *value *running", "SELECT user_id, day, value, sum(value) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {user_days}")


def _live(w):
    from statloom.streaming.live import refreshed

    return refreshed(w.spark, f"{w.dir}/events.parquet")


query("str1_live_refresh", "#user_id #n *value", _live, "(SELECT user_id, count(DISTINCT event_id) AS n, sum(value) AS value FROM events GROUP BY user_id) x")
_ = (pct, rates)
