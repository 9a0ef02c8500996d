"""DuckDB SQL of the derived tables, written apart from the DataFrame code, as common table expressions."""

from __future__ import annotations

import re
from statistics import NormalDist

from statloom.operators.archetypes import ROUNDS
from statloom.plans.params import COMPONENTS, DEFAULT

P = DEFAULT
Z = NormalDist().inv_cdf(0.5 + P.interval / 2)
_VALUES = ", ".join(f"('{c}', {P.fallback_k[c]}, {P.volume_fallback[c]})" for c in COMPONENTS)
_H = f"period BETWEEN {P.history[0]} AND {P.history[1]}"


def tilt(signal: float) -> str:
    """What sets entities apart in a value, by the strength of the signal."""
    return f"{signal} * ((entity_id % 7) - 3)"


def corr(x: str, y: str, least: int) -> str:
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN count(*) {both} >= {least} AND var_pop({x}) {both} > 1e-15 AND var_pop({y}) {both} > 1e-15 THEN covar_pop({x}, {y}) {both} / (stddev_pop({x}) {both} * stddev_pop({y}) {both}) END"


def pct(keys: str, key: str) -> str:
    w = f"CASE WHEN in_pool AND {key} IS NOT NULL AND exposure > 0 THEN exposure ELSE 0 END"
    return f"CASE WHEN {key} IS NOT NULL THEN 100 * (sum({w}) OVER (PARTITION BY {keys} ORDER BY {key} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum({w}) OVER (PARTITION BY {keys}, {key}) / 2) / sum({w}) OVER (PARTITION BY {keys}) END"


def rank(value: str, direction: str, keys: str = "period") -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {value} {direction} NULLS LAST) END"


def _kmeans(rounds: int = ROUNDS) -> dict[str, str]:
    """All models of archetypes.fit_kmeans, a table a round; a model is k and its start."""
    prime, dims = 2147483647, range(1, len(P.components) + 1)
    h0 = f"(entity_id % {prime} * 69621 + start * 1000003 + k * 7919 + {P.seed}) % {prime}"
    h1 = f"(({h0}) * ({h0}) + {12345 + 777}) % {prime}"
    near = "SELECT entity_id, v, k, start, arg_min(cluster, (round(d, 9), cluster)) AS cluster, min(d) AS d FROM (SELECT e.entity_id, e.v, c.k, c.start, c.cluster, {d} AS d FROM km_vectors e CROSS JOIN {t} c) GROUP BY entity_id, v, k, start"
    d = " + ".join(f"(e.v[{i}] - c.c[{i}]) ** 2" for i in dims)
    out = {
        "km_vectors": "SELECT entity_id, list(z ORDER BY component) AS v FROM z GROUP BY entity_id",
        "km_hashed": f"SELECT entity_id, v, k, start, (h * h + {12345 + 1554}) % {prime} AS h FROM (SELECT entity_id, v, k, start, {h1} AS h FROM km_vectors, range(3, 7) a(k), range(25) b(start))",
        "km_centres0": "SELECT k, start, CAST(n - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY k, start ORDER BY h, entity_id) AS n FROM km_hashed) WHERE n <= k",
    }
    for r in range(rounds):
        out[f"km_near{r}"] = near.format(d=d, t=f"km_centres{r}")
        out[f"km_mean{r}"] = f"SELECT k, start, cluster, [{', '.join(f'avg(v[{i}])' for i in dims)}] AS c FROM km_near{r} GROUP BY k, start, cluster"
        out[f"km_centres{r + 1}"] = f"SELECT k, start, cluster, coalesce(m.c, o.c) AS c FROM km_centres{r} o LEFT JOIN km_mean{r} m USING (k, start, cluster)"
    out["km_last"] = near.format(d=d, t=f"km_centres{rounds}")
    out["km_heads"] = "SELECT k, arg_min(start, (round(cost, 6), start)) AS start FROM (SELECT k, start, sum(d) AS cost FROM km_last GROUP BY k, start) GROUP BY k"
    out["km_members"] = "SELECT entity_id, v, k, cluster FROM km_last JOIN km_heads USING (k, start)"
    far = " + ".join(f"(p.v[{i}] - q.v[{i}]) ** 2" for i in dims)
    out["km_far"] = f"SELECT p.k, p.entity_id, p.cluster, q.cluster AS other, sum({far}) AS d, count(*) AS n FROM km_members p JOIN km_members q ON p.k = q.k GROUP BY ALL"
    out["km_scores"] = "SELECT k, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS score FROM (SELECT k, entity_id, max(d / nullif(n - 1, 0)) FILTER (cluster = other) AS a, min(d / n) FILTER (cluster <> other) AS b FROM km_far GROUP BY k, entity_id) GROUP BY k"
    out["km_chosen"] = "SELECT entity_id, cluster, k FROM km_members WHERE k = (SELECT arg_max(k, (round(score, 4), -k)) FROM km_scores) AND (SELECT count(*) FROM km_vectors) > 7"
    return out


CTES: dict[str, str] = {
    "lines": """SELECT l_suppkey AS entity_id, CAST(year(l_shipdate) AS INTEGER) AS period, l_orderkey AS event_id, CAST(l_shipdate AS DATE) AS ship_date, lower(l_returnflag || '_' || l_linestatus) AS component,
        l_quantity AS q, l_discount AS disc, l_tax AS tax, l_returnflag = 'R' AS returned FROM lineitem""",
    "matches": "SELECT entity_id, period, event_id, min(ship_date) AS event_date, sum(q) AS exposure, count(*) AS shots, count_if(returned) AS conceded, count(*) - count_if(returned) AS saves, sum(tax) / 0.12 AS expected FROM lines GROUP BY ALL",
    "season": "SELECT entity_id, period, min(ship_date) AS event_date, max(ship_date) AS last_date, sum(q) AS exposure, count(*) AS shots, count_if(returned) AS conceded, count(*) - count_if(returned) AS saves, sum(tax) / 0.12 AS expected FROM lines GROUP BY ALL",
    "match_c": f"SELECT c.*, m.event_date, m.exposure FROM (SELECT entity_id, period, event_id, component, sum(disc - 0.05 + {tilt(P.signal)}) AS value, sum(disc) AS raw_value, count(*) AS opps FROM lines GROUP BY ALL) c JOIN matches m USING (entity_id, period, event_id)",
    "season_c": f"SELECT c.*, s.exposure FROM (SELECT entity_id, period, component, sum(disc - 0.05 + {tilt(P.signal)}) AS value, sum(disc) AS raw_value, count(*) AS opps FROM lines GROUP BY ALL) c JOIN season s USING (entity_id, period)",
    "entities": "SELECT s_suppkey AS entity_id, s_name AS name, n_nationkey AS team_id, n_name AS team, n_regionkey AS club_id FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "match_club": "SELECT m.*, n_regionkey AS club FROM matches m LEFT JOIN (orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) ON event_id = o_orderkey",
    "stints": """SELECT entity_id, period, stint, club, count(*) AS appearances, sum(exposure) AS exposure, min(event_date) AS first_date, max(event_date) AS last_date FROM (
        SELECT *, sum(ch) OVER (PARTITION BY entity_id, period ORDER BY event_date, event_id ROWS UNBOUNDED PRECEDING) AS stint FROM (
        SELECT *, CASE WHEN club = lag(club) OVER (PARTITION BY entity_id, period ORDER BY event_date, event_id) THEN 0 ELSE 1 END AS ch FROM match_club)) GROUP BY entity_id, period, stint, club""",
    "totals": f"""SELECT t.*, s.exposure, total_value / nullif(s.exposure, 0) * {P.basis} AS total_rate FROM (SELECT entity_id, period, CASE WHEN count(value) = 6 THEN sum(value) END AS total_value, CASE WHEN count(raw_value) = 6 THEN sum(raw_value) END AS total_raw,
        sum(opps) AS total_opps, count(value) = 6 AS components_complete FROM season_c GROUP BY entity_id, period) t JOIN season s USING (entity_id, period)""",
    "rates": f"SELECT *, value / exposure * {P.basis} AS value_rate, opps / exposure * {P.basis} AS opp_rate FROM season_c",
    "traditional": f"SELECT *, conceded / exposure * {P.basis} AS conceded_rate, shots / exposure * {P.basis} AS shots_rate, expected / exposure * {P.basis} AS expected_rate, saves * 100.0 / nullif(shots, 0) AS save_pct, expected - conceded AS prevented, (expected - conceded) / exposure * {P.basis} AS prevented_rate FROM season",
    "within": f"""SELECT component, CASE WHEN sum(m - 1) > 0 AND sum(q - g * g / n) > 0 THEN sum(q - g * g / n) / sum(m - 1) END AS s2, count(*) AS n_groups, sum(m) AS n_matches FROM (
        SELECT entity_id, period, component, count(*) AS m, sum(value * value / opps) AS q, sum(value) AS g, sum(opps) AS n FROM match_c WHERE {_H} GROUP BY ALL HAVING count(*) >= {P.min_matches}) GROUP BY component""",
    "between_": f"""SELECT component, (observed - n * s2 / w) / (1 - w2 / (w * w)) AS tau2, mean, n AS n_used FROM (
        SELECT component, any_value(mean) AS mean, count(*) AS n, sum(opps) AS w, sum(CAST(opps AS DOUBLE) * opps) AS w2, sum(opps * (value / opps - mean) ** 2) / sum(opps) AS observed FROM (
        SELECT *, sum(value) OVER (PARTITION BY component) / sum(opps) OVER (PARTITION BY component) AS mean FROM season_c WHERE {_H} AND exposure >= {P.min_exposure} AND opps >= {P.min_opps}) GROUP BY component) JOIN within USING (component)""",
    "halves": f"""SELECT component, CASE WHEN abs(r) < 0.005 THEN 0 ELSE r END AS split_half FROM (SELECT component, {corr("x", "y", 10)} AS r FROM (
        SELECT entity_id, period, component, count(*) AS m, sum(value) FILTER (rn % 2 = 1) / sum(opps) FILTER (rn % 2 = 1) AS x, sum(value) FILTER (rn % 2 = 0) / sum(opps) FILTER (rn % 2 = 0) AS y FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id, period, component ORDER BY event_date, event_id) AS rn FROM match_c WHERE {_H}) GROUP BY ALL HAVING count(*) >= {max(2 * P.min_matches, 6)}) GROUP BY component)""",
    "yoy": f"SELECT component, {corr('x', 'y', 10)} AS year_over_year FROM (SELECT a.component, a.value / a.opps AS x, b.value / b.opps AS y FROM season_c a JOIN season_c b ON a.entity_id = b.entity_id AND a.component = b.component AND b.period = a.period + 1 WHERE a.{_H} AND b.{_H} AND a.exposure >= 900 AND b.exposure >= 900) GROUP BY component",
    "pairs": f"SELECT component, count(*) AS pairs, var_samp(y - x) AS dv, avg(1 / nx + 1 / ny) AS inv FROM (SELECT a.component, a.value / a.opps AS x, b.value / b.opps AS y, a.opps AS nx, b.opps AS ny FROM season_c a JOIN season_c b ON a.entity_id = b.entity_id AND a.component = b.component AND b.period = a.period + 1 WHERE a.{_H} AND b.{_H} AND a.exposure >= {P.drift_exposure} AND b.exposure >= {P.drift_exposure} AND a.opps >= {P.min_opps} AND b.opps >= {P.min_opps}) GROUP BY component",
    "pool_means": f"SELECT component, sum(value) / sum(opps) AS pool_mean, sum(opps) / sum(exposure) * {P.basis} AS league_rate FROM season_c WHERE {_H} GROUP BY component",
    "vol_within": f"""SELECT component, CASE WHEN sum(m - 1) > 0 AND sum(q - g * g / w) > 0 THEN sum(q - g * g / w) / sum(m - 1) END AS sampling, count(*) AS volume_groups FROM (
        SELECT entity_id, period, component, count(*) AS m, sum(exposure * (opps / exposure * {P.basis}) ** 2) AS q, sum(opps * {P.basis}) AS g, sum(exposure) AS w FROM match_c WHERE {_H} AND exposure > 0 GROUP BY ALL HAVING count(*) >= {P.min_matches}) GROUP BY component""",
    "volumes": f"""SELECT component, CASE WHEN sound THEN sampling / talent ELSE vf END AS k_exposure, CASE WHEN sound THEN 'empirical' ELSE 'fallback' END AS volume_source, sampling, talent, league_rate, volume_groups FROM (
        SELECT *, coalesce(talent > 0 AND volume_groups >= {P.min_groups} AND sampling / talent BETWEEN {P.volume_range[0]} AND {P.volume_range[1]}, false) AS sound FROM (
        SELECT component, (observed - n * sampling / w) / (1 - w2 / (w * w)) AS talent, sampling, volume_groups, league_rate, vf FROM (
        SELECT component, count(*) AS n, sum(exposure) AS w, sum(exposure * exposure) AS w2, sum(exposure * (opps / exposure * {P.basis} - mean) ** 2) / sum(exposure) AS observed FROM (
        SELECT *, sum(opps * {P.basis}) OVER (PARTITION BY component) / sum(exposure) OVER (PARTITION BY component) AS mean FROM season_c WHERE {_H} AND exposure >= {P.min_exposure}) GROUP BY component)
        JOIN vol_within USING (component) JOIN pool_means USING (component) JOIN (VALUES {_VALUES}) f(component, kf, vf) USING (component)))""",
    "params": f"""SELECT *, median_opps / (median_opps + k) AS reliability_at_median, CASE WHEN split_half > -1 THEN 2 * split_half / (1 + split_half) END AS spearman_brown, 900 / (900 + k_exposure) AS reliability_900,
        CASE WHEN tau2 IS NULL OR tau2 <= 0 THEN 0 WHEN s2 IS NULL OR pairs IS NULL OR pairs < 10 THEN tau2 * {P.drift_fallback} WHEN dv - s2 * inv < tau2 * {P.drift_floor} THEN tau2 * {P.drift_floor} WHEN dv - s2 * inv > tau2 THEN tau2 ELSE dv - s2 * inv END AS drift,
        CASE WHEN tau2 IS NULL OR tau2 <= 0 THEN 'unavailable' WHEN s2 IS NULL OR pairs IS NULL OR pairs < 10 THEN 'fallback_share_of_talent_variance' WHEN dv - s2 * inv < tau2 * {P.drift_floor} THEN 'clamped_to_floor' WHEN dv - s2 * inv > tau2 THEN 'clamped_to_talent_variance' ELSE 'empirical' END AS drift_source
        FROM (SELECT *, CASE WHEN reason = 'empirical' THEN s2 / tau2 ELSE kf END AS k, CASE WHEN reason = 'empirical' THEN 'empirical' ELSE 'fallback' END AS source FROM (
        SELECT *, CASE WHEN s2 IS NULL THEN 'no_variance' WHEN tau2 IS NULL OR tau2 <= 0 THEN 'no_talent_variance' WHEN n_groups < {P.min_groups} THEN 'too_few_groups' WHEN s2 / tau2 < {P.k_range[0]} OR s2 / tau2 > {P.k_range[1]} THEN 'out_of_range'
        WHEN split_half IS NULL OR split_half < {P.min_split_half} THEN 'no_repeatability' ELSE 'empirical' END AS reason
        FROM within JOIN between_ USING (component) LEFT JOIN halves USING (component) LEFT JOIN yoy USING (component) LEFT JOIN pairs USING (component) JOIN volumes USING (component) JOIN (VALUES {_VALUES}) f(component, kf, vf) USING (component)
        LEFT JOIN (SELECT component, median(opps) AS median_opps FROM season_c WHERE {_H} AND exposure >= {P.regular_exposure} GROUP BY component) USING (component)))""",
    "total": f"""SELECT CASE WHEN direct > 0 THEN direct ELSE coalesce(derived, 0) END AS total_tau2, CASE WHEN direct > 0 THEN 'empirical' WHEN derived > 0 THEN 'component_derived' ELSE 'unavailable' END AS total_source,
        (CASE WHEN direct > 0 THEN direct ELSE coalesce(derived, 0) END) * CASE WHEN direct > 0 THEN {P.drift_floor} ELSE {P.drift_fallback} END AS total_drift
        FROM (SELECT CASE WHEN count(*) >= 5 THEN (sum(w * (total_rate - mean) ** 2) / sum(w) - count(*) / sum(w)) / (1 - sum(w * w) / (sum(w) * sum(w))) END AS direct FROM (
        SELECT total_rate, w, sum(total_rate * w) OVER () / sum(w) OVER () AS mean FROM (SELECT t.total_rate, 1 / (({P.basis} / t.exposure) ** 2 * ns) AS w FROM totals t JOIN (SELECT entity_id, period, sum(opps * s2) AS ns FROM season_c JOIN params USING (component) GROUP BY ALL) n USING (entity_id, period)
        WHERE t.exposure >= {P.min_exposure} AND total_rate IS NOT NULL AND {_H}))), (SELECT sum(tau2 * ({P.basis} * mo / greatest(me, 1)) ** 2) FILTER (tau2 > 0) AS derived FROM (SELECT component, median(opps) AS mo, median(exposure) AS me FROM season_c WHERE exposure >= {P.min_exposure} AND {_H} GROUP BY component) JOIN params USING (component))""",
    "bars": f"SELECT period, CASE WHEN period = {P.live} THEN 'scaled' ELSE 'fixed' END AS mode, CASE WHEN period = {P.live} THEN greatest(max(exposure) * {P.live_shares[0]}, {P.live_floors[0]}) ELSE {P.final_bars[0]} END AS qualified_bar, CASE WHEN period = {P.live} THEN greatest(max(exposure) * {P.live_shares[1]}, {P.live_floors[1]}) ELSE {P.final_bars[1]} END AS provisional_bar, max(exposure) AS max_exposure FROM season GROUP BY period",
    "status": "SELECT * EXCLUDE (st), st AS status, st <> 'limited' OR NOT max(st <> 'limited') OVER (PARTITION BY period) AS in_pool FROM (SELECT s.*, CASE WHEN exposure >= qualified_bar THEN 'qualified' WHEN exposure >= provisional_bar THEN 'provisional' ELSE 'limited' END AS st FROM season s JOIN bars USING (period))",
    "dense": f"SELECT g.entity_id, g.period, g.component, g.exposure, g.status, g.in_pool, c.value, c.raw_value, c.opps FROM (SELECT entity_id, period, exposure, status, in_pool, unnest([{', '.join(repr(c) for c in COMPONENTS)}]) AS component FROM status) g LEFT JOIN season_c c ON g.entity_id = c.entity_id AND g.period = c.period AND g.component = c.component",
    "baseline": f"""SELECT period, component, CASE WHEN pool_size >= {P.min_pool} THEN coalesce(pm, 0) ELSE mean END AS mu, CASE WHEN pool_size >= {P.min_pool} THEN coalesce(pr, 0) ELSE league_rate END AS league_workload, pool_size, CASE WHEN pool_size >= {P.min_pool} THEN 'period_pool' ELSE 'historical_pool' END AS baseline_source
        FROM (SELECT period, component, count(DISTINCT entity_id) AS pool_size, sum(value) FILTER (opps > 0) / sum(opps) FILTER (value IS NOT NULL) AS pm, sum(opps) / sum(exposure) FILTER (opps IS NOT NULL) * {P.basis} AS pr FROM dense WHERE in_pool GROUP BY period, component) JOIN params USING (component)""",
    "shrunk": f"""SELECT *, adj_value * adj_opp_rate AS adj_rate, mu * adj_opp_rate AS base_rate FROM (SELECT *, coalesce(mu + weight * (observed_value - mu), mu) AS adj_value, league_workload + exposure / (exposure + k_exposure) * coalesce(opps / exposure * {P.basis} - league_workload, 0) AS adj_opp_rate, value / exposure * {P.basis} AS obs_rate FROM (
        SELECT d.*, k, k_exposure, s2, mu, league_workload, coalesce(opps, 0) / (coalesce(opps, 0) + k) AS weight, value / nullif(opps, 0) AS observed_value FROM dense d JOIN params USING (component) JOIN (SELECT period, component, mu, league_workload FROM baseline) USING (period, component)))""",
    "shrunk_totals": f"""SELECT *, total_tau2 / (total_tau2 + sampling_variance) AS total_reliability FROM (SELECT entity_id, period, any_value(exposure) AS exposure, any_value(status) AS status, bool_or(in_pool) AS in_pool, sum(adj_rate) AS adj_total, sum(base_rate) AS base_total, CASE WHEN count(value) = 6 THEN sum(obs_rate) END AS obs_total,
        ({P.basis} / any_value(exposure)) ** 2 * sum(coalesce(opps, 0) * s2) AS sampling_variance FROM shrunk GROUP BY entity_id, period), (SELECT total_tau2 FROM total)""",
    "component_pcts": f"SELECT *, {pct('period, component', 'ak')} AS pct_adj, {pct('period, component', 'ok')} AS pct_obs FROM (SELECT *, round(adj_rate, 12) AS ak, round(obs_rate, 12) AS ok FROM shrunk)",
    "ratings": f"""SELECT *, rank_conceded_pool - rank_adjusted_pool AS rank_disagreement FROM (SELECT *, {pct("period", "adj_total")} AS score, {pct("period", "obs_total")} AS observed_pct, {rank("adj_total", "DESC")} AS rank_adjusted, {rank("obs_total", "DESC")} AS rank_observed, {rank("conceded_rate", "ASC")} AS rank_conceded, {rank("save_pct", "DESC")} AS rank_save_pct,
        CASE WHEN in_pool THEN {rank("CASE WHEN in_pool THEN conceded_rate END", "ASC")} END AS rank_conceded_pool, CASE WHEN in_pool THEN {rank("CASE WHEN in_pool THEN adj_total END", "DESC")} END AS rank_adjusted_pool, CASE WHEN in_pool THEN {rank("CASE WHEN in_pool THEN obs_total END", "DESC")} END AS rank_observed_pool
        FROM shrunk_totals JOIN (SELECT entity_id, period, conceded_rate, save_pct FROM traditional) USING (entity_id, period))""",
    "league": f"SELECT coalesce(sum(exposure * obs_total) FILTER (exposure >= 900) / sum(exposure) FILTER (exposure >= 900), sum(exposure * obs_total) / sum(exposure), 0) AS league_mean FROM shrunk_totals WHERE period = {P.final} AND obs_total IS NOT NULL",
    "talent": f"""SELECT *, talent - {Z!r} * talent_sd AS talent_low, talent + {Z!r} * talent_sd AS talent_high FROM (SELECT entity_id, prior_rate, live_rate, prior_exposure, live_exposure, league_mean, (p * league_mean + a * coalesce(prior_rate, 0) + b * coalesce(live_rate, 0)) / (p + a + b) AS talent, sqrt(1 / (p + a + b)) AS talent_sd, p / (p + a + b) AS weight_league, a / (p + a + b) AS weight_prior, b / (p + a + b) AS weight_live,
        CASE WHEN a > 0 THEN 'history' ELSE 'new' END AS prior_source, coalesce(live_exposure, 0) + coalesce(prior_exposure, 0) AS evidence_exposure, live_exposure IS NOT NULL AS in_live FROM (
        SELECT coalesce(x.entity_id, y.entity_id) AS entity_id, x.obs_total AS prior_rate, y.obs_total AS live_rate, x.exposure AS prior_exposure, y.exposure AS live_exposure, league_mean, 1 / total.total_tau2 AS p, CASE WHEN x.obs_total IS NOT NULL THEN 1 / (x.sampling_variance + total_drift) ELSE 0 END AS a, CASE WHEN y.obs_total IS NOT NULL AND y.sampling_variance > 0 THEN 1 / y.sampling_variance ELSE 0 END AS b
        FROM (SELECT * FROM shrunk_totals WHERE period = {P.final}) x FULL JOIN (SELECT * FROM shrunk_totals WHERE period = {P.live}) y ON x.entity_id = y.entity_id CROSS JOIN total CROSS JOIN league WHERE total.total_tau2 > 0))""",
    "talent_ranked": """SELECT t.*, rank() OVER (ORDER BY talent DESC) AS talent_rank, 100 * (SELECT sum(CASE WHEN q.talent < t.talent THEN q.evidence_exposure WHEN q.talent = t.talent THEN q.evidence_exposure / 2 ELSE 0 END) / sum(q.evidence_exposure) FROM pool q) AS talent_pct,
        100 * (SELECT sum(CASE WHEN q.talent < t.talent_low THEN q.evidence_exposure WHEN q.talent = t.talent_low THEN q.evidence_exposure / 2 ELSE 0 END) / sum(q.evidence_exposure) FROM pool q) AS talent_pct_low,
        100 * (SELECT sum(CASE WHEN q.talent < t.talent_high THEN q.evidence_exposure WHEN q.talent = t.talent_high THEN q.evidence_exposure / 2 ELSE 0 END) / sum(q.evidence_exposure) FROM pool q) AS talent_pct_high FROM talent t""",
    "pool": "SELECT talent, evidence_exposure FROM talent WHERE in_live OR (SELECT count_if(in_live) < 10 FROM talent)",
    "match_totals": "SELECT m.*, v.value FROM matches m JOIN (SELECT entity_id, period, event_id, sum(coalesce(value, 0)) AS value FROM match_c GROUP BY ALL) v USING (entity_id, period, event_id)",
    "form": f"""SELECT *, row_number() OVER w AS match_no, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_value, sum(exposure) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_exposure, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) / sum(exposure) OVER (w ROWS UNBOUNDED PRECEDING) * {P.basis} AS cum_rate,
        avg(value / exposure * {P.basis}) OVER (w ROWS 4 PRECEDING) AS rolling_mean, sum(value) OVER (w ROWS 4 PRECEDING) / sum(exposure) OVER (w ROWS 4 PRECEDING) * {P.basis} AS rolling_weighted FROM match_totals WINDOW w AS (PARTITION BY entity_id, period ORDER BY event_date, event_id)""",
    "draws": f"""SELECT entity_id, period, b, (x3 % n) AS j FROM (SELECT *, (x2 * x2 + {12345 + 777 * 3}) % 2147483647 AS x3 FROM (SELECT *, (x1 * x1 + {12345 + 777 * 2}) % 2147483647 AS x2 FROM (SELECT *, (x0 * x0 + {12345 + 777}) % 2147483647 AS x1 FROM (
        SELECT entity_id, period, b, n, (entity_id * 69621 + period * 7919 + b * 1000003 + j * 48271 + {P.seed}) % 2147483647 AS x0 FROM indexed, range({P.resamples}) r(b)))))""",
    "indexed": f"SELECT entity_id, CAST(period AS BIGINT) AS period, value AS v, exposure AS e, row_number() OVER (PARTITION BY entity_id, period ORDER BY event_date, event_id) - 1 AS j, count(*) OVER (PARTITION BY entity_id, period) AS n FROM match_totals WHERE period IN ({P.final}, {P.live})",
    "boot": f"SELECT entity_id, period, quantile_cont(stat, {(1 - P.interval) / 2}) AS boot_low, quantile_cont(stat, {1 - (1 - P.interval) / 2}) AS boot_high, stddev_samp(stat) AS boot_se FROM (SELECT d.entity_id, d.period, d.b, sum(i.v) / nullif(sum(i.e), 0) * {P.basis} AS stat FROM draws d JOIN indexed i USING (entity_id, period, j) WHERE i.n >= 2 GROUP BY ALL) GROUP BY entity_id, period",
    "boot_mean": f"SELECT entity_id, period, quantile_cont(stat, {(1 - P.interval) / 2}) AS boot_low, quantile_cont(stat, {1 - (1 - P.interval) / 2}) AS boot_high, stddev_samp(stat) AS boot_se FROM (SELECT d.entity_id, d.period, d.b, avg(i.v / i.e * {P.basis}) AS stat FROM draws d JOIN indexed i USING (entity_id, period, j) WHERE i.n >= 3 GROUP BY ALL) GROUP BY entity_id, period",
    "snapshots": "SELECT period, make_date(period + 1, 1, 1) AS captured_at, entity_id, rank_adjusted AS rank, round(score, 1) AS score, round(adj_total, 4) AS rate, round(exposure, 1) AS exposure FROM ratings",
    "z": f"SELECT entity_id, component, x, (x - avg(x) OVER (PARTITION BY component)) / (CASE WHEN stddev_pop(x) OVER (PARTITION BY component) > 1e-12 THEN stddev_pop(x) OVER (PARTITION BY component) ELSE 1 END) AS z FROM (SELECT entity_id, component, opp_rate AS x, count(opp_rate) OVER (PARTITION BY entity_id) AS n FROM rates WHERE period = {P.final} AND exposure >= {P.regular_exposure}) WHERE n = 6",
    "seeds": "SELECT CAST(entity_id % 4 AS INTEGER) AS cluster, component, avg(z) AS c FROM z GROUP BY ALL",
    "clusters": "SELECT entity_id, cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(d2, 9), cluster) AS r FROM (SELECT entity_id, cluster, sum((z - c) ** 2) AS d2 FROM z JOIN seeds USING (component) GROUP BY ALL)) WHERE r = 1",
    **_kmeans(),
    "user_days": "SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value, count(*) AS n FROM events GROUP BY ALL",
}
_NAME = re.compile(r"\b(?:FROM|JOIN)\s+\(?\s*(" + "|".join(CTES) + r")\b")


def with_ctes(sql: str) -> str:
    """`sql` with the tables that it needs before it."""
    order: list[str] = []

    def need(text: str, own: str = ""):
        for name in dict.fromkeys(_NAME.findall(text)):
            if name != own and name not in order:
                need(CTES[name], name)
                order.append(name)

    need(sql)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" if order else "") + sql
