"""Filters, orders, notes and documents of the serving layer; what a user sets is a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.scalars import band
from statloom.operators.rank import numbered
from statloom.operators.scouting import fit_score

#: Sort keys of the leaderboard: rank, score, name, exposure and the other columns that a board shows.
SORT_KEYS = (
    "rank_adjusted", "score", "name", "exposure", "adj_total", "obs_total", "total_reliability", "observed_pct",
    "rank_observed", "rank_conceded", "rank_disagreement", "conceded_rate", "save_pct", "a_f", "n_o", "r_f",
)


def search_text(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with `needle`, ignoring case and outer blanks, in one of `columns`; an empty needle keeps all."""
    needle = needle.strip().lower()
    if not needle:
        return rows
    return rows.filter(reduce(Column.__or__, (F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns)))


def filter_leaderboard(rows: DataFrame, query: str = "", min_exposure: float = 0, team: str = "all", include_limited: bool = True, team_cols: tuple[str, ...] = ("team",)) -> DataFrame:
    """The board's rows by sample, exposure (missing counts as 0), team and search text."""
    if not include_limited:
        rows = rows.filter(~F.col("status").eqNullSafe("limited"))
    rows = rows.filter(F.coalesce("exposure", F.lit(0.0)) >= min_exposure)
    if team != "all":
        rows = rows.filter(reduce(Column.__or__, (F.coalesce(F.col(c) == team, F.lit(False)) for c in team_cols)))
    return search_text(rows, query, ["name", *team_cols])


def brief_filters(
    rows: DataFrame, query: str = "", include_limited: bool = False, min_exposure: float = 0, min_reliability: float = 0, min_pct: dict[str, float] | None = None,
    min_age: int | None = None, max_age: int | None = None, archetype=None, reference: Column | None = None, min_similarity: float = 0,
) -> DataFrame:
    """Rows that meet all of a brief. A missing percentile fails; a missing age fails if an age is asked for; with a
    reference (its id) the reference itself and rows without a similarity fail; missing exposure and reliability are 0."""
    rows = filter_leaderboard(rows, query, min_exposure, "all", include_limited).filter(F.coalesce("total_reliability", F.lit(0.0)) >= min_reliability)
    for c, least in (min_pct or {}).items():
        rows = rows.filter(F.col(c) >= least)
    if min_age is not None or max_age is not None:
        rows = rows.filter(F.col("age").isNotNull() & F.coalesce(F.col("age") >= F.lit(min_age), F.lit(True)) & F.coalesce(F.col("age") <= F.lit(max_age), F.lit(True)))
    if archetype is not None:
        rows = rows.filter(F.col("archetype").eqNullSafe(archetype))
    if reference is not None:
        rows = rows.filter((F.col("entity_id") != reference) & (F.col("similarity") >= min_similarity))
    return rows


def club_filter(rows: DataFrame, names: list[str], part: str, col: str = "team") -> DataFrame:
    """Rows of the clubs named, or whose club holds `part` in any case."""
    return rows.filter(F.col(col).isin(names) | F.lower(col).contains(part.lower()))


def sort_leaderboard(rows: DataFrame, key: str, ascending: bool = False, id_col: str = "entity_id") -> DataFrame:
    """Rows by one of SORT_KEYS, nulls last either way, ties by id."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key}")
    value = F.round(key, 9) if dict(rows.dtypes)[key] == "double" else F.col(key)
    return rows.orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last(), id_col)


def sort_places(rows: DataFrame, keys: list[str], ascending: bool = False, id_col: str = "entity_id") -> DataFrame:
    """(key, id, pos): each row's place under each sort key."""
    kinds = dict(rows.dtypes)
    values = [F.struct(F.lit(k).alias("key"), (F.round(k, 9) if kinds[k] == "double" else F.col(k).cast("double") if kinds[k] != "string" else F.lit(None).cast("double")).alias("number"), F.when(F.lit(kinds[k] == "string"), F.col(k).cast("string")).alias("word")) for k in keys]
    long = rows.select(id_col, F.explode(F.array(*values)).alias("x")).select(id_col, "x.*")
    order = (lambda c: c.asc_nulls_last()) if ascending else (lambda c: c.desc_nulls_last())
    return numbered(long, ["key"], [order(F.col("number")), order(F.col("word")), F.col(id_col)])


def top_disagreement(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n rows that the rating lifts most above, and the n that it drops most below, their traditional rank."""
    up = F.when(F.col("rank_disagreement") > 0, "up").otherwise("down")
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(F.abs("rank_disagreement")), "entity_id"))
    return rows.filter("rank_disagreement <> 0").withColumn("direction", up).withColumn("n", place).filter(F.col("n") <= n)


def largest_abs_gap(rows: DataFrame, n: int = 12) -> DataFrame:
    return rows.filter("rank_disagreement is not null").withColumn("gap", F.abs("rank_disagreement")).orderBy(F.desc("gap"), "entity_id").limit(n)


def top_n_board(rows: DataFrame, n: int = 5) -> DataFrame:
    return sort_leaderboard(rows.filter(~F.col("status").eqNullSafe("limited")), "score").limit(n)


def underrated(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.filter("rank_disagreement > 0").orderBy(F.desc("rank_disagreement"), "entity_id").limit(n)


def top_k_per_period(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.filter("status = 'qualified'").withColumn("n", F.row_number().over(Window.partitionBy("period").orderBy("rank_adjusted", "entity_id"))).filter(F.col("n") <= k)


def talent_view(talent: DataFrame, entities: DataFrame, live: DataFrame, prior: DataFrame, live_bars: tuple[float, float] = (826, 270), prior_bar: float = 900) -> DataFrame:
    """Talent rows with names and the sample status of the live profile (the prior one first without live exposure), else by exposure."""
    seen = F.coalesce("live_exposure", F.lit(0.0))
    in_live = F.when(seen >= live_bars[0], "qualified").when(seen >= live_bars[1], "provisional").otherwise("limited")
    fallback = F.when(F.col("in_live"), in_live).when(F.coalesce("prior_exposure", F.lit(0.0)) >= prior_bar, "qualified").otherwise("limited")
    one = lambda df, name: df.select("entity_id", F.col("status").alias(name))
    x = talent.join(entities.select("entity_id", "name"), "entity_id").join(one(live, "_live"), "entity_id", "left").join(one(prior, "_prior"), "entity_id", "left")
    return x.withColumn("status", F.coalesce(F.when(seen > 0, F.coalesce("_live", "_prior")).otherwise(F.coalesce("_prior", "_live")), fallback)).drop("_live", "_prior")


def period_change(rows: DataFrame, value: str = "score", key: str = "entity_id", order: str = "period") -> DataFrame:
    """`rows` with the change of `value` since the key's period before."""
    return rows.withColumn(f"{value}_change", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def rank_change(now: DataFrame, then: DataFrame) -> DataFrame:
    """(entity_id, change): places won since `then`; null for entities without a rank there."""
    before = then.select("entity_id", F.col("rank_adjusted").alias("_before"))
    return now.join(before, "entity_id", "left").select("entity_id", (F.col("_before") - F.col("rank_adjusted")).alias("change"))


#: Wording of the notes by band; our own, as is that of match_reasons.
COMPONENT_TEXT = {"elite": "Elite adjusted {} percentile.", "strong": "Strong {} contribution.", "poor": "{} contribution well below the median.", "weak": "{} contribution below the median."}
TOTAL_TEXT = {"elite": "Top-tier complete impact.", "strong": "Above-average complete impact.", "poor": "Complete impact well below the median.", "weak": "Complete impact below the median."}
SAMPLE_TEXT = {"limited": "Limited sample ({} minutes).", "provisional": "Provisional sample ({} minutes).", "large": "Large, reliable sample ({} minutes)."}


def _worded(texts: dict[str, str], by: Column, word: Column) -> Column:
    out = None
    for k, t in texts.items():
        head, _, tail = t.partition("{}")
        value = F.concat(F.lit(head), word, F.lit(tail)) if "{}" in t else F.lit(t)
        out = F.when(by == k, value) if out is None else out.when(by == k, value)
    return out


def build_notes(pcts: DataFrame, ratings: DataFrame, bands: tuple[float, float, float, float], least_opps: int, large: float = 0.75) -> DataFrame:
    """(entity_id, period, kind, position, component, percentile, band, opportunities, text), strengths and concerns apart.

    The total comes first if it is in a band, then components with enough opportunities, the most outstanding first,
    then what the sample is worth."""
    kind = F.when(F.col("band").isin("elite", "strong"), "strength").otherwise("concern")
    keys = ["entity_id", "period"]
    parts = pcts.filter((F.col("opps") >= least_opps) & F.col("pct_adj").isNotNull()).select(*keys, "component", F.round("pct_adj", 1).alias("percentile"), band(F.col("pct_adj"), bands).alias("band"), F.col("opps").cast("long").alias("opportunities"), F.lit(1).alias("_part"))
    parts = parts.filter("band is not null").withColumns({"kind": kind, "text": _worded(COMPONENT_TEXT, F.col("band"), F.col("component"))})
    none = F.lit(None)
    total = ratings.select(*keys, F.lit("total").alias("component"), F.round("score", 1).alias("percentile"), band(F.col("score"), bands).alias("band"), none.cast("long").alias("opportunities"), F.lit(0).alias("_part"))
    total = total.filter("band is not null").withColumns({"kind": kind, "text": _worded(TOTAL_TEXT, F.col("band"), F.lit(""))})
    state = F.when(F.col("status").isin("limited", "provisional"), F.col("status")).when(F.col("total_reliability") >= large, "large")
    sample = ratings.withColumn("_s", state).filter("_s is not null").select(*keys, F.lit("sample").alias("component"), none.cast("double").alias("percentile"), F.lit("sample").alias("band"), none.cast("long").alias("opportunities"), F.lit(2).alias("_part"),
        F.when(F.col("_s") == "large", "strength").otherwise("concern").alias("kind"), _worded(SAMPLE_TEXT, F.col("_s"), F.round("exposure").cast("long").cast("string")).alias("text"))
    best = F.when(F.col("kind") == "strength", -F.col("percentile")).otherwise(F.col("percentile"))
    w = Window.partitionBy(*keys, "kind").orderBy("_part", best, "component")
    return parts.unionByName(total).unionByName(sample).withColumn("position", F.row_number().over(w)).drop("_part")


@dataclass(frozen=True)
class Brief:
    """What a scout asks for; None and 0 ask for nothing."""

    query: str = ""
    include_limited: bool = False
    min_exposure: float = 0
    min_reliability: float = 0
    min_pct: dict[str, float] = field(default_factory=dict)
    min_age: int | None = None
    max_age: int | None = None
    archetype: object = None
    similar_to: object = None
    min_similarity: float = 0
    salary: bool = False


def run_brief(rows: DataFrame, brief: Brief, weights: tuple[str, str, str], name: str = "") -> DataFrame:
    """All `rows` (candidates with percentiles, age, archetype and similarity) that meet `brief`, with fit, reasons and place.

    `weights` names the three percentiles that a fit counts, `name` the one that `similar_to` refers to. Places are by fit,
    then score, then id, and nothing is cut: who shows a page filters by place."""
    reference = None if brief.similar_to is None else F.lit(brief.similar_to) if not isinstance(brief.similar_to, Column) else brief.similar_to
    met = brief_filters(rows, brief.query, brief.include_limited, brief.min_exposure, brief.min_reliability, brief.min_pct, brief.min_age, brief.max_age, brief.archetype, reference, brief.min_similarity)
    similarity = F.col("similarity") if brief.similar_to is not None else F.lit(None).cast("double")
    bonus = F.lit(False) if brief.archetype is None else F.col("archetype").eqNullSafe(brief.archetype)
    fit = fit_score(*(F.col(c) for c in weights), F.col("score"), F.col("total_reliability"), F.col("exposure"), similarity, bonus)
    found = match_reasons(met.withColumn("similarity", similarity).withColumn("fit", fit), brief, name)
    return numbered(found.withColumns({"_f": F.round("fit", 6), "_s": F.round("score", 6)}), [], [F.desc("_f"), F.desc("_s"), F.col("entity_id")], "place").drop("_f", "_s")


def match_reasons(rows: DataFrame, brief: Brief, name: str = "") -> DataFrame:
    """`rows` with `reasons`, an array of (code, label, detail, tone): a condition met is pass, or strong well beyond it; info asks for nothing."""

    def reason(code, label, detail, strong=None, tone="pass"):
        detail = detail if isinstance(detail, Column) else F.lit(detail)
        return F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), detail.alias("detail"), (F.lit(tone) if strong is None else F.when(strong, "strong").otherwise(tone)).alias("tone"))

    whole = lambda c: F.round(c).cast("long").cast("string")
    out = [
        reason("minutes", "Minutes", F.concat(whole("exposure"), F.lit(f" minutes meets the {brief.min_exposure:g} threshold")), F.col("exposure") >= 2 * brief.min_exposure),
        reason("reliability", "Reliability", f"Total reliability of at least {brief.min_reliability:.2f}", F.col("total_reliability") >= brief.min_reliability + 0.15),
        *(reason(c, c, F.concat(F.lit(f"{c} percentile "), whole(c), F.lit(f" of at least {least:g}")), F.col(c) >= least + 20) for c, least in brief.min_pct.items()),
    ]
    if brief.min_age is not None or brief.max_age is not None:
        span = f"from {brief.min_age} to {brief.max_age}" if None not in (brief.min_age, brief.max_age) else f"from {brief.min_age}" if brief.max_age is None else f"to {brief.max_age}"
        out.append(reason("age", "Age", F.concat(F.lit("Age "), F.col("age").cast("string"), F.lit(f" is in the range asked for ({span})"))))
    if brief.archetype is not None:
        out.append(reason("archetype", "Archetype", F.concat(F.lit("Has the archetype asked for: "), F.col("archetype").cast("string")), tone="strong"))
    else:
        out.append(F.when(F.col("archetype").isNotNull(), reason("archetype_info", "Archetype", F.concat(F.lit("Is of archetype "), F.col("archetype").cast("string")), tone="info")))
    if brief.similar_to is not None:
        likeness = F.concat(whole(100 * F.col("similarity")), F.lit(f"% component-percentile similarity{' to ' + name if name else ''} (at least {100 * brief.min_similarity:.0f}%)"))
        out.append(F.when(F.col("similarity").isNotNull(), reason("similarity", "Profile similarity", likeness, F.col("similarity") >= 0.9)))
    if brief.salary:
        out.append(reason("salary_unavailable", "Salary", "Salaries are not in the data, so they filter nothing", tone="info"))
    return rows.withColumn("reasons", F.filter(F.array(*out), lambda x: x.isNotNull()))


def dashboard(shortlist: DataFrame, top: int = 10) -> DataFrame:
    """(size, upper_median): the size of the whole list, and the upper median score of its first `top`."""
    scores = F.sort_array(F.collect_list(F.when(F.col("place") <= top, F.coalesce("score", F.lit(0.0)))))
    return shortlist.agg(F.count("*").alias("size"), scores.alias("s")).select("size", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("upper_median"))


def recommendation(shortlist: DataFrame, least_reliability: float = 0.25) -> DataFrame:
    """The first three: role, and the risks, which may both hold."""
    risks = F.array_compact(F.array(F.when(F.col("status") != "qualified", "not_qualified"), F.when(F.col("total_reliability") < least_reliability, "low_reliability")))
    return shortlist.filter("place <= 3").withColumns({"role": F.when(F.col("place") == 1, "primary").otherwise("alternative"), "risks": risks})


def timelines(form: DataFrame) -> DataFrame:
    """(entity_id, period, timeline): an array of matches in order with running and rolling figures."""
    entry = F.struct("match_no", "event_id", "event_date", "exposure", "value", "cum_value", "cum_rate", "rolling_mean", "rolling_weighted")
    return form.groupBy("entity_id", "period").agg(F.array_sort(F.collect_list(entry)).alias("timeline"))


COMPONENT_FIELDS = ("value", "raw_value", "opps", "obs_rate", "adj_rate", "adj_value", "weight", "base_rate", "pct_adj", "pct_obs")


def component_maps(pcts: DataFrame) -> DataFrame:
    """(entity_id, period, components): a map of each component's figures."""
    return pcts.groupBy("entity_id", "period").agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct(*COMPONENT_FIELDS)))).alias("components"))


def season_documents(ratings: DataFrame, entities: DataFrame, pcts: DataFrame) -> DataFrame:
    """One nested document for each entity and period: who, rating, sample, components."""
    x = ratings.join(entities.select("entity_id", "name", "team"), "entity_id").join(component_maps(pcts), ["entity_id", "period"], "left")
    return x.select("entity_id", "period", F.struct("name", "team").alias("identity"), F.struct("score", "observed_pct", "adj_total", "obs_total", "rank_adjusted", "rank_observed", "rank_disagreement").alias("rating"), F.struct("status", "exposure", "total_reliability", "in_pool").alias("sample"), "components")


def player_index(ratings: DataFrame, entities: DataFrame, talent: DataFrame) -> DataFrame:
    """One row for each entity by name: team, periods from the latest on, and talent."""
    seasons = ratings.groupBy("entity_id").agg(F.max("period").alias("latest"), F.sort_array(F.collect_set("period"), False).alias("periods"))
    x = seasons.join(entities.select("entity_id", "name", "team"), "entity_id").join(talent.select("entity_id", "talent"), "entity_id", "left")
    return x.orderBy("name", "entity_id")


def profile_documents(ratings: DataFrame, talent: DataFrame) -> DataFrame:
    """(entity_id, seasons, talent): a map of each period's standing, and the talent estimate."""
    season = F.struct(F.col("period").cast("string"), F.struct("score", "rank_adjusted", "status", "exposure"))
    x = ratings.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(season)).alias("seasons"))
    return x.join(talent.select("entity_id", F.struct("talent", "talent_low", "talent_high").alias("talent")), "entity_id", "left")


def methodology_document(params: DataFrame) -> DataFrame:
    """One row: a map of each component's parameters."""
    return params.agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("k", "source", "s2", "tau2", "mean", "split_half", "drift")))).alias("components"))


def profile_table(ratings: DataFrame, traditional: DataFrame, component_pcts: DataFrame, intervals: DataFrame, people: DataFrame, appearances: DataFrame, talent: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """One wide row an entity and period: sample, score, rates, intervals, goals, each component's rate and percentile, talent.

    `intervals` has the posterior and score bounds, `people` name, team, age and archetype; what is missing there is null."""
    key = ["entity_id", "period"]
    parts = component_pcts.groupBy(*key).pivot("component", list(components)).agg(F.first("adj_rate").alias("adj"), F.first("pct_adj").alias("pct"))
    goals = traditional.select(*key, "conceded", "shots", "saves", "prevented", "prevented_rate", F.col("expected").alias("expected"))
    wide = ratings.join(goals, key).join(parts, key).join(appearances, key).join(intervals, key, "left").join(people, "entity_id", "left")
    now = talent.select("entity_id", F.col("talent_pct").alias("talent_score"), "talent", "weight_league", "weight_prior", "weight_live")
    return wide.join(now, "entity_id", "left")
