"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 2), all DataFrame expressions.

Features are whole numbers: symbols per 1,000 word characters, repeated lines per 1,000 lines, repeated words per
1,000 words, and mean word length in hundredths. The sketch of a feature in a (language, source) group is its counts
in log-linear buckets: values below 64 have their own, larger ones keep their six leading bits, so a quantile is
within 1/32 and a sketch has a few hundred rows however many documents it sums. Sketches merge by adding counts:
groups under `least` documents take their language's merged sketch, languages under it the merged sketch of all.
A document is kept if it passes the base rules and no feature is beyond q75 + 3 (q75 - q25) + slack of its group
(mean word length: nor below q25 - 3 (q75 - q25) - slack). Counts are combined before the shuffle, so a source
with a third of all rows is a few hundred rows a task; the join back has the few thresholds on its other side.

Defined results: null text has no words, so its base fails; null language or source is a group of its own; repeated
rows are judged each; an empty table gives an empty result; columns of other names stay, ours replace same-named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import GAP, WORD

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rule: slack, and whether there is a lower limit too.
RULES = {"symbols": (50, False), "lines": (350, False), "repeats": (350, False), "length": (60, True)}
LEAST = 50
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"f_{r}" for r in RULES)]


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, although `body` names it in lambdas."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words in windows of `width` words that occur twice or more in `words`."""
    hashes = F.when(
        F.size(words) >= width,
        _let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))),
    )

    def covered(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(ordered, lambda s: F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))))
        places = F.array_sort(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(width), x - a["last"])).alias("n")), lambda a: a["n"])

    return F.coalesce(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))), F.lit(0).cast("bigint"))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with word and line counts, base_failed, and the four features (null where undefined)."""
    docs = docs.drop(*[c for c in docs.columns if c in ADDED])
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({"_words": words, "_lines": lines})
    n = F.col("n_words")
    out = out.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "_n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("_words")),
    })
    out = out.withColumns({
        "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        "f_symbols": F.expr("1000 * n_symbols div nullif(word_chars, 0)"),
        "f_lines": F.expr("1000 * n_dup_lines div nullif(_n_lines, 0)"),
        "f_repeats": F.expr("1000 * n_repeat_words div nullif(n_words, 0)"),
        "f_length": F.expr("100 * word_chars div nullif(n_words, 0)"),
    })
    return out.drop("_words", "_lines", "_n_lines")


def bucket(value: Column) -> Column:
    """The least value of its log-linear bucket: six leading bits stay."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rule, bucket, n) of documents that pass the base rules."""
    passed = rows.filter(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *(f"f_{r}" for r in RULES))
    long = passed.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bucket(F.col(f"f_{r}")).alias("bucket")) for r in RULES))).alias("x"))
    return long.groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, low_<rule>, high_<rule>) of each group, from merged sketches where the group is small."""

    def limits(part: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "rule")
        ranked = part.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
        q = ranked.groupBy(*keys, "rule").agg(F.max("all").alias("all"), F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"))
        cols = [F.max("all").alias("all")]
        for r, (slack, below) in RULES.items():
            mine = F.col("rule") == r
            cols.append(F.max(F.when(mine, F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + slack)).alias(f"high_{r}"))
            cols.append((F.max(F.when(mine, F.col("q1") - 3 * (F.col("q3") - F.col("q1")) - slack)) if below else F.lit(-1).cast("bigint")).alias(f"low_{r}"))
        return q.groupBy(*keys).agg(*cols)

    names = [f"{side}_{r}" for r in RULES for side in ("low", "high")]
    own, by_lang, every = limits(sketch, ["lang", "source"]), limits(sketch, ["lang"]), limits(sketch.withColumn("one", F.lit(1)), ["one"])
    pick = lambda c: F.when(own["all"] >= least, own[c]).when(by_lang["all"] >= least, by_lang[c]).otherwise(every[c]).alias(c)
    return own.withColumn("one", F.lit(1)).join(by_lang, own["lang"].eqNullSafe(by_lang["lang"])).join(every, "one").select(own["lang"], own["source"], *map(pick, names))


def judged(rows: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """`rows` (from `features`) with `kept`; a group without any document that passes the base keeps none."""
    limits = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *(F.col(f"{side}_{r}").alias(f"_{side}_{r}") for r in RULES for side in ("low", "high")))
    within = None
    for r in RULES:
        one = F.col(f"f_{r}").between(F.col(f"_low_{r}"), F.col(f"_high_{r}"))
        within = one if within is None else within & one
    joined = rows.drop("kept").join(limits, rows[lang].eqNullSafe(F.col("_l")) & rows[source].eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select(*[c for c in rows.columns if c != "kept"], "kept")


_LIMITS = "\n".join(f"  {side}_{r}," for r in RULES for side in ("low", "high"))
_LEVEL = ",\n".join(
    f"  max(CASE WHEN rule = '{r}' THEN q3 + 3 * (q3 - q1) + {slack} END) AS high_{r}, " + (f"max(CASE WHEN rule = '{r}' THEN q1 - 3 * (q3 - q1) - {slack} END)" if below else "-1") + f" AS low_{r}" for r, (slack, below) in RULES.items()
)


def _level(name: str, keys: str) -> str:
    on = f"{keys}, " if keys else ""
    return f"""{name}_r AS (SELECT {on}rule, bucket, sum(n) AS n FROM sketch GROUP BY {on}rule, bucket),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {on}rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {on}rule) AS total FROM {name}_r),
{name}_q AS (SELECT {on}rule, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM {name}_c GROUP BY {on}rule),
{name} AS (SELECT {on}max(total) AS total,
{_LEVEL}
FROM {name}_q {"GROUP BY " + keys if keys else ""})"""


_PICK = ", ".join(f"CASE WHEN g.total >= {LEAST} THEN g.{c} WHEN l.total >= {LEAST} THEN l.{c} ELSE e.{c} END AS {c}" for r in RULES for c in (f"low_{r}", f"high_{r}"))
_WITHIN = " AND ".join(f"f_{r} BETWEEN t.low_{r} AND t.high_{r}" for r in RULES)
ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c > 1) GROUP BY doc_id),
k AS (SELECT doc_id, line, row_number() OVER () AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * n_symbols // nullif(word_chars, 0) AS f_symbols, 1000 * n_dup_lines // nullif(n_lines, 0) AS f_lines,
             1000 * n_repeat_words // nullif(n_words, 0) AS f_repeats, 100 * word_chars // nullif(n_words, 0) AS f_length FROM b),
long AS (SELECT lang, source, rule, CAST(v AS BIGINT) AS v FROM ({" UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, f_{r} AS v FROM f WHERE NOT base_failed" for r in RULES)})),
sketch AS (SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket, count(*) AS n FROM long GROUP BY ALL),
{_level("by_group", "lang, source")},
{_level("by_lang", "lang")},
{_level("by_all", "")},
t2 AS (SELECT g.lang, g.source, {_PICK} FROM by_group g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN by_all e)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce({_WITHIN}, false) AS kept
FROM f LEFT JOIN t2 t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
