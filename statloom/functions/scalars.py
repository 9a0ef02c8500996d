"""Scalar column functions: parsing, slugs, ages, rates and bands. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to one ASCII letter.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿøđł"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyodl"


def per_exposure(value: Column, exposure: Column, basis: float) -> Column:
    """`value` per `basis` of exposure; null where exposure isn't positive."""
    return value / F.when(exposure > 0, exposure) * F.lit(basis)


def parse_number(text: Column) -> Column:
    """Text as a finite double, else null."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_whole(text: Column) -> Column:
    """Text as a whole number, halves to even, else null."""
    return F.bround(parse_number(text), 0).cast("bigint")


def event_date(text: Column) -> Column:
    """Date of a timestamp text with an optional " UTC"; null where it can't be read."""
    return F.to_date(F.try_to_timestamp(F.replace(text, F.lit(" UTC"), F.lit(""))))


def slug(name: Column, default: str = "entity") -> Column:
    """Accents folded, lower case, runs of other characters as one hyphen."""
    folded = F.replace(F.translate(F.lower(name), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    out = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def age_years(birth: Column, as_of: Column) -> Column:
    """Whole years from birth to a date; null unless between 0 and the date."""
    before = (F.month(as_of) < F.month(birth)) | ((F.month(as_of) == F.month(birth)) & (F.dayofmonth(as_of) < F.dayofmonth(birth)))
    return (F.year(as_of) - F.year(birth) - F.when(before, 1).otherwise(0)).cast("int")


def display_round(x: Column, digits: int) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, digits))


def band(pct: Column, bands: tuple[float, float, float, float]) -> Column:
    elite, strong, weak, poor = bands
    return F.when(pct >= elite, "elite").when(pct >= strong, "strong").when(pct <= poor, "poor").when(pct <= weak, "weak")


def guarded_corr(x: Column, y: Column, least: int) -> Column:
    """Pearson correlation; null under `least` pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sound = (F.count(a) >= least) & (F.var_pop(a) > 1e-15) & (F.var_pop(b) > 1e-15)
    return F.when(sound, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
