"""Rows out of stored web pages, and pages that don't hold the required markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = '<li><a href="([^"]*)">([^<]*)</a></li>'


def _marked():
    return F.contains("html", F.lit("<nav>")) & F.contains("html", F.lit("<article>"))


def html_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_no, href, label, is_target) of list links on pages with the required markers."""
    x = pages.filter(_marked()).select("page_id", F.regexp_extract_all("html", F.lit(ROW), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(ROW), F.lit(2)).alias("l"))
    x = x.select("page_id", F.posexplode(F.arrays_zip("h", "l")).alias("row_no", "r"))
    return x.select("page_id", "row_no", F.col("r.h").alias("href"), F.col("r.l").alias("label"), (F.length("r.l") <= 3).alias("is_target"))


def schema_guard(pages: DataFrame) -> DataFrame:
    """(page_id, fingerprint, has_markers): SHA-256 of the page's distinct tag names, 16 digits."""
    tags = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(F.trim(t)))))
    return pages.select("page_id", F.substring(F.sha2(F.array_join(tags, "|"), 256), 1, 16).alias("fingerprint"), _marked().alias("has_markers"))
