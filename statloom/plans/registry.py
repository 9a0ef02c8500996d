"""Every query of the rating engine by name, with DuckDB SQL that gives the same rows.

A query is a DataFrame of the workload and a list of columns; doubles are rounded to 8 digits on both sides, since
sums taken in another order differ in the last bits."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.plans.oracle import with_ctes
from statloom.plans.workload import Workload, workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Digits by mark: the second is for small quotients, of which exact ones can end in a 5 at the ninth digit.
DIGITS = {"*": 8, "~": 11}


def spark_column(c: str):
    name = c.lstrip("*#@~")
    if c[0] in "*~":
        return (F.round(F.col(name).cast("double"), DIGITS[c[0]]) + F.lit(0.0)).alias(name)
    if c[0] == "@":
        return F.col(name).cast("string").alias(name)
    return F.col(name).cast("bigint").alias(name) if c[0] == "#" else F.col(name)


def _duck_column(c: str) -> str:
    name = c.lstrip("*#@~")
    if c[0] in "*~":
        return f"round(CAST({name} AS DOUBLE), {DIGITS[c[0]]}) + 0.0 AS {name}"
    if c[0] == "@":
        return f"CAST({name} AS VARCHAR) AS {name}"
    return f"CAST({name} AS BIGINT) AS {name}" if c[0] == "#" else name


def query(name: str, columns: str, make: Callable[[Workload], DataFrame], sql: str | None, ready: bool = False) -> None:
    """`columns`: names, with * or ~ before doubles (rounded), # before whole numbers (cast to bigint) and @ before dates (as text).

    `sql` is what follows FROM: a table of plans.oracle or a query in brackets; None: no SQL expresses it.
    `ready`: `make` gives the columns as they are to be, rounded where rows were fewer."""
    cols = columns.split()
    column = (lambda c: F.col(c.lstrip("*#@~"))) if ready else spark_column

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = workload(spark, sf_dir)
        with getattr(w, "spread", nullcontext)():  # a stand-in has no tables to write
            return make(w).select(*map(column, cols))

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = with_ctes(f"SELECT {', '.join(map(_duck_column, cols))} FROM {sql}")


def both(name: str, columns: str, sql: str) -> None:
    """One SQL text for both engines; tables are named {table} and are the workload's on the Spark side."""
    import re

    tables = dict.fromkeys(re.findall(r"\{(\w+)\}", sql))

    def make(w: Workload) -> DataFrame:
        found = {t: w.match if t == "matches" else getattr(w, t) if hasattr(Workload, t) else w.table(t) for t in tables}
        return w.spark.sql(sql, **found)

    query(name, columns, make, f"({sql.format(**{t: t for t in tables})}) x")


def apart(name: str, columns: str, make: Callable[[Workload], DataFrame], sql: str) -> None:
    """A query by operators, and SQL of its own with tables named {table}."""
    query(name, columns, make, "(" + sql.replace("{", "").replace("}", "") + ") x")


from statloom.plans import catalogue  # noqa: E402, F401  (fills the tables above)
