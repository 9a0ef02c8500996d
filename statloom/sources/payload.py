"""JSON payload envelopes, nested action arrays, snapshot files, and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVELOPE = "resource string, fetched_at string, row_count long, data array<struct<event_id: long, event_type: string, value: double>>"
SNAPSHOT = "period int, captured_at string, source_fingerprint string, methodology_version string, entries array<struct<entity_id: long, rank: int, score: double>>"


def place(spark) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one of a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="statloom-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def read_payload(spark, path: str, schema: str = ENVELOPE) -> DataFrame:
    """Envelopes, one JSON object a file or line, to one row for each record with its provenance."""
    x = spark.read.schema(schema).json(path)
    return x.select("resource", "fetched_at", "row_count", F.explode("data").alias("r")).select("resource", "fetched_at", "row_count", "r.*")


def write_payload(rows: DataFrame, resource: str, path: str, per_file: int = 1000) -> None:
    """Records as envelopes of at most about `per_file` records."""
    cols = F.struct("event_id", "event_type", "value")
    x = rows.groupBy(F.expr(f"event_id div {per_file}").alias("b")).agg(F.collect_list(cols).alias("data"))
    x.select(F.lit(resource).alias("resource"), F.lit("1970-01-01T00:00:00Z").alias("fetched_at"), F.size("data").cast("long").alias("row_count"), "data").write.json(path)


def read_events_payload(w) -> DataFrame:
    path = place(w.spark)
    write_payload(w.table("events"), "events", path)
    return read_payload(w.spark, path)


def nested_actions(components: DataFrame) -> DataFrame:
    """Long component rows as one nested array a key: the shape in which feeds deliver them."""
    return components.groupBy("entity_id", "period").agg(F.collect_list(F.struct(F.col("component").alias("action_type"), "value", "raw_value", F.col("opps").alias("count_actions"))).alias("data"))


def flatten_actions(nested: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Nested arrays to long rows; unknown action types are dropped."""
    x = nested.select("entity_id", "period", F.explode("data").alias("d"))
    return x.filter(F.col("d.action_type").isin(*known)).select("entity_id", "period", F.col("d.action_type").alias("component"), "d.value", "d.raw_value", F.col("d.count_actions").alias("opps"))


def read_snapshots(spark, path: str) -> DataFrame:
    x = spark.read.schema(SNAPSHOT).json(path)
    return x.select("period", "captured_at", "source_fingerprint", "methodology_version", F.explode("entries").alias("e")).select("period", "captured_at", "source_fingerprint", "methodology_version", "e.*")


def snapshot_rows(w) -> DataFrame:
    """The whole history written as documents and read back, with each one's fingerprint and version."""
    path = place(w.spark)
    x = w.snapshots.join(F.broadcast(w.sources), "period").select("period", F.date_format("captured_at", "yyyy-MM-dd").alias("captured_at"), "source_fingerprint", F.lit(w.p.methodology).alias("methodology_version"), F.struct("entity_id", "rank", "score").alias("e"))
    keys = ["period", "captured_at", "source_fingerprint", "methodology_version"]
    x.groupBy(*keys, (F.col("e.entity_id") % 16).alias("part")).agg(F.array_sort(F.collect_list("e")).alias("entries")).drop("part").write.json(path)
    return read_snapshots(w.spark, path)


def written(df: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """`df` after a round trip through a file format, partitioned by `by`."""
    path = place(df.sparkSession)
    writer = df.write.option("header", True) if kind == "csv" else df.write
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)
    reader = df.sparkSession.read.option("header", True).schema(df.schema)
    return reader.format(kind).load(path).select(*df.columns)


def appended(df: DataFrame, append) -> DataFrame:
    """Two runs appended to one table, the second of them twice, as by a job that is tried again."""
    path = place(df.sparkSession)
    for run in (1, 2, 2):
        append(df.withColumn("run", F.lit(run)), path, "run")
    return df.sparkSession.read.parquet(path).select(*df.columns, "run")


def missing_fields(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """(table_name, field) of required fields that are absent; an empty table lacks all of them."""
    lacking = required if df.isEmpty() else [f for f in required if f not in df.columns]
    return df.sparkSession.createDataFrame([(name, f) for f in lacking], "table_name string, field string")
