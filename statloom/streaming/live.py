"""Live refresh: arriving event rows are merged by key into partitioned facts, and only changed standings are put out.

A state folder holds what every micro-batch adds, in a part of its own number, so that a batch that is run again
replaces its part and nothing else:

    events/batch=k/bucket=b      new event ids, by hash of the id
    standings/batch=k/bucket=b   the new standings of users whose events came in this batch, by hash of the user
    whole/batch=k/bucket=b       all standings after batch k, every `compact_every` batches
    checkpoint                   the stream's offsets

A batch meets the ids before it in the buckets that it touches, and the standings of its own users only; the history is
never aggregated again. Rows may come however late: an event counts where it first arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.sources.payload import place

EVENT = "event_id long, user_id long, value double, ts timestamp, batch int, bucket int"
STANDING = "user_id long, n long, value double, batch int, bucket int"
WHOLE = "user_id long, n long, value double, last int, batch int, bucket int"
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def standings(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame:
    """(user_id, n, value, batch): each user's standing after batch `upto` (all batches), and the batch that changed it last."""
    before = F.lit(True) if upto is None else F.col("batch") <= upto
    whole = _read(spark, f"{state}/whole", WHOLE).filter(before)
    base = whole.agg(F.max("batch")).first()[0]
    parts = _read(spark, f"{state}/standings", STANDING).filter(before)
    if base is not None:
        parts = parts.filter(F.col("batch") > base).unionByName(whole.filter(F.col("batch") == base).select("user_id", "n", "value", F.col("last").alias("batch"), "bucket"))
    last = parts.groupBy("bucket", "user_id").agg(F.max_by(F.struct("n", "value", "batch"), "batch").alias("x"))
    return last.select("user_id", "x.*", "bucket")


def changes(spark: SparkSession, state: str, batch: int) -> DataFrame:
    """(user_id, n, value) of the standings that `batch` changed."""
    return _read(spark, f"{state}/standings", STANDING).filter(F.col("batch") == batch).select("user_id", "n", "value")


def merge(rows: DataFrame, number: int, state: str, compact_every: int = 50) -> None:
    """Merges a batch of events; of rows that repeat an id the earliest of the earliest batch counts. Running a batch again changes nothing."""
    spark = rows.sparkSession
    own = rows.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct("ts", "user_id", "value")).alias("x"))
    own = own.select("event_id", "x.user_id", "x.value", "x.ts", _bucket("event_id"))
    known = _read(spark, f"{state}/events", EVENT).filter(F.col("batch") < number).select("bucket", "event_id")
    new = own.join(known, ["bucket", "event_id"], "left_anti")
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/events/batch={number}")
    added = _read(spark, f"{state}/events", EVENT).filter(F.col("batch") == number)
    delta = added.groupBy("user_id").agg(F.count("*").alias("dn"), F.sum("value").alias("dv")).select("*", _bucket("user_id"))
    before = standings(spark, state, number - 1).select("bucket", F.col("user_id").alias("_user"), F.col("n").alias("n0"), F.col("value").alias("v0"))
    user = (delta["bucket"] == before["bucket"]) & delta["user_id"].eqNullSafe(F.col("_user"))
    total = F.when(F.col("dv").isNull(), F.col("v0")).otherwise(F.col("dv") + F.coalesce("v0", F.lit(0.0)))
    changed = delta.join(before, user, "left").select("user_id", (F.col("dn") + F.coalesce("n0", F.lit(0))).alias("n"), total.alias("value"), delta["bucket"])
    changed.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/standings/batch={number}")
    if compact_every and number % compact_every == compact_every - 1:
        standings(spark, state, number).withColumnRenamed("batch", "last").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/whole/batch={number}")


def refresh(spark: SparkSession, path: str, state: str, per_batch: int = 1000, compact_every: int = 50) -> None:
    """Reads what has arrived at `path`, a file or a folder of part files, since `state` was last refreshed; `per_batch` files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        events = reader.parquet(path)
    else:
        events = reader.option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)
    sink = events.writeStream.foreachBatch(lambda batch, number: merge(batch, number, state, compact_every))
    sink.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def refreshed(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """(user_id, n, value) after the stream over `path` has been read to its end; repeated event ids count once."""
    state = place(spark)
    refresh(spark, path, state, per_batch)
    return standings(spark, state).select("user_id", "n", "value")
