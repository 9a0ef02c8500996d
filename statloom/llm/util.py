"""Small helpers shared by the operators: cluster-shared scratch tables, salts and text defaults."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, drop_shuffles: bool = False, batch_bytes: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut and a lost executor costs no recomputation.

    With `drop_shuffles` the shuffle files of the write are deleted when it is done, not when the driver collects garbage;
    with `batch_bytes` its Arrow batches have about that size, which the executor and its Python worker hold at once each,
    and texts are read 512 rows at a time."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/statloom/{name}-{uuid.uuid4().hex}"
    chosen = {CLEANUP: "true" if drop_shuffles else None, BATCH_BYTES: batch_bytes and str(batch_bytes), READ_ROWS: batch_bytes and "512"}
    before = {k: spark.conf.get(k, None) for k, v in chosen.items() if v}
    for k in before:
        spark.conf.set(k, chosen[k])
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `stored` that no later result reads: what follows must be stored itself by now."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if "/statloom/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(cols: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


class Recent:
    """A bounded memo in two generations: when the young one is full it becomes the old one."""

    __slots__ = ("limit", "old", "young")

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def __getitem__(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self[key] = got
        return got

    def __setitem__(self, key, value):
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


_HELD: dict[str, object] = {}


def worker_model(key: str, make: Callable):
    """One model a worker process, whatever the operator: another one asked for takes the place of the one before."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of the worker's model and gives its free memory back to the system: a reused worker would keep both from stage to stage."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most_bytes`, a row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def plain(column: pa.Array) -> list:
    """The values of a column without nulls, faster than `to_pylist`."""
    return column.to_numpy(zero_copy_only=False).tolist()


def packed_blocks(batches):
    """(block, blob): the rows of each `_block` that this task has read, compressed together."""
    release()
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held)
        held.clear()
        blocks = table.column("_block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        found, at = np.unique(blocks[order], return_index=True)
        blobs = []
        for i, j in zip(at, [*at[1:], len(order)]):
            sink = pa.BufferOutputStream()
            part = table.take(pa.array(order[i:j])).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as w:
                w.write_table(part)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["block", "blob"])

    size = 0
    for batch in small_batches(batches):
        held.append(batch)
        size += batch.nbytes
        if size > 32 << 20:
            yield flush()
            size = 0
    if held:
        yield flush()


def opened(blobs: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for blob in blobs:
        with pa.ipc.open_stream(blob.as_buffer()) as r:
            yield from r
