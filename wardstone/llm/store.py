"""Files that executors write and read in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from wardstone.session import cut, workspace


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one named by spark.checkpoint.dir."""
    return workspace(spark, name)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later reads do no work twice, and a
    lost executor costs one file at most."""
    return kept_below(df, shared_folder(df.sparkSession, name))


def kept_below(df: DataFrame, folder: str) -> DataFrame:
    """The same in a folder that the caller names, to have it deleted."""
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a shared folder that no lazy frame reads."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept_rows(df: DataFrame) -> DataFrame:
    """The same for narrow rows whose partitioning must survive."""
    return cut(df)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted. Spark does so when the driver's heap is
    collected, which may not happen while a job's steps fill the disk. Frames that Python still
    holds in a cycle would keep them."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        gc.collect()
        jvm.java.lang.System.gc()


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri)


def new_file(folder: str, part: int, suffix: str) -> str:
    """A name no other attempt uses. Only a task that ends well reports its file, so what a lost
    or repeated attempt has left behind is never read."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def open_new(path: str):
    fs, inner = filesystem(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(inner, compression=None)


def open_old(path: str):
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and what earlier ones
    needed counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about `limit` bytes of a text column (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()
