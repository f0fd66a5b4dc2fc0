"""What the operators share: the folder that all executors see, checkpoints, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``. Only a local session may leave that setting out (tests); elsewhere no folder of one machine would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and survives a lost executor. ``by``: columns that get folders of their own."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with smaller_batches(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


@contextlib.contextmanager
def smaller_batches(spark: SparkSession, rows: int = 1000):
    """Batches of ``rows`` rows to and from Python meanwhile: texts may be long, and a task holds a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once all that was made of it is materialised too, and lets Spark drop the shuffle files of finished steps."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(SparkSession.active())


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark removes them when its garbage collector finds that nothing refers to the step any more."""
    for _ in range(2):  # what the first frees may hold others
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def likely(df: DataFrame, key: str, wanted: DataFrame, words: int = 1 << 18) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of those in ``wanted``, and some others: a filter of ``words`` words of 64 bits at most, whatever the tables' sizes, so that
    most rows which a join would drop need not be moved. Keys are integers; a null key is dropped."""
    hashed = F.xxhash64(key)
    place, bit = F.pmod(F.shiftright(hashed, 6), F.lit(words)), F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 AS int))")
    marks = wanted.select(place.alias("__place"), bit.alias("__bit")).groupBy("__place").agg(F.bit_or("__bit").alias("__word"))
    hit = df.withColumns({"__place": place, "__bit": bit}).join(F.broadcast(marks), "__place").where(F.col("__word").bitwiseAND(F.col("__bit")) != 0)
    return hit.select(*df.columns)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls have length 0. ``offsets`` has one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, text: str, most: int = 1 << 20):
    """Splits Arrow batches into slices whose texts have about ``most`` bytes, so memory stays bounded whatever the batch. At the end the worker, which lives on,
    gives free memory back to the system."""
    for batch in batches:
        lengths = np.diff(text_buffer(batch.column(text))[1])
        at, n = 0, batch.num_rows
        total = np.cumsum(lengths)
        while at < n:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1 ... start+length-1 of each entry, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])
