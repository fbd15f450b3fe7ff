"""Tables in the folder that all executors share, and columns handed to tasks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local master gets one of its own."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; application and name say whose it is."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{application}/{name}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: its lineage ends here.

    A lost executor costs a later stage nothing, and Spark knows the table's size
    when it chooses joins.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of ``frame``: these, longer where it has them already."""
    taken = {column.lower() for column in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> F.Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def give_back(every: float = 0.0) -> None:
    """Memory that this worker no longer uses goes back to the machine, at most once in so many seconds.

    A worker outlives its task, and what its allocators keep counts against the tasks of
    later stages on the same executor.
    """
    now = time.monotonic()
    if now - _given_back[0] < every:
        return
    _given_back[0] = now
    gc.collect(1)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library has no such call.
        pass


_given_back = [0.0]


def lean(task: Callable) -> Callable:
    """A function over batches that gives memory back as it goes and at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            for out in task(batches):
                yield out
                del out
                give_back(every=2.0)
        finally:
            give_back()

    return run


def lean_group(task: Callable) -> Callable:
    """A function over one group that gives memory back now and then."""

    def run(group: pa.Table) -> pa.Table:
        out = task(group)
        give_back(every=1.0)
        return out

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python at most so many at a time; for jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def longs(values: np.ndarray) -> pa.Array:
    """64-bit unsigned numbers as the signed ones that Spark keeps."""
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


def blobs(parts: list) -> pa.Array:
    return pa.array([p.tobytes() if isinstance(p, np.ndarray) else bytes(p) for p in parts], pa.binary())
