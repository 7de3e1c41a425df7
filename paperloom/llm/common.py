"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many bytes are broadcast, others joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Folders written by new_folder, oldest first, for scratch().
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names
    none, a temporary folder serves in local mode (removed at the end); on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders of new_folder, in whatever store they are."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _written:
            _written.remove(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, what was written within it, but for folders added to the list given."""
    before, keep = set(_written), []
    yield keep
    remove(spark, *(f for f in list(_written) if f not in before and f not in keep))


def write_table(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """df as Parquet in the shared folder: where it is, and read back. The lineage ends there,
    and a lost executor costs no recomputation of what lies before."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name)[1]


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its rows, of about row_bytes each, are few enough."""
    return F.broadcast(df) if rows * (row_bytes + 16) <= BROADCAST_BYTES else df


def trimmed(run: Callable) -> Callable:
    """An Arrow function that gives its worker's free memory back when its task ends: workers
    live on, and what they hold counts against their executor."""

    def of(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return of


def release() -> None:
    """Gives this process's free memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function in this C library
        pass


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """From now on, Python workers of this session get batches of so many rows and bytes at most (fewer
    where the session says so). Each batch of whole texts is held by the executor's JVM outside its
    heap, and again by the worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        spark.conf.set(key, str(min(most, now) if now > 0 else most))


def shrink_heaps(spark: SparkSession) -> None:
    """Gives back the heap that executors no longer need: a JVM keeps what earlier work made it grow by
    until a full collection, and that adds to what later work's Python workers take. As many tasks
    as there are cores, so each executor has some; a heap that none reaches just stays as it is."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


#: A word, as the operators' contracts state it.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: Column) -> Column:
    """Number of words; null counts as none. Separators are squeezed first, so nothing is
    collected per word."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" ")))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("long")
