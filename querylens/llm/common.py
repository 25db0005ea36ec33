"""What the operators of this subpackage share: tables in the shared folder,
columns with private names and bounded Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that a function works on at once.
ARROW_ROWS = 1000
#: Bytes of an Arrow batch of :func:`small_batches`.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most so many rows; none are empty.

    Spark bounds a batch by bytes (``maxBytesPerBatch``, 64 MB unless set), so
    that one of long texts is small already; this bounds what is made of it.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            # copied: some of Arrow's text functions misread slices with an offset
            yield batch.take(pa.array(range(at, min(at + rows, batch.num_rows)), pa.int64())) if at else batch.slice(0, rows)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile hand texts to Python in batches of about
    :data:`ARROW_BYTES`, or of what the session sets if that is less.  Both the
    executor and its workers hold a batch more than once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if before else 0
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release_memory() -> None:
    """Hand free memory back at the end of a Python task; workers are used again
    and would hold on to the most they ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    One is made here only in local mode (tests); a cluster must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="querylens-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths made by this application that are still there.
_paths: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/querylens-{tag}-{uuid.uuid4().hex}"
    _paths.add(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts lineage, so that a lost executor costs no recomputation, and lets the
    optimiser see true sizes.  Hand the result to :func:`drop` when done.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _paths.discard(path)


def drop_all(spark: SparkSession) -> None:
    """Delete all that the operators have left in the shared folder; for when
    every result of theirs has been consumed."""
    for path in list(_paths):
        drop_path(spark, path)


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that no later plan reads."""
    drop_path(df.sparkSession, df._stored_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` clashes."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
