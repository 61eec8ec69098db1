"""What the training-data operators share: the cluster's shared folder, materialisation, block sizes."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the blank and the bytes 09 to 0D (fixed by the data contract).
WORD_GAP = "[ \\t-\\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local-mode session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"/tmp/checkpoints/{os.getpid()}"
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


_made: list[str] = []
_inside: ContextVar[list[str] | None] = ContextVar("side files of the operator that runs", default=None)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. It is deleted at the end of the side_files() that it is made in, or of the driver."""
    if not _made:
        atexit.register(clean)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    if (inside := _inside.get()) is not None:
        inside.append(path)
    return path


@contextmanager
def side_files(spark: SparkSession) -> Iterator[None]:
    """What is written to fresh paths in here is deleted at the end; results belong to a path made before."""
    mine: list[str] = []
    token = _inside.set(mine)
    try:
        yield
    finally:
        _inside.reset(token)
        for path in mine:
            drop_path(spark, path)
            if path in _made:
                _made.remove(path)


def clean() -> None:
    """Delete all that this driver has put into the shared folder. Runs when the driver ends; results read before are void after it."""
    spark = SparkSession.getActiveSession()
    while _made:
        path = _made.pop()
        try:
            if spark is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  (the session may be gone: then its files stay)
            return


def materialize(df: DataFrame, what: str, small: bool = False, path: str | None = None) -> DataFrame:
    """Write a table into the shared folder (a fresh path by default) and read it again: cuts lineage and survives lost executors.

    small: few rows in many partitions; they are merged first, so that no crowd of tiny files results.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, what)
    # A writer holds a row group in memory: 16 MB of them are enough.
    (df.hint("rebalance") if small else df).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that gives freed memory back to the system at its end: Python workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return wrapped


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of few rows while an action runs: texts may be long, and a batch is held as a whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(column: str = "text"):
    """The text's UTF-8 length; a null text has none."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
