"""Session settings, table reads and lineage cuts that every operator of this package shares."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch: texts may be long, so a batch of the default 10,000 rows could be gigabytes.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Bytes of a row group of tables that cut() writes: their rows are long, and each task holds a group to write or read it.
ROW_GROUP = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local session without that setting (tests) one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def sweep(spark: SparkSession) -> None:
    """Delete every folder that this driver made in the shared folder, once no result that rests on them is needed."""
    while _made:
        drop_folder(spark, _made.pop())


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when objects are freed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system: Python workers are reused, and would keep the largest need of any stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with trim() before and after a task."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return tidy


def cut(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages restart from files, not from the plan.

    tidy: release() shuffle files first, which is not worth its time before small tables."""
    path = new_folder(df.sparkSession, name)
    if tidy:
        release(df.sparkSession)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once a later one holds all that is needed of them."""
    for t in tables:
        drop_folder(t.sparkSession, t.cut_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, which also reaches stores that Python cannot open."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes of Arrow batches between the JVM and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def key_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = 100_000) -> DataFrame:
    """Join that broadcasts right if it is counted to hold few rows, and else shuffles both."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)
