"""What the training-data operators share: word rules, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder.

    The setting is read from the session. Only where none is set (tests, local mode) a local
    folder is made and set, since driver and executors then share one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="paperloom-")
        shared_dir.own = base
    return f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"


#: Settings while a table is written: its shuffle files go at the end, when they are of no more use, and batches sent to
#: Python are bounded in bytes. Folders of values are written side by side, without a sort.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


def written(df: DataFrame, by: str | None = None, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in a folder a value of ``by``: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path, before = shared_dir(spark), {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.options(**options).parquet(path, partitionBy=by)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; what the task held then goes back to the system, as workers stay for other tasks."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return task


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def null_key(col: Column) -> Column:
    """A join key that tells null from every string."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))
