"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: While a table is written: its shuffle files go at the end.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def session(name: str = "paperloom", **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; ``conf`` overrides them."""
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    return SparkSession.builder.appName(name).config(map=own | conf).getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set (tests), as all runs on one machine there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(_shared, "own", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _shared.own = tempfile.mkdtemp(prefix="paperloom-shared-")
    return folder


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/paperloom-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """``conf`` holds within, what was set before afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(df: DataFrame, **conf: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, where a plan reads it more than once; ``conf`` holds while it is written."""
    spark = df.sparkSession
    path = shared_path(spark)
    with settings(spark, **conf):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`kept` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
