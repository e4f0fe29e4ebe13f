"""Writers of what the jobs give out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(existing: DataFrame, incoming: DataFrame, key: str = "_id", order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those of equal key; the last of a key by ``order`` wins.

    Without ``order`` the last one is that which comes last in ``incoming``.
    """
    placed = incoming.withColumn("merging_place", F.col(order) if order else F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("merging_place")))
    fresh = placed.withColumn("merging_nth", last).where("merging_nth = 1").drop("merging_nth", "merging_place")
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(path: str, incoming: DataFrame, key: str = "_id", order: str | None = None) -> None:
    """Merges into the Parquet table at ``path``: written beside it first, then put in its place.

    The old table is moved aside before and deleted after the new one is in place; if a run breaks off between, the
    next one moves it back, so that a whole table is always there.
    """
    spark = incoming.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, aside = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".merging", ".before"))
    files = target.getFileSystem(conf)

    def move(a, b) -> None:
        if not files.rename(a, b):
            raise OSError(f"couldn't move {a} to {b}")

    if files.exists(aside):
        if files.exists(target):
            files.delete(aside, True)
        else:
            move(aside, target)
    there = files.exists(target)
    existing = spark.read.parquet(path) if there else incoming.limit(0)
    merged(existing, incoming, key, order).write.mode("overwrite").parquet(f"{path}.merging")
    if there:
        move(target, aside)
    move(fresh, target)
    files.delete(aside, True)


def upsert_parts(path: str, incoming: DataFrame, key: str = "_id", order: str | None = None, parts: int = 64) -> None:
    """Merges into a Parquet table at ``path`` that is dealt to ``parts`` folders by a hash of the key; only those with incoming keys are rewritten.

    The merged folders are written beside the table first and then overwrite theirs; if a run breaks off in between, the next one
    puts what was written in place before it begins. A table keeps the number of parts it was made with.
    """
    spark = incoming.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(conf)
    beside = f"{path}.merging"

    def put() -> None:
        rows = spark.read.parquet(beside)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_part").parquet(path)
        files.delete(place(beside), True)

    if files.exists(place(f"{beside}/_SUCCESS")):
        put()
    dealt = incoming.withColumn("key_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    touched = [r["key_part"] for r in dealt.select("key_part").distinct().collect()]  # at most ``parts`` numbers
    if not touched:
        return
    there = spark.read.parquet(path).where(F.col("key_part").isin(touched)) if files.exists(place(path)) else dealt.limit(0)
    merged(there, dealt, key, order).repartition("key_part").write.mode("overwrite").parquet(beside)
    put()


def edge_lines(edges: DataFrame, weight: str) -> DataFrame:
    """(value): Edge(src,dst,weight) lines."""
    return edges.select(F.concat(F.lit("Edge("), F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string"), F.col(weight).cast("string")), F.lit(")")).alias("value"))


def write_edges(edges: DataFrame, path: str, weight: str, mode: str = "overwrite") -> None:
    """One text file; for the edges between topics, of which there are few."""
    edge_lines(edges, weight).coalesce(1).write.mode(mode).text(path)


def write_values(rows: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """One value a line, in as many files as there are partitions."""
    rows.select(F.col(col).cast("string")).write.mode(mode).text(path)


def graph_table(edges: DataFrame, weight: str) -> DataFrame:
    """(Source, Target, Weight, Type) for graph tools."""
    return edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.col(weight).alias("Weight"), F.lit("Undirected").alias("Type"))


def write_graph(edges: DataFrame, path: str, weight: str, mode: str = "overwrite") -> None:
    graph_table(edges, weight).coalesce(1).write.mode(mode).csv(path, header=True)


def write_similarities(found: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Search hits and their similarity as one CSV file; columns that CSV can't hold are left out."""
    plain = [f.name for f in found.schema.fields if f.dataType.typeName() not in ("array", "struct", "map", "binary")]
    found.select(*plain).coalesce(1).write.mode(mode).csv(path, header=True)


def write_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Run metrics as JSON lines."""
    rows.write.mode(mode).json(path)
