"""Topic vectors stored in clusters with bounds, so that searches read only clusters that can hold a hit.

A vector belongs to the cluster of its greatest component and of the band that this component of the unit vector lies in; clusters are
folders of one table. Beside it stand, a row a cluster, the number of rows and each component's least and greatest value, of
unit vectors and of the vectors as they are: topics x ``BANDS`` rows at most, which the driver holds. From these follows what a row of the
cluster can reach at most, for a cosine or for a topic's weight. A search reads the most promising clusters until it has n rows, takes the n-th
best value found, and then reads those whose bound isn't below it. So results equal a full scan's, ties included.

Null vectors, and those of another length than the first cluster's, are left out; zero vectors have cosine 0, as everywhere.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.functions.vectors import doubles, dot
from paperloom.operators import explore, similarity

BANDS = 20
#: What bounds are widened by, against rounding.
SLACK = 1e-9
BOUNDS = ("unit_most", "unit_least", "most", "least")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", vector_col: str = "topics") -> None:
    """Writes ``docs`` as a clustered table below ``path``, and its bounds."""
    own = docs.where(F.col(vector_col).isNotNull()).withColumn("clustered_v", doubles(F.col(vector_col)))
    norm = F.sqrt(dot(F.col("clustered_v"), F.col("clustered_v")))
    own = own.withColumn("clustered_u", F.when(norm > 0, F.transform("clustered_v", lambda v: v / norm)).otherwise(F.transform("clustered_v", lambda v: F.lit(0.0))))
    most = F.array_max("clustered_u")
    own = own.withColumn("main", F.array_position("clustered_u", most) - 1).withColumn("band", F.least(F.greatest(F.floor((1 - most) * BANDS), F.lit(0)), F.lit(BANDS)).cast("int"))
    plain = own.drop("clustered_v", "clustered_u")  # a cluster of very many rows becomes several files
    plain.hint("rebalance", "main", "band").write.mode("overwrite").partitionBy("main", "band").parquet(f"{path}/rows")
    docs.sparkSession.createDataFrame([(plain.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    each = own.select("main", "band", F.posexplode(F.arrays_zip(F.col("clustered_u").alias("u"), F.col("clustered_v").alias("v"))).alias("at", "x"))
    cells = each.groupBy("main", "band", "at").agg(F.count(F.lit(1)).alias("n"), F.max("x.u").alias("unit_most"), F.min("x.u").alias("unit_least"), F.max("x.v").alias("most"), F.min("x.v").alias("least"))
    listed = F.array_sort(F.collect_list(F.struct("at", *BOUNDS)))
    rows = cells.groupBy("main", "band").agg(F.max("n").alias("n"), listed.alias("c")).select("main", "band", "n", *[F.col(f"c.{b}").alias(b) for b in BOUNDS])
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


class Clusters:
    """Searches over a clustered table; ``read`` is what the last one read: (clusters, rows), of ``held``."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", vector_col: str = "topics"):
        self.rows = spark.read.schema(StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))).parquet(f"{path}/rows")
        self.bounds = spark.read.parquet(f"{path}/bounds").collect()
        self.id_col, self.vector_col = id_col, vector_col
        self.held, self.read = (len(self.bounds), sum(b["n"] for b in self.bounds)), (0, 0)

    def _of(self, clusters: list) -> DataFrame:
        wanted: Column = F.lit(False)  # no cluster, no row
        for main in sorted({c["main"] for c in clusters}):
            wanted = wanted | ((F.col("main") == main) & F.col("band").isin([c["band"] for c in clusters if c["main"] == main]))
        self.read = len(clusters), sum(c["n"] for c in clusters)
        return self.rows.where(wanted).drop("main", "band")

    def _searched(self, reach: list[float], n: int, values) -> list:
        """The clusters that can hold one of the ``n`` best; ``values`` gives the n best values of some."""
        ranked = sorted(zip(reach, range(len(reach))), key=lambda x: (-x[0], x[1]))
        first, rows = [], 0
        while rows < n and len(first) < len(ranked):
            first.append(self.bounds[ranked[len(first)][1]])
            rows += first[-1]["n"]
        found = values(self._of(first))
        if len(found) < n:
            return self.bounds
        return [self.bounds[i] for r, i in ranked if r >= min(found) - SLACK]

    def nearest(self, query: list[float], n: int = 10) -> DataFrame:
        """The ``n`` rows of greatest cosine with ``query``, as :func:`similarity.nearest` gives them."""
        length = sum(x * x for x in query) ** 0.5
        unit = [x / length if length else 0.0 for x in query]
        reach = [sum(max(q * a, q * b) for q, a, b in zip(unit, c["unit_most"], c["unit_least"])) for c in self.bounds]
        asked = F.array(*[F.lit(float(x)) for x in query])
        over = lambda rows: similarity.nearest(rows, asked, self.vector_col, self.id_col, n)
        clusters = self._searched(reach, n, lambda rows: [r["similarity"] for r in over(rows).where("similarity is not null").collect()])
        return over(self._of(clusters))

    def documents_of_topic(self, topic: int, n: int = 10) -> DataFrame:
        """The ``n`` rows of greatest weight for a topic, as :func:`explore.documents_of_topic` gives them."""
        reach = [c["most"][topic] for c in self.bounds]
        weight = F.element_at(doubles(F.col(self.vector_col)), topic + 1)
        clusters = self._searched(reach, n, lambda rows: [r["w"] for r in rows.select(weight.alias("w")).orderBy(F.desc("w")).limit(n).collect()])
        return explore.documents_of_topic(self._of(clusters), topic, n, self.id_col, self.vector_col)
