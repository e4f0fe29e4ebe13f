"""Topic distributions of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.topics import TopicPipeline


def score_arrivals(spark: SparkSession, source: str, schema: str, models: str, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Starts a query that scores every Parquet file put into ``source`` with saved models.

    A batch overwrites its own folder, so a batch that is run again after a failure leaves no copies.
    """
    pipeline = TopicPipeline.load(spark, models)

    def write(batch: DataFrame, number: int) -> None:
        pipeline.infer(batch, text_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrivals = spark.readStream.schema(schema).parquet(source)
    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
