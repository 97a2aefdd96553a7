"""Progress of tasks as a stream: the newest message wins, a terminal one is never replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The statuses that end a task.
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED")


def latest_progress(messages: DataFrame, key: str, order: str, status: str, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """The state of each task: its first terminal message if there is one, else its newest.

    A plain aggregation, so the same expression serves a batch and, with update output, a stream
    whose state is one row a task.
    """
    ended = F.col(status).isin(*terminal)
    done = F.min(F.when(ended, F.struct(order, status, "value")))
    newest = F.max(F.struct(order, status, "value"))
    rows = messages.groupBy(key).agg(F.coalesce(done, newest).alias("_m"), F.max(F.when(~ended, F.least(F.col("value"), F.lit(99.0)))).alias("progress"))
    return rows.select(key, F.col("_m")[order].alias(order), F.col("_m")[status].alias(status), F.when(F.col("_m")[status].isin(*terminal), 100.0).otherwise(F.coalesce("progress", F.lit(0.0))).alias("progress"))


def run_available(spark: SparkSession, source: str, schema, key: str, order: str, status: str, target: str, checkpoint: str, name: str = "progress.parquet", terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """Reads what the folder holds as a stream, keeps the state in the checkpoint, and writes the
    states that changed, batch by batch; the newest batch of a task is its state."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    query = latest_progress(stream, key, order, status, terminal).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(target)
    best = rows.groupBy(key).agg(F.max_by(F.struct(order, status, "progress"), "batch").alias("s"))
    return best.select(key, "s.*")
