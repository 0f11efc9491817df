"""Structured Streaming over the event table: windowed counts with a watermark, and running group totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total per tumbling window; works on a stream and on a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_once(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Drains the stream in complete mode into a table by foreachBatch and returns the table."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = windowed(stream(spark, path)).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
