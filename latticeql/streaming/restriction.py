"""A Spark-side analogue of restriction in time: tumbling windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, hours: int, late: str = "2 hours") -> DataFrame:
    """Sum and count of cents by type and window, of a batch or a stream with a watermark."""
    cents = F.round(F.col("value") * 100).cast("long")
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", f"{hours} hours").alias("w"), "event_type")
    return rows.agg(F.sum(cents).alias("cents"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "cents", "n")


def run_stream(spark: SparkSession, folder: str, schema, hours: int, out: str, checkpoint: str) -> DataFrame:
    """Runs the stream over all files of a folder until they are done and returns what it wrote."""
    stream = hourly(spark.readStream.schema(schema).parquet(folder), hours)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
