"""Frames as they are acquired: detections in, per-spot means of each frame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTION = "stack_id long, spot_id long, ts timestamp, value double"


def read_detections(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DETECTION).parquet(folder)


def stream_traces(detections: DataFrame, frame: str = "1 day", late: str = "2 days") -> DataFrame:
    """(stack_id, spot_id, frame, value, n): tumbling windows, closed once the watermark has passed them."""
    per = detections.withWatermark("ts", late).groupBy("stack_id", "spot_id", F.window("ts", frame).alias("w"))
    return per.agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("stack_id", "spot_id", F.col("w.start").alias("frame"), "value", "n")


def write_traces(traces: DataFrame, folder: str, checkpoint: str):
    """Append to Parquet what is there now; a later run goes on where this one ended."""
    return traces.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(folder)
