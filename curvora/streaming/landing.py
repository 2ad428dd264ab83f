"""A landing folder of profile tables, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summarise_landing(spark: SparkSession, folder: str, schema: str, lateness: str = "10 minutes", span: str = "5 minutes") -> DataFrame:
    """Number, mean and range of values by event type and window of event time; late rows are dropped by the watermark."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return events.groupBy(F.window("at", span), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("span"))
