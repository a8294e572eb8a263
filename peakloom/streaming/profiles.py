"""Running profiles over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_profile(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes", key: str = "event_type") -> DataFrame:
    """Counts, sums and maxima of ``value`` by key in event-time windows; rows later than the watermark are left out."""
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = own.groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total", "top")
