"""Extension: bars of an event stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, width: str = "1 hour", late: str = "1 day", time: str = "ts", entity: str = "user_id", value: str = "value") -> DataFrame:
    """(entity, start, open, high, low, close, n) for each window; works on streams and on tables."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.window(time, width).alias("w"), F.col(entity)).agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return made.select(entity, F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
