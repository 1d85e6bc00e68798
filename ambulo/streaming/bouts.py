"""An extension: bouts of an unbounded stream, by session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bouts(events: DataFrame, gap: str = "3600 seconds", late: str = "1 hour") -> DataFrame:
    """Bouts of each user once the watermark has passed them; a gap of exactly `gap` closes, as in batches."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    held = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts").alias("start"), F.max("ts").alias("last"), F.avg("value").alias("pa_amplitude"))
    return held.select("user_id", "start", "last", "n_windows", "pa_amplitude")
