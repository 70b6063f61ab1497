"""Concentration over a stream of events: an extension, batch studies have no such operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "7 days", late: str = "1 day", time: str = "ts", label: str = "event_type") -> DataFrame:
    """start, label, n per tumbling window; rows later than the watermark are dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), label).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col(label).alias("label"), "n")


def window_hhi(counts: DataFrame) -> DataFrame:
    """start, hhi of finished windows' counts (a batch, as in foreachBatch)."""
    shares = counts.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("start")))
    return shares.groupBy("start").agg(F.sum(F.col("s") * F.col("s")).alias("hhi"))
