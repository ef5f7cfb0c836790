"""Unique visitors on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.operators.relational import visitor_hash


def first_visits(stream: DataFrame, salt: str, address: str, time: str, late: str = "1 day") -> DataFrame:
    """One row per visitor and day; state is dropped once the watermark has passed the day."""
    v = stream.select(F.col(time).alias("seen"), visitor_hash(salt, address).alias("visitor"))
    return (v.withWatermark("seen", late)
            .withColumn("day", F.window("seen", "1 day")["start"])
            .dropDuplicatesWithinWatermark(["visitor", "day"]))


def daily_unique(stream: DataFrame, salt: str, address: str, time: str, late: str = "1 day") -> DataFrame:
    """Visits and approximate unique visitors per day, updated as data arrives."""
    v = stream.select(F.col(time).alias("seen"), visitor_hash(salt, address).alias("visitor"))
    return (v.withWatermark("seen", late).groupBy(F.window("seen", "1 day"))
            .agg(F.count(F.lit(1)).alias("visits"), F.approx_count_distinct("visitor").alias("unique_visitors")))
