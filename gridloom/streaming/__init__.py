"""An extension beyond batch: the same operators over streams of events or uploads. The batch engine doesn't need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_snapshots(stream: DataFrame, fingerprint: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each fingerprint once: repeats within the watermark's delay are dropped, and state older than that is forgotten."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(fingerprint)


def windowed(stream: DataFrame, time: str, width: str, groups: list[str], aggregates: list[Column], delay: str = "1 hour") -> DataFrame:
    """Tumbling windows of event time; rows later than ``delay`` are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, width), *groups).agg(*aggregates).select(F.col("window.start").alias("start"), *groups, *[a for a in timed.limit(0).groupBy(*groups).agg(*aggregates).columns if a not in groups])
