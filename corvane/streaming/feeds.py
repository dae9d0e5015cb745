"""Feed records as a stream: deduplicated by URL within a watermark, counted and averaged by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sentiment(stream: DataFrame, *, at: str = "published_ts", url: str = "url", score: str = "score", lateness: str = "30 days") -> DataFrame:
    """(day, items, mean) in append mode: each URL once, late rows dropped beyond ``lateness``.

    State is bounded by the watermark: URLs and open days of that span.
    """
    once = stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([url])
    days = once.groupBy(F.window(at, "1 day")).agg(F.count(F.lit(1)).alias("items"), F.avg(score).alias("mean"))
    return days.select(F.col("window.start").cast("date").alias("day"), "items", "mean")
