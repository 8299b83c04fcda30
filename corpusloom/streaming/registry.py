"""Streaming forms of the registry operators: an extension, batch results are the reference for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_finds(stream: DataFrame, key: str = "url", time: str = "discovered", late: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by tumbling window and keys; late rows count until the watermark passes."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")
