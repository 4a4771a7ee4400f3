"""Structured Streaming forms; beyond batch only in when they run, not in what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(findings: DataFrame, late: str = "2 days") -> DataFrame:
    """Per patient, item and day: points, lowest and highest value; late rows count until the watermark passes."""
    x = findings.withWatermark("ts", late)
    return x.groupBy("patient", "item", F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("points"), F.min("value_num").alias("low"), F.max("value_num").alias("high")
    ).select("patient", "item", F.col("w.start").cast("date").alias("day"), "points", "low", "high")
