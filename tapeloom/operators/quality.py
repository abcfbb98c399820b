"""Throughput figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up


def batch_rate(df: DataFrame, batch: str, at_seconds: str) -> DataFrame:
    """Messages per second of each batch, from the time stamps of its rows."""
    n, elapsed = F.count(F.lit(1)), F.max(at_seconds) - F.min(at_seconds)
    return df.groupBy(batch).agg(
        n.alias("messages"), elapsed.alias("elapsed_s"),
        half_up(n / F.nullif(elapsed.cast("double"), F.lit(0.0)), 6).alias("messages_per_s"),
    )
