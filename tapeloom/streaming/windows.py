"""Event-time windows; the aggregates are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import articles, candles

LATENESS = "10 minutes"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), "*"
    ).drop("w")


def sentiment_windows(
    enriched: DataFrame, ts: str = "published_at", key: str = "ticker", width: str = "60 minutes", lateness: str = LATENESS
) -> DataFrame:
    """Tumbling sentiment windows per ticker."""
    timed = enriched.withWatermark(ts, lateness)
    return _flat(articles.sentiment_accumulation(timed, F.window(ts, width).alias("w"), key))


def bar_windows(bars: DataFrame, ts: str = "ts", width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Tumbling roll-up of bars per ticker."""
    timed = bars.withWatermark(ts, lateness)
    rolled = candles.roll_up(timed, ["ticker", F.window(ts, width).alias("w")])
    return _flat(rolled.drop("price_change", "price_change_pct"))


def sliding_price_windows(
    ticks: DataFrame, ts: str = "ts", width: str = "5 minutes", slide: str = "1 minute", lateness: str = LATENESS
) -> DataFrame:
    """Sliding windows per ticker.

    Windows end on multiples of ``slide``; the exact window of every single tick is the
    batch operator ``trailing_stats``.
    """
    timed = ticks.withWatermark(ts, lateness)
    return _flat(
        timed.groupBy(F.window(ts, width, slide).alias("w"), "ticker").agg(
            F.avg("price").alias("avg_price"), F.max("price").alias("max_price"), F.min("price").alias("min_price"),
            F.min_by("price", ts).alias("first_price"), F.max_by("price", ts).alias("last_price"),
            F.sum("volume").cast("double").alias("total_volume"), F.count(F.lit(1)).alias("data_points"),
        )
    )


def latest_values(df: DataFrame, value: str, ts: str) -> DataFrame:
    """Newest value per ticker so far. Readers expire it with ``ranking.live_latest``."""
    return df.groupBy("ticker").agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def unseen(df: DataFrame, key: str, ts: str, ttl: str = "30 days") -> DataFrame:
    """Messages whose key was not seen within ``ttl``; the watermark bounds the state."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
