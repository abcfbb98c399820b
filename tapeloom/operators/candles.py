"""Bars: building, rolling up, shape columns, gap filling and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import prices
from tapeloom.functions.rounding import half_up, ratio
from tapeloom.functions.text import composite_key, surrogate_key
from tapeloom.functions.timing import DAY_MS

PRICE_FIELDS = ("o", "h", "l", "c", "v")
HOUR_MS = 3_600_000


def ticks_to_bars(ticks: DataFrame, bar_ms: int = HOUR_MS) -> DataFrame:
    """Ticks to fixed-width bars; partially aggregated before the shuffle."""
    start = F.col("t") - F.col("t") % bar_ms
    return (
        ticks.withColumn("_bar", start)
        .groupBy("ticker", "_bar")
        .agg(
            F.min_by("price", "ts").alias("o"),
            F.max("price").alias("h"),
            F.min("price").alias("l"),
            F.max_by("price", "ts").alias("c"),
            F.sum("volume").cast("double").alias("v"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("price") * F.col("volume")).alias("_pv"),
        )
        .withColumn("vw", ratio(F.col("_pv"), F.col("v")))
        .withColumnRenamed("_bar", "t")
        .drop("_pv")
    )


def roll_up(bars: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Coarser bars with bar count, mean close and open-to-close change."""
    o, c = F.col("open"), F.col("close")
    return (
        bars.groupBy(*keys)
        .agg(
            F.min("t").alias("start_timestamp"),
            F.max("t").alias("end_timestamp"),
            F.min_by("o", "t").alias("open"),
            F.max("h").alias("high"),
            F.min("l").alias("low"),
            F.max_by("c", "t").alias("close"),
            F.sum("v").alias("volume"),
            F.count(F.lit(1)).alias("bar_count"),
            half_up(F.avg("c"), 2).alias("avg_price"),
        )
        .withColumn("price_change", half_up(c - o, 2))
        .withColumn(
            "price_change_pct", F.when(o == 0, F.lit(0.0)).otherwise(half_up(ratio(c - o, o) * 100, 2))
        )
    )


def first_per_timestamp(bars: DataFrame, order: Column | str) -> DataFrame:
    """One bar per (ticker, t): the first by ``order``."""
    w = W.partitionBy("ticker", "t").orderBy(order)
    return bars.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def daily_bars(bars: DataFrame) -> DataFrame:
    """Bars by calendar day."""
    return (
        bars.withColumn("d", F.timestamp_millis("t").cast("date"))
        .groupBy("ticker", "d")
        .agg(
            F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"),
            F.max_by("c", "t").alias("c"), F.sum("v").alias("v"),
        )
    )


def fill_calendar(daily: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """A row for every calendar day between a ticker's first and last; ``carry`` columns hold on the days of bars only.

    Each row reproduces itself up to the day before the next one: prices carry over, volume
    on the added days is 0. A daily series holds at most one row per day, so its length is
    bounded by the calendar whatever the size of the data.
    """
    nxt = F.lead("d").over(W.partitionBy("ticker").orderBy("d"))
    until = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("d"))
    return (
        daily.withColumn("_next", nxt)
        .withColumn("_day", F.explode(F.sequence(F.col("d"), until)))
        .select(
            "ticker",
            F.col("_day").alias("d"),
            "o", "h", "l", "c",
            F.when(F.col("_day") == F.col("d"), F.col("v")).otherwise(F.lit(0.0)).alias("v"),
            *[F.when(F.col("_day") == F.col("d"), F.col(x)).alias(x) for x in carry],
        )
    )


def percent_returns(filled: DataFrame, fields=PRICE_FIELDS) -> DataFrame:
    """Change against the previous day per field, as ``<field>_ret``.

    The first day has no return and is dropped, and so is a day on which some field goes
    from 0 to 0. Growth from 0 counts as 0.
    """
    w = W.partitionBy("ticker").orderBy("d")
    df = filled.select("*", *[F.lag(x).over(w).alias(f"_p_{x}") for x in fields])
    undefined = F.lit(False)
    for x in fields:
        p = F.col(f"_p_{x}")
        undefined = undefined | p.isNull() | F.col(x).isNull() | ((p == 0) & (F.col(x) == 0))
    kept = df.filter(~undefined)
    returns = [
        F.when(F.col(f"_p_{x}") == 0, F.lit(0.0))
        .otherwise(ratio(F.col(x), F.col(f"_p_{x}")) - 1)
        .alias(f"{x}_ret")
        for x in fields
    ]
    return kept.select(*filled.columns, *returns)


def drop_junk_tickers(daily: DataFrame, floor: float = 0.01) -> DataFrame:
    """Drop every ticker that ever closed at or below ``floor``."""
    low = daily.groupBy("ticker").agg(F.min("c").alias("_low")).filter(F.col("_low") > floor)
    return daily.join(low.select("ticker"), "ticker", "left_semi")


def shape_columns(df: DataFrame, o="o", h="h", l="l", c="c", v="v", n="n", prefix="candle_") -> DataFrame:
    O, H, L, C, V, N = (F.col(x) for x in (o, h, l, c, v, n))
    return df.select(
        "*",
        prices.upper_wick(O, H, C).alias(f"{prefix}upper_wick"),
        prices.lower_wick(O, L, C).alias(f"{prefix}lower_wick"),
        prices.body_size(O, C).alias(f"{prefix}body_size"),
        (C > O).alias(f"{prefix}is_bullish"),
        prices.typical_price(H, L, C).alias(f"{prefix}typical_price"),
        prices.avg_trade_size(V, N).alias(f"{prefix}avg_trade_size"),
    )


def candle_facts(lake: DataFrame, date_col: str = "ingest_date") -> DataFrame:
    """Lake bars to the candle fact: hashed keys, renamed measures, nulls to 0, shape columns."""
    fact = lake.select(
        surrogate_key(F.col("ticker")).alias("candle_company_id"),
        surrogate_key(F.col(date_col)).alias("candle_time_id"),
        F.col("v").alias("candle_volume"),
        F.col("vw").alias("candle_volume_weighted"),
        F.col("o").alias("candle_open"),
        F.col("c").alias("candle_close"),
        F.col("h").alias("candle_high"),
        F.col("l").alias("candle_low"),
        F.col("n").cast("long").alias("candle_num_of_trades"),
        *[F.col(x) for x in ("ticker", date_col)],
    ).na.fill(0)
    return shape_columns(
        fact, "candle_open", "candle_high", "candle_low", "candle_close", "candle_volume", "candle_num_of_trades"
    )


def bar_documents(bars: DataFrame, time_update: Column) -> DataFrame:
    return bars.select(
        composite_key(F.col("ticker"), F.col("t")).alias("_id"),
        "ticker", "t", *PRICE_FIELDS, time_update.cast("long").alias("time_update"),
    )


def enrich_bars(bars: DataFrame, processor: str = "tapeloom", now: Column | None = None) -> DataFrame:
    """Stateless enrichment of OHLC messages; the same on tables and on streams."""
    o, h, l, c = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("o", "h", "l", "c"))
    volume = F.coalesce(F.col("v").cast("double"), F.lit(0.0))
    indicators = prices.range_indicators(o, h, l, c)
    at = F.current_timestamp() if now is None else now
    return bars.select(
        "*",
        at.alias("processed_at"),
        F.struct(F.col("ticker"), F.col("t").alias("timestamp"), at.alias("processing_time")).alias("metadata"),
        F.lit(processor).alias("processor"),
        F.struct(
            *[e.alias(k) for k, e in indicators.items()],
            volume.alias("volume"),
            prices.high_low_ratio(h, l).alias("high_low_ratio"),
            prices.volatility_flag(h, l, c).alias("volatility_indicator"),
            prices.trend(o, c).alias("trend"),
        ).alias("technical_indicators"),
    )


def price_alerts(enriched: DataFrame, threshold: float = prices.ALERT_PCT) -> DataFrame:
    """Alert rows for bars that moved more than ``threshold`` percent."""
    pct = F.col("technical_indicators.price_change_pct")
    return enriched.filter(prices.is_price_alert(pct, threshold)).select(
        F.lit("SIGNIFICANT_PRICE_CHANGE").alias("alert_type"),
        "ticker", "t",
        F.abs(pct).alias("price_change_pct"),
        F.col("c").alias("close_price"),
        prices.alert_message(F.col("ticker"), pct).alias("message"),
    )


def bars_with_alerts(enriched: DataFrame, threshold: float = prices.ALERT_PCT) -> DataFrame:
    """Every bar plus, after it, its alert: one pass, one or two rows out per row in."""
    pct = F.col("technical_indicators.price_change_pct")
    kinds = F.when(prices.is_price_alert(pct, threshold), F.array(F.lit("bar"), F.lit("alert"))).otherwise(
        F.array(F.lit("bar"))
    )
    alert = F.col("record_type") == "alert"
    return enriched.withColumn("record_type", F.explode(kinds)).select(
        "*",
        F.when(alert, "SIGNIFICANT_PRICE_CHANGE").alias("alert_type"),
        F.when(alert, prices.alert_message(F.col("ticker"), pct)).alias("message"),
    )


def bar_coverage(bars: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Bars per ticker within a range, with the first and the latest bar."""
    if start_ms is not None:
        bars = bars.filter(F.col("t") >= start_ms)
    if end_ms is not None:
        bars = bars.filter(F.col("t") <= end_ms)
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"),
        F.min("t").alias("first_t"),
        F.min_by("c", "t").alias("first_close"),
        F.max("t").alias("latest_t"),
        F.max_by("c", "t").alias("latest_close"),
    )


def day_of(t: Column) -> Column:
    return F.floor(t / F.lit(DAY_MS))
