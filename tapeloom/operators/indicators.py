"""Technical indicators per bar, from the closes of the same ticker up to that bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up, ratio
from tapeloom.operators.slices import (
    prior_totals, sliced_window, trailing_stats, with_halo, without_halo,
)

SLICE_MS = 90 * 86_400_000
HISTORY = 200

SMA_PERIODS = (20, 50)
EMA_PERIODS = (20, 50)
RSI_PERIOD = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 0.9
VOLATILITY_CLOSES = 20


def bar_slices(bars: DataFrame, rows: int, slice_ms: int = SLICE_MS) -> DataFrame:
    """Bars in time slices of one ticker, each with the ``rows`` bars before it."""
    return with_halo(bars, "ticker", ["t"], rows, F.floor(F.col("t") / F.lit(slice_ms)))


def _last(n: int, skip: int = 0):
    return sliced_window("ticker", ["t"]).rowsBetween(-(n - 1 + skip), -skip)


def _enough(n: int) -> Column:
    return F.count("c").over(_last(n)) == n


def sma(period: int) -> Column:
    return F.when(_enough(period), half_up(F.avg("c").over(_last(period)), 2))


def ema_of(closes: Column, period: int) -> Column:
    """Fold over the last ``period`` closes, seeded by the oldest of them; NULL if there are fewer."""
    m = 2.0 / (period + 1)
    window = F.slice(closes, -period, period)
    folded = F.aggregate(
        F.slice(window, 2, period - 1),
        F.element_at(window, 1),
        lambda ema, x: x * F.lit(m) + ema * F.lit(1 - m),
    )
    return F.when(F.size(closes) >= period, half_up(folded, 2))


def _delta() -> Column:
    return F.col("c") - F.lag("c").over(sliced_window("ticker", ["t"]))


def rsi_columns(df: DataFrame, period: int = RSI_PERIOD) -> DataFrame:
    d = F.col("_delta")
    frame = _last(period)
    gain = F.sum(F.greatest(d, F.lit(0.0))).over(frame)
    loss = F.sum(F.greatest(-d, F.lit(0.0))).over(frame)
    full = F.count(d).over(frame) == period
    value = F.when(loss == 0, F.lit(100.0)).otherwise(half_up(100 - 100 / (1 + gain / loss), 2))
    return df.withColumn("_delta", _delta()).withColumn("rsi_14", F.when(full, value)).drop("_delta")


def macd_columns(df: DataFrame, closes: Column) -> DataFrame:
    """Difference of the already rounded averages; the signal line is a fixed share of it."""
    line = F.col("_fast") - F.col("_slow")
    return (
        df.withColumn("_slow", ema_of(closes, MACD_SLOW))
        .withColumn("_fast", F.when(F.col("_slow").isNotNull(), ema_of(closes, MACD_FAST)))
        .withColumn("macd_line", half_up(line, 2))
        .withColumn("signal_line", half_up(line * MACD_SIGNAL, 2))
        .withColumn("histogram", half_up(line - line * MACD_SIGNAL, 2))
        .drop("_slow", "_fast")
    )


def change_columns(df: DataFrame) -> DataFrame:
    prev = F.col("_prev")
    change = F.col("c") - prev
    return (
        df.withColumn("_prev", F.lag("c").over(sliced_window("ticker", ["t"])))
        .withColumn("price_change", half_up(change, 2))
        .withColumn(
            "price_change_pct",
            F.when(prev == 0, F.lit(0.0)).otherwise(half_up(ratio(change, prev) * 100, 2)),
        )
        .drop("_prev")
    )


def volatility_columns(df: DataFrame, closes: int = VOLATILITY_CLOSES) -> DataFrame:
    prev = F.lag("c").over(sliced_window("ticker", ["t"]))
    frame = _last(closes - 1)
    full = F.count("_ret").over(frame) == closes - 1
    return (
        df.withColumn("_ret", ratio(F.col("c") - prev, prev))
        .withColumn("volatility", F.when(full, half_up(F.stddev_pop("_ret").over(frame), 4)))
        .drop("_ret")
    )


def with_closes(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("_closes", F.collect_list("c").over(_last(n)))


def moving_averages(bars: DataFrame, periods=SMA_PERIODS) -> DataFrame:
    cut = bar_slices(bars, max(periods) - 1)
    return without_halo(cut.select("*", *[sma(p).alias(f"sma_{p}") for p in periods]))


def exponential_averages(bars: DataFrame, periods=EMA_PERIODS) -> DataFrame:
    cut = with_closes(bar_slices(bars, max(periods) - 1), max(periods))
    return without_halo(
        cut.select("*", *[ema_of(F.col("_closes"), p).alias(f"ema_{p}") for p in periods])
    ).drop("_closes")


def rsi(bars: DataFrame) -> DataFrame:
    return without_halo(rsi_columns(bar_slices(bars, RSI_PERIOD)))


def macd(bars: DataFrame) -> DataFrame:
    cut = with_closes(bar_slices(bars, MACD_SLOW - 1), MACD_SLOW)
    return without_halo(macd_columns(cut, F.col("_closes"))).drop("_closes")


def price_change(bars: DataFrame) -> DataFrame:
    return without_halo(change_columns(bar_slices(bars, 1)))


def volatility(bars: DataFrame) -> DataFrame:
    return without_halo(volatility_columns(bar_slices(bars, VOLATILITY_CLOSES - 1)))


def all_indicators(bars: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """Every indicator from one slicing: all frames share one shuffle and one sort."""
    longest = max(*SMA_PERIODS, *EMA_PERIODS, MACD_SLOW)
    df = with_closes(bar_slices(bars, longest - 1, slice_ms), longest)
    df = df.select("*", *[sma(p).alias(f"sma_{p}") for p in SMA_PERIODS])
    df = volatility_columns(change_columns(rsi_columns(df)))
    closes = F.col("_closes")
    df = without_halo(df)
    df = df.select("*", *[ema_of(closes, p).alias(f"ema_{p}") for p in EMA_PERIODS])
    return macd_columns(df, closes).drop("_closes")


def recent_history(bars: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last ``n`` bars of each ticker, numbered from the newest."""
    from pyspark.sql import Window as W

    newest = W.partitionBy("ticker").orderBy(F.desc("t"))
    return bars.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


WINDOW_NAMES = {300: "5min", 900: "15min", 3600: "1h"}


def window_report(stats: DataFrame, *keys: str) -> DataFrame:
    """The report per tick and window from its ``trailing_stats``, of a table or a stream."""
    change = F.when(F.col("data_points") > 1, F.col("last_price") - F.col("first_price")).otherwise(F.lit(0.0))
    name = F.create_map(*[F.lit(x) for pair in WINDOW_NAMES.items() for x in pair])
    return stats.select(
        *keys,
        F.coalesce(F.try_element_at(name, F.col("window_s")), F.col("window_s").cast("string")).alias("window"),
        "avg_price", "max_price", "min_price",
        change.alias("price_change"),
        F.coalesce(ratio(change, F.col("first_price")) * 100, F.lit(0.0)).alias("price_change_pct"),
        "total_volume", "data_points",
    )


def window_statistics(ticks: DataFrame, windows=tuple(WINDOW_NAMES)) -> DataFrame:
    """Trailing-window report per tick: mean, extremes, first-to-last change, volume."""
    return window_report(trailing_stats(ticks, windows), *ticks.columns)


def sentiment_anomalies(
    scores: DataFrame, key: str, order, value: str, slice_of: Column, threshold: float = 2.0, min_points: int = 10
) -> DataFrame:
    """Z-score of each value against all earlier values of its key.

    A history without any spread is recognised by equal extremes, which no rounding blurs.
    """
    return anomaly_report(prior_totals(scores, key, order, value, slice_of), value, scores.columns, threshold, min_points)


def anomaly_report(
    history: DataFrame, value: str, keys: Sequence[str], threshold: float = 2.0, min_points: int = 10, noise: float = 0.0
) -> DataFrame:
    """The report per value from the moments of all earlier ones (hist_n … hist_hi), of a table or a stream.

    A value no more than ``noise`` above the mean counts as equal to it, which is no spike.
    """
    n, x = F.col("hist_n"), F.col(value)
    mean = F.col("hist_mean")
    var = F.col("hist_m2") / F.when(n > 0, n)
    short, flat = n < min_points, F.col("hist_lo") == F.col("hist_hi")
    usable = ~(short | flat)
    sd = F.when(usable, F.sqrt(var))
    z = F.abs(ratio(x - mean, sd))
    return history.select(
        *keys,
        F.coalesce(usable & (z > threshold), F.lit(False)).alias("is_anomaly"),
        F.when(short, "insufficient_history").when(flat, "no_variance").alias("reason"),
        half_up(z, 2).alias("z_score"),
        F.when(usable, half_up(mean, 4)).alias("avg_sentiment"),
        half_up(sd, 4).alias("std_dev"),
        F.when(usable, F.when(x - mean > noise, "spike").otherwise("drop")).alias("direction"),
    )
