"""The batch indicators from the history of closes that a stream hands each bar (`timed.close_history`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up, ratio
from tapeloom.operators import indicators as ind

def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _pairs(closes: Column, n: int, fn) -> Column:
    """``fn(previous, current)`` over the last ``n`` steps."""
    window = F.slice(closes, -(n + 1), n + 1)
    return F.zip_with(F.slice(window, 1, n), F.slice(window, 2, n), fn)


def indicators_of(df: DataFrame) -> DataFrame:
    """The batch indicators from the ``closes`` array of each row."""
    closes = F.col("closes")
    have = lambda n: F.size(closes) >= n
    prev, c = F.try_element_at(closes, F.lit(-2)), F.col("c")

    def sma(p: int) -> Column:
        return F.when(have(p), half_up(_sum(F.slice(closes, -p, p)) / p, 2))

    n = ind.RSI_PERIOD
    deltas = _pairs(closes, n, lambda a, b: b - a)
    gain = _sum(F.transform(deltas, lambda d: F.greatest(d, F.lit(0.0))))
    loss = _sum(F.transform(deltas, lambda d: F.greatest(-d, F.lit(0.0))))
    rsi = F.when(loss == 0, F.lit(100.0)).otherwise(half_up(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))), 2))

    k = ind.VOLATILITY_CLOSES - 1
    returns = _pairs(closes, k, lambda a, b: ratio(b - a, a))
    mean = _sum(returns) / k
    variance = F.aggregate(returns, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / k

    base = df.select(
        "*",
        *[sma(p).alias(f"sma_{p}") for p in ind.SMA_PERIODS],
        *[F.when(have(p), ind.ema_of(closes, p)).alias(f"ema_{p}") for p in ind.EMA_PERIODS],
        F.when(have(n + 1), rsi).alias("rsi_14"),
        half_up(c - prev, 2).alias("price_change"),
        F.when(prev == 0, F.lit(0.0)).otherwise(half_up(ratio(c - prev, prev) * 100, 2)).alias("price_change_pct"),
        F.when(have(k + 1), half_up(F.sqrt(variance), 4)).alias("volatility"),
    )
    return ind.macd_columns(base, closes).drop("closes")
