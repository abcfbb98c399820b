"""Column functions of one bar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up

VOLATILE_PCT = 5.0
ALERT_PCT = 3.0


def upper_wick(o: Column, h: Column, c: Column) -> Column:
    return h - F.greatest(o, c)


def lower_wick(o: Column, l: Column, c: Column) -> Column:
    return F.least(o, c) - l


def body_size(o: Column, c: Column) -> Column:
    return F.abs(c - o)


def typical_price(h: Column, l: Column, c: Column) -> Column:
    return (h + l + c) / 3


def avg_trade_size(v: Column, n: Column) -> Column:
    return F.when(n > 0, v / n).otherwise(F.lit(0.0))


def pct_of_positive(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` to two digits, 0 unless ``whole`` is positive."""
    return F.when(whole > 0, half_up(part / whole * 100, 2)).otherwise(F.lit(0.0))


def range_indicators(o: Column, h: Column, l: Column, c: Column) -> dict[str, Column]:
    """Range and change of a bar, absolute and in percent."""
    return {
        "price_range": half_up(h - l, 2),
        "price_range_pct": pct_of_positive(h - l, c),
        "price_change": half_up(c - o, 2),
        "price_change_pct": pct_of_positive(c - o, o),
    }


def volatility_flag(h: Column, l: Column, c: Column) -> Column:
    """'high' when the unrounded range exceeds 5 % of the close; a zero close is never high."""
    return F.when(
        F.when(c != 0, (h - l) / c * 100) > VOLATILE_PCT, F.lit("high")
    ).otherwise(F.lit("normal"))


def trend(o: Column, c: Column) -> Column:
    return F.when(c > o, "bullish").when(c < o, "bearish").otherwise(F.lit("neutral"))


def high_low_ratio(h: Column, l: Column) -> Column:
    return F.when(l > 0, half_up(h / l, 4)).otherwise(F.lit(0.0))


def notional(h: Column, l: Column, c: Column, v: Column) -> Column:
    """Typical price times volume (the source calls this a volume weighted price)."""
    return half_up(typical_price(h, l, c) * v, 2)


def is_price_alert(change_pct: Column, threshold: float = ALERT_PCT) -> Column:
    return F.abs(change_pct) > threshold


def alert_message(ticker: Column, change_pct: Column) -> Column:
    return F.format_string("Alert: %s moved %s%%", ticker, F.abs(change_pct).cast("decimal(18,2)").cast("string"))
