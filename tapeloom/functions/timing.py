"""Epochs, calendar parts and compact timestamps, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPACT = "yyyyMMdd'T'HHmmss"
DAY_MS = 86_400_000


def parse_published(value: Column) -> Column:
    """Compact form first, then ISO; NULL when neither fits, so the row can be dead-lettered."""
    return F.coalesce(
        F.try_to_timestamp(value, F.lit(COMPACT)), F.try_to_timestamp(F.replace(value, F.lit("Z"), F.lit("+00:00")))
    )


def compact(ts: Column, pattern: str = COMPACT) -> Column:
    return F.date_format(ts, pattern)


def epoch_ms_to_date(t: Column) -> Column:
    return F.timestamp_millis(t).cast("date")


def epoch_s_to_date_text(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd")


def epoch_s_to_compact_minute(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyyMMdd'T'HHmm")


def date_text_to_epoch_s(d: Column) -> Column:
    return F.unix_timestamp(d, "yyyy-MM-dd")


def truncate_epoch(t: Column, unit: int = 86_400) -> Column:
    """Largest multiple of ``unit`` toward zero."""
    return t - t % F.lit(unit).cast("long")


def month_bounds(d: Column) -> Column:
    """Second 1 of the month and second 0 of the next, in epoch seconds."""
    first = F.trunc(d, "month")
    start = F.unix_timestamp(first.cast("timestamp")) + 1
    end = F.unix_timestamp(F.add_months(first, 1).cast("timestamp"))
    return F.struct(start.alias("start_ts"), end.alias("end_ts"))


def date_parts(d: Column) -> dict[str, Column]:
    """Day of week counts from Sunday = 1."""
    return {
        "time_day_of_week": F.dayofweek(d),
        "time_month": F.month(d),
        "time_quarter": F.quarter(d),
        "time_year": F.year(d),
    }


def iso_week_parts(d: Column) -> dict[str, Column]:
    """ISO week with the year that week belongs to, so year ends stay together."""
    return {"year": F.extract(F.lit("YEAROFWEEK"), d).cast("int"), "week": F.weekofyear(d)}
