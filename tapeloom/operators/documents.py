"""Document shaping, search filters and the relational split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.text import composite_key, split_trim, surrogate_key
from tapeloom.operators.joins import exchange_mic

# Fields of the company and market documents.
COMPANY_FIELDS = (
    "ticker", "name", "market", "locale", "primary_exchange", "type", "active", "currency_name", "cik",
    "composite_figi", "share_class_figi",
)
MARKET_FIELDS = (
    "market_type", "region", "primary_exchanges", "local_open", "local_close", "current_status", "notes",
)


def _present(df: DataFrame, names) -> list[Column]:
    return [(F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n)) for n in names]


def company_documents(raw: DataFrame, time_update: Column) -> DataFrame:
    t = time_update.cast("long")
    return raw.select(
        composite_key(F.col("ticker"), t).alias("_id"), *_present(raw, COMPANY_FIELDS), t.alias("time_update")
    )


def market_documents(raw: DataFrame, time_update: Column) -> DataFrame:
    t = time_update.cast("long")
    return raw.select(
        composite_key(F.col("region"), t).alias("_id"), *_present(raw, MARKET_FIELDS), t.alias("time_update")
    )


def company_dimension(lake: DataFrame) -> DataFrame:
    """Lake companies to the dimension; missing text becomes 'Unknown'."""
    return lake.select(
        surrogate_key(F.col("company_ticker")).alias("company_id"),
        "company_name",
        "company_ticker",
        F.col("company_asset_type").alias("company_security_type"),
        "company_composite_figi",
        "company_cik",
        F.col("company_industry").alias("company_industry_name"),
        F.col("company_sic_code").alias("company_sic"),
    ).na.fill("Unknown")


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns])


def split_companies(docs: DataFrame) -> dict[str, DataFrame]:
    """Company documents to the ``companies`` and ``company_status`` relations."""

    def col(n: str) -> Column:
        return F.col(n) if n in docs.columns else F.lit(None).cast("string")

    companies = docs.select(
        col("ticker").alias("company_ticker"),
        col("cik").alias("company_cik"),
        col("composite_figi").alias("company_composite_figi"),
        col("locale").alias("company_market_locale"),
        col("share_class_figi").alias("company_share_class_figi"),
        col("market").alias("company_asset_type"),
        col("name").alias("company_name"),
        col("sic_code").alias("company_sic_code"),
        col("sic_description").alias("company_industry"),
    )
    status = docs.select(
        col("ticker").alias("company_status_ticker"),
        col("primary_exchange").alias("company_status_primary_exchange"),
        col("time_update").cast("int").alias("company_status_time_update"),
        col("type").alias("company_status_type"),
        col("active").alias("company_status_active"),
    )
    return {"companies": companies, "company_status": status}


def split_markets(docs: DataFrame) -> dict[str, DataFrame]:
    """Market documents to ``markets``, ``market_status`` and ``exchanges``."""
    markets = docs.select(
        F.col("region").alias("market_region"),
        F.col("market_type"),
        F.col("local_close").alias("market_local_close"),
        F.col("local_open").alias("market_local_open"),
    )
    status = docs.select(
        F.col("region").alias("market_status_region"),
        F.col("time_update").cast("int").alias("market_status_time_update"),
        F.col("current_status").alias("market_status_current_status"),
    )
    exchanges = docs.select(
        "region", F.explode(split_trim(F.col("primary_exchanges"))).alias("exchange_name")
    ).select(
        exchange_mic(F.col("exchange_name")).alias("exchange_mic"),
        F.col("region").alias("exchange_region"),
        "exchange_name",
    )
    return {"markets": markets, "market_status": status, "exchanges": exchanges}


def find_companies(
    docs: DataFrame, ticker: str | None = None, exchange: str | None = None,
    start: int | None = None, end: int | None = None,
) -> DataFrame:
    if ticker:
        docs = docs.filter(F.col("ticker") == ticker)
    if exchange:
        docs = docs.filter(F.col("primary_exchange") == exchange)
    return _between(docs, "time_update", start, end)


def find_bars(bars: DataFrame, ticker: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    if ticker:
        bars = bars.filter(F.col("ticker") == ticker)
    return _between(bars, "t", start, end)


def find_news(
    docs: DataFrame, pattern: str | None = None, start: str | None = None, end: str | None = None,
    tickers: str = "ticker_sentiment",
) -> DataFrame:
    """Articles whose mentions match a case-insensitive pattern, within a range of compact times.

    ``tickers`` may be text or an array of mentions; for an array the tickers are matched.
    """
    if pattern:
        rx = F.lit(f"(?i){pattern}")
        if dict(docs.dtypes)[tickers].startswith("array"):
            docs = docs.filter(F.exists(tickers, lambda m: F.rlike(m["ticker"], rx)))
        else:
            docs = docs.filter(F.rlike(F.col(tickers), rx))
    return _between(docs, "time_published", start, end)


def _between(df: DataFrame, column: str, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(column) >= start)
    if end is not None:
        df = df.filter(F.col(column) <= end)
    return df


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def success_rate(ok: Column) -> list[Column]:
    """Aggregates: processed, errors and the rate in percent, 0 for no input."""
    n, good = F.count(ok), F.count_if(ok)
    return [
        good.alias("processed"),
        (n - good).alias("errors"),
        F.when(n > 0, good / F.when(n > 0, n) * 100).otherwise(F.lit(0.0)).alias("success_rate"),
    ]


def output_counts(outputs: dict[str, DataFrame]) -> DataFrame:
    """Rows per named output."""
    parts = [df.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("rows")) for name, df in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
