"""One explicit schema per dataset."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

OHLC = T.StructType(
    [T.StructField("_id", S), T.StructField("ticker", S), T.StructField("t", L)]
    + [T.StructField(name, D) for name in ("o", "h", "l", "c", "v")]
    + [T.StructField("time_update", L)]
)

OHLC_LAKE = T.StructType(
    OHLC.fields
    + [T.StructField("vw", D), T.StructField("n", L), T.StructField("ingest_date", T.DateType())]
)

TOPIC = _struct(topic=S, relevance_score=S)
TOPICS = T.ArrayType(TOPIC)

TICKER_SENTIMENT = _struct(
    ticker=S, relevance_score=S, ticker_sentiment_score=S, ticker_sentiment_label=S
)
TICKER_SENTIMENTS = T.ArrayType(TICKER_SENTIMENT)

NEWS = T.StructType(
    [T.StructField(n, S) for n in ("_id", "title", "url", "time_published")]
    + [T.StructField("authors", T.ArrayType(S))]
    + [T.StructField(n, S) for n in ("summary", "source", "source_domain")]
    + [T.StructField("topics", TOPICS)]
    + [T.StructField(n, S) for n in ("overall_sentiment_score", "overall_sentiment_label")]
    + [T.StructField("ticker_sentiment", TICKER_SENTIMENTS), T.StructField("time_update", L)]
)

NEWS_DATA = T.StructType(
    [T.StructField(n, S) for n in ("title", "url", "time_published")]
    + [T.StructField("authors", T.ArrayType(S))]
    + [T.StructField(n, S) for n in ("summary", "source", "category_within_source", "source_domain")]
    + [
        T.StructField("topics", TOPICS),
        T.StructField("overall_sentiment_score", D),
        T.StructField("overall_sentiment_label", S),
        T.StructField("ticker_sentiment", TICKER_SENTIMENTS),
    ]
)

NEWS_ENVELOPE = T.StructType(
    [
        T.StructField("message_id", S),
        T.StructField("source_id", S),
        T.StructField("timestamp", S),
        T.StructField("data", NEWS_DATA),
        T.StructField("metadata", _struct(producer=S, version=S, partition_key=S, mongodb_id=S)),
    ]
)

COMPANY = T.StructType(
    [
        T.StructField(n, S)
        for n in (
            "_id", "ticker", "name", "market", "locale", "primary_exchange", "type", "active",
            "currency_name", "cik", "composite_figi", "share_class_figi",
        )
    ]
    + [T.StructField("time_update", L)]
)

COMPANY_LAKE = T.StructType(
    [
        T.StructField(n, S)
        for n in (
            "company_name", "company_ticker", "company_asset_type", "company_composite_figi",
            "company_cik", "company_industry", "company_sic_code",
        )
    ]
)

MARKET_STATUS = T.StructType(
    [
        T.StructField(n, S)
        for n in (
            "_id", "market_type", "region", "primary_exchanges", "local_open", "local_close",
            "current_status", "notes",
        )
    ]
    + [T.StructField("time_update", L)]
)

EMPLOYEE = T.StructType(
    [
        T.StructField("id", I, False),
        T.StructField("name", S),
        T.StructField("department", S),
        T.StructField("salary", I),
        T.StructField("hire_date", S),
    ]
)

# The relational source's tables, their columns and their keys.
RELATIONAL_COLUMNS = {
    "companies": [
        "company_ticker", "company_cik", "company_composite_figi", "company_market_locale",
        "company_share_class_figi", "company_asset_type", "company_name", "company_sic_code",
        "company_industry",
    ],
    "company_status": [
        "company_status_ticker", "company_status_primary_exchange", "company_status_time_update",
        "company_status_type", "company_status_active",
    ],
    "markets": ["market_region", "market_type", "market_local_close", "market_local_open"],
    "market_status": [
        "market_status_region", "market_status_time_update", "market_status_current_status",
    ],
    "exchanges": ["exchange_mic", "exchange_region", "exchange_name"],
}

FOREIGN_KEYS = [
    ("company_status", "company_status_ticker", "companies", "company_ticker"),
    ("company_status", "company_status_primary_exchange", "exchanges", "exchange_mic"),
    ("exchanges", "exchange_region", "markets", "market_region"),
    ("market_status", "market_status_region", "markets", "market_region"),
]


def relational_schema(table: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(c, I if c.endswith("_time_update") else S)
            for c in RELATIONAL_COLUMNS[table]
        ]
    )
