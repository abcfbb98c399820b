"""Column functions of one article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up
from tapeloom.functions.text import safe_double

UNKNOWN_TICKER = "UNKNOWN"


def sentiment_category(score: Column) -> Column:
    """Five classes, lower bounds inclusive."""
    return (
        F.when(score >= 0.35, "very_positive")
        .when(score >= 0.15, "positive")
        .when(score >= -0.15, "neutral")
        .when(score >= -0.35, "negative")
        .when(score.isNotNull(), "very_negative")
    )


def sentiment_bucket(score: Column) -> Column:
    """Three classes, both bounds exclusive: exactly 0.15 is neutral here."""
    return (
        F.when(score > 0.15, "positive").when(score < -0.15, "negative").when(score.isNotNull(), "neutral")
    )


def ticker_label(score: Column) -> Column:
    return F.when(score >= 0.35, "Bullish").when(score <= -0.35, "Bearish").otherwise(F.lit("Neutral"))


def mention_structs(ticker_sentiment: Column) -> Column:
    """Typed view of the raw string structs, with the weighted score."""

    def typed(m: Column) -> Column:
        score = safe_double(m["ticker_sentiment_score"])
        relevance = safe_double(m["relevance_score"])
        return F.struct(
            m["ticker"].alias("ticker"),
            score.alias("sentiment_score"),
            m["ticker_sentiment_label"].alias("sentiment_label"),
            relevance.alias("relevance"),
            (score * relevance).alias("weighted_score"),
        )

    return F.transform(F.coalesce(ticker_sentiment, F.array().cast(TICKER_SENTIMENT_DDL)), typed)


TICKER_SENTIMENT_DDL = (
    "array<struct<ticker:string,relevance_score:string,"
    "ticker_sentiment_score:string,ticker_sentiment_label:string>>"
)


def total(mentions: Column, field: str) -> Column:
    """Sum of one field over the mentions, in array order."""
    return F.aggregate(mentions, F.lit(0.0), lambda acc, m: acc + F.coalesce(m[field], F.lit(0.0)))


def weighted_sentiment(mentions: Column) -> Column:
    """Relevance-weighted mean score; 0 when nothing is relevant."""
    relevance = total(mentions, "relevance")
    return F.when(relevance > 0, half_up(total(mentions, "weighted_score") / relevance, 4)).otherwise(
        F.lit(0.0)
    )


def last_mention_per_ticker(mentions: Column) -> Column:
    """Drop null tickers and keep, for a ticker named twice, only the later mention.

    Runs inside the row, so no shuffle is needed.
    """
    named = F.filter(mentions, lambda m: m["ticker"].isNotNull() & (m["ticker"] != ""))
    tickers = F.transform(named, lambda m: m["ticker"])
    last_index = lambda m: F.size(named) - F.array_position(F.reverse(tickers), m["ticker"])
    return F.filter(named, lambda m, i: i == last_index(m))


def metrics_map(mentions: Column) -> Column:
    """Ticker → metrics, the later of two mentions winning."""
    return F.map_from_entries(
        F.transform(last_mention_per_ticker(mentions), lambda m: F.struct(m["ticker"], m))
    )


def primary_ticker(ticker_sentiment: Column) -> Column:
    """Ticker of the first mention, else ``UNKNOWN``."""
    return F.coalesce(F.try_element_at(ticker_sentiment, F.lit(1))["ticker"], F.lit(UNKNOWN_TICKER))


def sentiment_summary(label: Column, score: Column, mentions: Column) -> Column:
    return F.struct(
        F.size(mentions).alias("ticker_count"),
        F.coalesce(label, F.lit("Unknown")).alias("overall_sentiment"),
        safe_double(score).alias("overall_score"),
        F.transform(
            mentions,
            lambda m: F.struct(
                m["ticker"].alias("ticker"),
                m["sentiment_label"].alias("sentiment"),
                m["sentiment_score"].alias("score"),
                m["relevance"].alias("relevance"),
            ),
        ).alias("tickers"),
    )


def sentiment_analytics(label: Column, score: Column, mentions: Column) -> Column:
    overall = safe_double(score)
    return F.struct(
        overall.alias("overall_score"),
        F.coalesce(label, F.lit("Unknown")).alias("overall_label"),
        F.size(mentions).alias("ticker_count"),
        weighted_sentiment(mentions).alias("avg_weighted_sentiment"),
        half_up(total(mentions, "relevance"), 2).alias("total_relevance"),
        mentions.alias("tickers"),
        sentiment_category(overall).alias("sentiment_category"),
    )


#: Characters of a title in a line about its article.
TITLE_PREFIX = 50


def article_line(title: Column, label: Column, score: Column, tickers: Column) -> Column:
    """One line about a processed article: the beginning of its title, label, score and number of tickers."""
    return F.format_string(
        "Processed News: %s... | Sentiment: %s (%s) | Tickers: %d",
        F.substring(F.coalesce(title, F.lit("No title")), 1, TITLE_PREFIX), label,
        score.cast("decimal(18,2)").cast("string"), tickers.cast("long"))
