"""News: normalizing, enriching, exploding, aggregating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import news as nf
from tapeloom.functions.rounding import half_up, ratio
from tapeloom.functions.text import content_key, lenient_array, lenient_strings, safe_double
from tapeloom.functions.timing import parse_published

# Fields of a message that are empty text when absent.
FLAT_DEFAULTS = ("title", "url", "time_published", "summary", "source", "source_domain")


def _or_empty(name: str | Column) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.coalesce(col, F.lit(""))


def news_documents(raw: DataFrame, time_update: Column) -> DataFrame:
    """Feed items keyed by the hash of title and url plus the snapshot time."""
    t = time_update.cast("long")
    kept = [
        c for c in (
            "title", "url", "time_published", "authors", "summary", "source", "source_domain", "topics",
            "overall_sentiment_score", "overall_sentiment_label", "ticker_sentiment",
            "sentiment_score_definition", "relevance_score_definition",
        ) if c in raw.columns
    ]
    return raw.select(content_key(F.col("title"), F.col("url"), t).alias("_id"), *kept, t.alias("time_update"))


def _given(df: DataFrame, name: str) -> Column:
    """The column, or NULL where the documents lack it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _parsed(df: DataFrame, name: str, schema) -> Column:
    if name not in df.columns:
        return F.array().cast(schema)
    if dict(df.dtypes)[name] == "string":
        return lenient_strings(F.col(name)) if name == "authors" else lenient_array(F.col(name), schema)
    return F.coalesce(F.col(name).cast(schema), F.array().cast(schema))


def to_envelope(docs: DataFrame, message_id: Column | None = None, now: Column | None = None) -> DataFrame:
    """Stored document to message envelope; arrays may come as arrays, JSON or quoted lists."""
    tickers = _parsed(docs, "ticker_sentiment", schemas.TICKER_SENTIMENTS)
    prepared = docs.withColumn("_tickers", tickers)

    def field(name: str, default: str = "") -> Column:
        return F.coalesce(_given(docs, name), F.lit(default)).alias(name)

    source_id = F.coalesce(F.col("_id"), F.lit(""))
    key = nf.primary_ticker(F.col("_tickers"))
    stamp = F.current_timestamp() if now is None else now
    return prepared.select(
        (F.uuid() if message_id is None else message_id).alias("message_id"),
        source_id.alias("source_id"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.struct(
            field("title"), field("url"), field("time_published"),
            _parsed(docs, "authors", schemas.NEWS_DATA["authors"].dataType).alias("authors"),
            field("summary"), field("source"), field("category_within_source"), field("source_domain"),
            _parsed(docs, "topics", schemas.TOPICS).alias("topics"),
            safe_double(_given(docs, "overall_sentiment_score")).alias("overall_sentiment_score"),
            field("overall_sentiment_label", "Neutral"),
            F.col("_tickers").alias("ticker_sentiment"),
        ).alias("data"),
        F.struct(
            F.lit("tapeloom-news-producer").alias("producer"),
            F.lit("1.0").alias("version"),
            key.alias("partition_key"),
            source_id.alias("mongodb_id"),
        ).alias("metadata"),
    )


def from_either_shape(messages: DataFrame) -> DataFrame:
    """One flat shape from flat and enveloped messages alike."""
    names = [f.name for f in schemas.NEWS_DATA.fields]
    has_data = "data" in messages.columns

    def pick(name: str) -> Column:
        options = ([F.col("data")[name]] if has_data else []) + ([F.col(name)] if name in messages.columns else [])
        return F.coalesce(*options, F.lit(None)).alias(name)

    ids = [F.col(c) for c in ("message_id", "source_id", "_id") if c in messages.columns]
    return messages.select(F.coalesce(*ids).alias("message_id"), *[pick(n) for n in names])


def flatten_envelope(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Envelope to the lake row: 21 flat columns, first ticker promoted, arrays as JSON."""
    d = F.col("data")
    first = F.try_element_at(d["ticker_sentiment"], F.lit(1))
    return messages.select(
        _or_empty("message_id").alias("message_id"),
        _or_empty("source_id").alias("source_id"),
        _or_empty("timestamp").alias("timestamp"),
        (F.current_timestamp() if now is None else now).cast("string").alias("ingest_timestamp"),
        _or_empty(F.col("metadata")["producer"]).alias("producer"),
        _or_empty(F.col("metadata")["partition_key"]).alias("partition_key"),
        *[_or_empty(d[n]).alias(n) for n in FLAT_DEFAULTS],
        _or_empty(d["category_within_source"]).alias("category_within_source"),
        safe_double(d["overall_sentiment_score"]).alias("overall_sentiment_score"),
        _or_empty(d["overall_sentiment_label"]).alias("overall_sentiment_label"),
        _or_empty(first["ticker"]).alias("primary_ticker"),
        safe_double(first["ticker_sentiment_score"]).alias("primary_ticker_sentiment_score"),
        _or_empty(first["ticker_sentiment_label"]).alias("primary_ticker_sentiment_label"),
        F.to_json(F.coalesce(d["ticker_sentiment"], F.array().cast(schemas.TICKER_SENTIMENTS))).alias(
            "ticker_sentiment_json"
        ),
        F.to_json(F.coalesce(d["topics"], F.array().cast(schemas.TOPICS))).alias("topics_json"),
        F.to_json(F.coalesce(d["authors"], F.array().cast("array<string>"))).alias("authors_json"),
    )


def enrich_news(articles: DataFrame, processor: str = "tapeloom", now: Column | None = None) -> DataFrame:
    """Stateless enrichment of news messages; the same on tables and on streams."""
    mentions = nf.mention_structs(F.col("ticker_sentiment"))
    label, score = F.col("overall_sentiment_label"), F.col("overall_sentiment_score")
    return articles.select(
        "*",
        (F.current_timestamp() if now is None else now).alias("processed_at"),
        F.lit(processor).alias("processor"),
        nf.sentiment_analytics(label, score, mentions).alias("sentiment_analytics"),
        nf.sentiment_summary(label, score, mentions).alias("sentiment_summary"),
    )


def mentions_of(articles: DataFrame, *keep: str) -> DataFrame:
    """One row per mention, with its position in the article."""
    return articles.select(
        *keep, F.posexplode(nf.mention_structs(F.col("ticker_sentiment"))).alias("i", "m")
    ).select(*keep, "i", "m.*")


def unique_mentions_of(articles: DataFrame, *keep: str) -> DataFrame:
    """One row per (article, ticker); of repeated mentions the last counts."""
    return articles.select(
        *keep,
        F.explode(nf.last_mention_per_ticker(nf.mention_structs(F.col("ticker_sentiment")))).alias("m"),
    ).select(*keep, "m.*")


def topics_from_json(lake: DataFrame, *keep: str, column: str = "topics_json") -> DataFrame:
    return lake.select(*keep, F.explode(F.from_json(column, schemas.TOPICS)).alias("x")).select(*keep, "x.*")


def tickers_from_json(lake: DataFrame, *keep: str, column: str = "ticker_sentiment_json") -> DataFrame:
    return lake.select(*keep, F.explode(F.from_json(column, schemas.TICKER_SENTIMENTS)).alias("x")).select(
        *keep, "x.*"
    )


def _labelled(name: str) -> Column:
    return F.count_if(F.col("ticker_sentiment_label") == name)


def daily_ticker_sentiment(mapping: DataFrame) -> DataFrame:
    """Per (ticker, date): mentions, mean and best score, mentions per label."""
    s = F.col("ticker_sentiment_score")
    return (
        mapping.withColumn("date", F.to_date("time_published"))
        .groupBy("ticker", "date")
        .agg(
            F.count(F.lit(1)).alias("news_count"),
            half_up(F.avg(s), 6).alias("avg_sentiment_score"),
            _labelled("Bullish").alias("bullish_count"),
            _labelled("Bearish").alias("bearish_count"),
            _labelled("Neutral").alias("neutral_count"),
            F.max(s).alias("top_sentiment_score"),
        )
    )


def recompute_dates(batch_dates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Daily sentiment of just the dates the batch touched."""
    touched = batch_dates.select(F.to_date("time_published").alias("date")).distinct()
    dated = mapping.withColumn("date", F.to_date("time_published"))
    return daily_ticker_sentiment(dated.join(touched, "date", "left_semi").drop("date"))


def label_distribution(mapping: DataFrame, ticker: str, as_of: Column, days: int = 7) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    return (
        mapping.filter((F.col("ticker") == ticker) & (F.col("time_published") >= since))
        .groupBy("ticker_sentiment_label")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            half_up(F.avg("ticker_sentiment_score"), 6).alias("avg_score"),
        )
        .orderBy(F.desc("mentions"), "ticker_sentiment_label")
    )


def most_mentioned(mapping: DataFrame, as_of: Column, hours: int = 24, n: int = 20) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    return (
        mapping.filter(F.col("time_published") >= since)
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            half_up(F.avg("ticker_sentiment_score"), 6).alias("avg_sentiment"),
            _labelled("Bullish").alias("bullish"),
            _labelled("Bearish").alias("bearish"),
        )
        .orderBy(F.desc("mention_count"), "ticker")
        .limit(n)
    )


def daily_summary(daily: DataFrame, ticker: str, as_of: Column, days: int = 30) -> DataFrame:
    pct = ratio(F.col("bullish_count").cast("double"), F.col("news_count")) * 100
    return (
        daily.filter((F.col("ticker") == ticker) & (F.col("date") >= F.to_date(as_of - F.expr(f"INTERVAL {days} DAYS"))))
        .select(
            "ticker", "date", "news_count", "avg_sentiment_score", "bullish_count", "bearish_count",
            "neutral_count", half_up(pct, 6).alias("bullish_pct"),
        )
        .orderBy(F.desc("date"))
    )


def ticker_sentiment_report(unique_mentions: DataFrame, items: Column, start: Column, end: Column) -> DataFrame:
    """Statistics per ticker over a set of articles.

    ``items`` counts the whole set; means, spread and ratios use the articles naming the
    ticker, one mention each.
    """
    s = F.col("sentiment_score")
    n = F.count(s)
    positive, negative = F.count_if(s > 0.15), F.count_if(s < -0.15)
    share = lambda x: half_up(x / n, 2)
    report = unique_mentions.groupBy("ticker").agg(
        half_up(F.avg(s), 4).alias("avg_sentiment"),
        half_up(F.avg("relevance"), 4).alias("avg_relevance"),
        half_up(F.avg("weighted_score"), 4).alias("avg_weighted_sentiment"),
        half_up(F.stddev_pop(s), 4).alias("sentiment_volatility"),
        positive.alias("positive_count"),
        negative.alias("negative_count"),
        (n - positive - negative).alias("neutral_count"),
        share(positive).alias("positive_ratio"),
        share(negative).alias("negative_ratio"),
        share(n - positive - negative).alias("neutral_ratio"),
    )
    return report.select("*", items.alias("news_count"), start.alias("window_start"), end.alias("window_end"))


def sentiment_accumulation(enriched: DataFrame, *keys: str | Column) -> DataFrame:
    """Article-level sentiment per key: count, mean, total relevance and shares."""
    s = F.col("sentiment_analytics.overall_score")
    n = F.count(F.lit(1))
    share = lambda cond: half_up(F.count_if(cond) / n, 2)
    return enriched.groupBy(*keys).agg(
        n.alias("news_count"),
        half_up(F.sum(s) / n, 4).alias("avg_sentiment"),
        half_up(F.sum("sentiment_analytics.total_relevance"), 2).alias("total_relevance"),
        share(s > 0.15).alias("positive_ratio"),
        share(s < -0.15).alias("negative_ratio"),
        share(~((s > 0.15) | (s < -0.15))).alias("neutral_ratio"),
    )


def sentiment_partials(enriched: DataFrame, *keys: str | Column) -> DataFrame:
    """What a sentiment accumulator holds, per key: counts and sums, which add up over any parts of the articles."""
    s = F.col("sentiment_analytics.overall_score")
    return enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("news_count"), F.sum(s).alias("score_sum"),
        F.sum("sentiment_analytics.total_relevance").alias("relevance_sum"),
        F.count_if(s > 0.15).alias("positive"), F.count_if(s < -0.15).alias("negative"),
    )


def merged_sentiment(partials: DataFrame, *keys: str) -> DataFrame:
    """`sentiment_accumulation` from stored partials, without the articles; a row per part and key is all it reads."""
    total = {c: F.sum(c) for c in ("news_count", "score_sum", "relevance_sum", "positive", "negative")}
    n = total["news_count"]
    return partials.groupBy(*keys).agg(
        n.alias("news_count"), half_up(total["score_sum"] / n, 4).alias("avg_sentiment"),
        half_up(total["relevance_sum"], 2).alias("total_relevance"),
        half_up(total["positive"] / n, 2).alias("positive_ratio"), half_up(total["negative"] / n, 2).alias("negative_ratio"),
        half_up((n - total["positive"] - total["negative"]) / n, 2).alias("neutral_ratio"),
    )


def latest_for_ticker(mapping: DataFrame, ticker: str, n: int = 10) -> DataFrame:
    """Newest articles naming the ticker; ties broken by message id and position."""
    return (
        mapping.filter(F.col("ticker") == ticker)
        .orderBy(F.desc("time_published"), "message_id", "i")
        .limit(n)
    )


def skip_header(docs: DataFrame) -> DataFrame:
    """Drop the row a CSV import left behind; a missing title is kept."""
    return docs.filter(~F.col("title").eqNullSafe("title"))


def published_between(docs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Compact publication strings sort as text, so the predicate reaches the scan.

    Both dates are 'yyyy-MM-dd'; the end day is included.
    """
    from datetime import date, timedelta

    if start:
        docs = docs.filter(F.col("time_published") >= date.fromisoformat(start).strftime("%Y%m%dT000000"))
    if end:
        after = date.fromisoformat(end) + timedelta(days=1)
        docs = docs.filter(F.col("time_published") < after.strftime("%Y%m%dT000000"))
    return docs


def with_ingest_date(lake: DataFrame) -> DataFrame:
    return lake.withColumn("ingest_date", parse_published(F.col("time_published")).cast("date"))
