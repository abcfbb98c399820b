"""News warehouse job: topics, time, news and the two bridges from one lake range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.text import surrogate_key
from tapeloom.functions.timing import date_parts
from tapeloom.operators import articles as art
from tapeloom.operators.ranking import last_per_key


def news_key(lake: DataFrame, by: str = "message_id") -> Column:
    """Key of an article. ``by='timestamp'`` gives the arrival-time key of older loads."""
    return surrogate_key(lake[by])


def topic_dimension(lake: DataFrame) -> DataFrame:
    topics = art.topics_from_json(lake).select("topic").distinct()
    return topics.select(surrogate_key(F.col("topic")).alias("topic_id"), F.col("topic").alias("topic_name"))


def time_dimension(lake: DataFrame, date_col: str = "ingest_date") -> DataFrame:
    d = F.col("time_date")
    days = lake.select(F.col(date_col).alias("time_date")).distinct()
    return days.withColumn("time_id", surrogate_key(d)).withColumns(date_parts(d))


def news_dimension(lake: DataFrame, by: str = "message_id") -> DataFrame:
    """One row per article; of copies the one with the smallest stamp and id is kept."""
    rows = lake.select(
        news_key(lake, by).alias("news_id"),
        surrogate_key(F.col("ingest_date")).alias("news_time_id"),
        F.col("overall_sentiment_score").alias("news_overall_score"),
        F.col("title").alias("news_title"),
        F.col("summary").alias("news_summary"),
        F.col("category_within_source").alias("news_category_within_source"),
        F.col("source").alias("news_source"),
        "message_id", "timestamp", "ingest_date",
    )
    return last_per_key(rows, ["news_id"], [F.asc("timestamp"), F.asc("message_id")]).drop("timestamp")


def news_company_bridge(lake: DataFrame, by: str = "message_id") -> DataFrame:
    keyed = lake.withColumn("news_company_news_id", news_key(lake, by))
    x = art.tickers_from_json(keyed, "news_company_news_id", "message_id", "ingest_date")
    return x.select(
        "news_company_news_id",
        surrogate_key(F.col("ticker")).alias("news_company_company_id"),
        F.col("relevance_score").try_cast("double").alias("news_company_relevance_score"),
        F.col("ticker_sentiment_score").try_cast("double").alias("news_company_sentiment_score"),
        "message_id", "ticker", "ingest_date",
    )


def news_topic_bridge(lake: DataFrame, by: str = "message_id") -> DataFrame:
    keyed = lake.withColumn("news_topic_news_id", news_key(lake, by))
    x = art.topics_from_json(keyed, "news_topic_news_id", "message_id", "ingest_date")
    return x.select(
        "news_topic_news_id",
        surrogate_key(F.col("topic")).alias("news_topic_topic_id"),
        F.col("relevance_score").try_cast("double").alias("news_topic_relevance_score"),
        "message_id", "topic", "ingest_date",
    )


def run(spark, lake_path: str, warehouse: str, start: str, end: str) -> None:
    """Load ``[start, end)`` of the news lake; running a range again changes nothing."""
    from tapeloom.plans.candles_job import merge_dimension
    from tapeloom.sinks.lake import write_lake
    from tapeloom.sources.readers import lake_range

    lake = lake_range(spark, lake_path, start, end)
    merge_dimension(spark, f"{warehouse}/dim_topics", topic_dimension(lake), "topic_id")
    merge_dimension(spark, f"{warehouse}/dim_time", time_dimension(lake), "time_id")
    for name, rows in (
        ("dim_news", news_dimension(lake)),
        ("fact_news_companies", news_company_bridge(lake)),
        ("fact_news_topic", news_topic_bridge(lake)),
    ):
        write_lake(rows, f"{warehouse}/{name}", mode="overwrite")
