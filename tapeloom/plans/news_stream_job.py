"""News stream: envelopes to the lake, and to the analytics tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.text import safe_double, surrogate_key
from tapeloom.functions.timing import parse_published
from tapeloom.operators import articles as art
from tapeloom.operators import merge
from tapeloom.sinks import id_sets
from tapeloom.sinks.lake import write_lake
from tapeloom.sources import paths

NEWS, MAPPING, DAILY = "news_sentiment_processed", "news_ticker_mapping", "ticker_sentiment_daily"
#: Ids stored so far: a folder per recent batch, older ones in parts with filters (`id_sets`).
IDS = "news_message_ids"
NEWS_DDL = (
    "id bigint, message_id string, source_id string, title string, url string, time_published timestamp, "
    "summary string, source_name string, overall_sentiment_score double, overall_sentiment_label string, date date, batch string"
)
MAPPING_DDL = (
    "news_id bigint, i int, ticker string, relevance_score double, ticker_sentiment_score double, "
    "ticker_sentiment_label string, time_published timestamp, date date, batch string"
)
DAILY_DDL = (
    "ticker string, news_count bigint, avg_sentiment_score double, bullish_count bigint, bearish_count bigint, "
    "neutral_count bigint, top_sentiment_score double, created_batch bigint, updated_batch bigint, date date"
)


def table(spark: SparkSession, base: str, name: str, ddl: str) -> DataFrame:
    path = f"{base}/{name}"
    return spark.read.schema(ddl).parquet(path) if paths.exists(spark, path) else spark.createDataFrame([], ddl)


def news_rows(messages: DataFrame) -> DataFrame:
    d = F.col("data")
    at = parse_published(d["time_published"])
    return messages.select(
        surrogate_key(F.col("message_id")).alias("id"),
        "message_id", "source_id", d["title"].alias("title"), d["url"].alias("url"), at.alias("time_published"),
        d["summary"].alias("summary"), d["source"].alias("source_name"),
        safe_double(d["overall_sentiment_score"]).alias("overall_sentiment_score"),
        d["overall_sentiment_label"].alias("overall_sentiment_label"), at.cast("date").alias("date"),
    ).filter(F.col("time_published").isNotNull())


def mapping_rows(messages: DataFrame) -> DataFrame:
    at = parse_published(F.col("data.time_published"))
    flat = messages.select("message_id", at.alias("time_published"), F.col("data.ticker_sentiment").alias("ticker_sentiment"))
    m = art.mentions_of(flat, "message_id", "time_published")
    return m.filter(F.col("time_published").isNotNull()).select(
        surrogate_key(F.col("message_id")).alias("news_id"), "i", "ticker", F.col("relevance").alias("relevance_score"),
        F.col("sentiment_score").alias("ticker_sentiment_score"),
        F.col("sentiment_label").alias("ticker_sentiment_label"), "time_published",
        F.to_date("time_published").alias("date"),
    )


def one_per_id(messages: DataFrame) -> DataFrame:
    """One message per id, the same for its article and its mentions: the earliest publication, then url and the rest."""
    published = parse_published(F.col("data.time_published"))
    order = [F.asc(published), F.asc("data.url"), F.asc("timestamp"), F.xxhash64("data")]
    timed = messages.filter(published.isNotNull() & F.col("message_id").isNotNull())
    return merge.last_per_key(timed, ["message_id"], order)


def days_of(df: DataFrame, days: list) -> DataFrame:
    """Rows of some days; literals, so that the scan lists and reads these partitions only."""
    return df.filter(F.col("date").isin(days)) if days else df.limit(0)


def process_batch(messages: DataFrame, batch_id: int, base: str, run: str = "stream") -> None:
    """Insert articles that are new, then their mentions, then recompute the days touched.

    An id is new if no other batch has stored it, on whatever day; filters tell which of the
    stored ids need reading for that. Ids are written first, under the batch's name, and articles and mentions by day and batch, so repeating a
    batch after a failure at any point replaces its own files and nothing else. ``run``
    tells the batches of several streams into the same tables apart.

    The driver sees the batch's distinct days: one date per calendar day at most. With them
    as literals only their partitions of mentions and daily rows are read.
    """
    spark, batch = messages.sparkSession, f"{run}-{batch_id}"
    ids = one_per_id(messages).persist()
    try:
        days = [x["date"] for x in news_rows(ids).select("date").distinct().collect()]
        known = id_sets.candidates(ids, f"{base}/{IDS}").filter(F.col("batch") != batch).select("message_id")
        fresh = ids.join(known, "message_id", "left_anti").withColumn("batch", F.lit(batch))
        for name, rows, partitions in (
            (IDS, fresh.select("message_id", "batch"), ("batch",)),
            (NEWS, news_rows(fresh).withColumn("batch", F.lit(batch)), ("date", "batch")),
            (MAPPING, mapping_rows(fresh).withColumn("batch", F.lit(batch)), ("date", "batch")),
        ):
            write_lake(rows, f"{base}/{name}", partitions, mode="overwrite")
        daily = art.daily_ticker_sentiment(days_of(table(spark, base, MAPPING, MAPPING_DDL), days).drop("date", "batch"))
        stamp = F.lit(batch_id).cast("long")
        stamped = daily.withColumns({"created_batch": stamp, "updated_batch": stamp})
        target = days_of(table(spark, base, DAILY, DAILY_DDL), days).select(*stamped.columns)
        merged = merge.upsert(target, stamped, ["ticker", "date"], keep=["created_batch"])
        write_lake(merged, f"{base}/{DAILY}", ("date",), mode="overwrite")
        id_sets.merge_full_levels(spark, f"{base}/{IDS}")
    finally:
        ids.unpersist()


def into_tables(base: str, run: str = "stream"):
    return lambda df, batch_id: process_batch(df, batch_id, base, run)


def lake_rows(messages: DataFrame) -> DataFrame:
    return art.with_ingest_date(art.flatten_envelope(messages))
