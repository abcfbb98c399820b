"""Market and news inputs as views over the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import news as nf
from tapeloom.operators import articles as art
from tapeloom.operators import candles
from tapeloom.operators.joins import EXCHANGE_MIC
from tapeloom.session import prepare

NEWS_START = 1704067200  # 2024-01-01 00:00:00 UTC
BATCH_START, BATCH_END = "2024-01-08", "2024-01-15"


class Views:
    """Lazily built inputs for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        prepare(spark)
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("T"), (F.col("user_id") % 8).cast("string")).alias("ticker"),
            "ts",
            F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
            "event_id",
            F.col("value").alias("price"),
            F.from_json("props", "k BIGINT")["k"].alias("volume"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        return candles.ticks_to_bars(self.ticks)

    @cached_property
    def lake_bars(self) -> DataFrame:
        return self.bars.withColumn("ingest_date", F.timestamp_millis("t").cast("date"))

    @cached_property
    def daily(self) -> DataFrame:
        trade = F.struct("l_orderkey", "l_linenumber", "px", "l_quantity")
        last = F.struct("l_orderkey", "l_linenumber", "px", "l_quantity")
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("p_brand").alias("ticker"),
                F.col("l_shipdate").cast("date").alias("d"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
                "l_quantity", "l_orderkey", "l_linenumber",
            )
            .groupBy("ticker", "d")
            .agg(
                F.min(trade)["px"].alias("o"), F.max("px").alias("h"), F.min("px").alias("l"),
                F.max(last)["px"].alias("c"), F.sum("l_quantity").alias("v"),
                F.count(F.lit(1)).alias("n"),
            )
        )

    @cached_property
    def daily_t(self) -> DataFrame:
        """Daily bars in the hourly bars' shape: ``t`` is midnight in epoch milliseconds."""
        return self.daily.select(
            "ticker", (F.unix_date("d").cast("long") * 86_400_000).alias("t"), "o", "h", "l", "c", "v", "n"
        )

    @cached_property
    def articles(self) -> DataFrame:
        d = F.col("doc_id")
        published = (NEWS_START + d % 1000 * 2592).alias("published_s")

        def mention(i):
            score = ((d * 37 + i * 61) % 201 - 100).cast("double") / 100
            relevance = ((d * 13 + i * 29) % 101).cast("double") / 100
            return F.struct(
                F.concat(F.lit("T"), ((d * (i + 1) + i) % 8).cast("string")).alias("ticker"),
                relevance.cast("string").alias("relevance_score"),
                score.cast("string").alias("ticker_sentiment_score"),
                nf.ticker_label(score).alias("ticker_sentiment_label"),
            )

        def topic(name: str):
            return F.struct(F.col(name).alias("topic"), F.lit("1.0").alias("relevance_score"))

        overall = ((d * 53) % 201 - 100).cast("double") / 100
        return self.table("documents").select(
            d.cast("string").alias("_id"),
            d.cast("string").alias("message_id"),
            "doc_id",
            F.concat(F.lit("doc "), d.cast("string")).alias("title"),
            F.concat(F.lit("http://news.example/"), d.cast("string")).alias("url"),
            published,
            F.timestamp_seconds(published).alias("published_at"),
            F.date_format(F.timestamp_seconds(published), "yyyyMMdd'T'HHmmss").alias("time_published"),
            F.array("source").alias("authors"),
            F.col("text").alias("summary"),
            "source",
            F.concat("source", F.lit(".example")).alias("source_domain"),
            F.col("lang").alias("category_within_source"),
            F.array(topic("lang"), topic("source")).alias("topics"),
            overall.cast("string").alias("overall_sentiment_score"),
            nf.ticker_label(overall).alias("overall_sentiment_label"),
            F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), mention).alias("ticker_sentiment"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        return art.mentions_of(self.articles, "doc_id", "message_id", "published_s", "published_at")

    @cached_property
    def unique_mentions(self) -> DataFrame:
        return art.unique_mentions_of(self.articles, "doc_id", "published_s")

    @cached_property
    def news_table(self) -> DataFrame:
        """The processed-news relation: one row per article, keyed by message id."""
        return self.articles.select(
            "message_id", F.col("doc_id").alias("id"), "title", "url",
            F.col("published_at").alias("time_published"), F.col("source").alias("source_name"),
            F.col("overall_sentiment_score").cast("double").alias("overall_sentiment_score"),
            "overall_sentiment_label",
        )

    @cached_property
    def mapping_table(self) -> DataFrame:
        """The news-ticker mapping relation: one row per mention, keyed by article id."""
        return self.mentions.select(
            F.col("doc_id").alias("news_id"), "i", "ticker",
            F.col("relevance").alias("relevance_score"),
            F.col("sentiment_score").alias("ticker_sentiment_score"),
            F.col("sentiment_label").alias("ticker_sentiment_label"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        """Mentions joined with their article."""
        return self.mapping_table.join(self.news_table, F.col("news_id") == F.col("id"))

    @cached_property
    def lake_news(self) -> DataFrame:
        envelopes = art.to_envelope(self.articles, F.col("message_id"), F.timestamp_seconds("published_s"))
        return art.with_ingest_date(art.flatten_envelope(envelopes))

    @cached_property
    def companies(self) -> DataFrame:
        """Two snapshots per brand; some fields of the first are missing."""
        base = self.table("part").groupBy("p_brand").agg(
            F.min("p_name").alias("name"), F.min("p_type").alias("industry"), F.min("p_size").alias("size")
        )
        snap = base.withColumn("time_update", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")))
        return snap.select(
            F.concat_ws("_", "p_brand", F.col("time_update").cast("string")).alias("_id"),
            F.col("p_brand").alias("ticker"),
            "name",
            F.lit("stocks").alias("market"),
            F.lit("us").alias("locale"),
            F.when(F.col("size") > 1, "XNAS").otherwise("XNYS").alias("primary_exchange"),
            F.lit("CS").alias("type"),
            F.lit("true").alias("active"),
            F.lit("usd").alias("currency_name"),
            F.when(F.col("time_update") == 2, F.col("size").cast("string")).alias("cik"),
            F.lit(None).cast("string").alias("composite_figi"),
            F.lit(None).cast("string").alias("share_class_figi"),
            "time_update",
            F.col("size").cast("string").alias("sic_code"),
            F.col("industry").alias("sic_description"),
        )

    @cached_property
    def lake_companies(self) -> DataFrame:
        return self.companies.filter("time_update = 2").select(
            F.col("name").alias("company_name"),
            F.col("ticker").alias("company_ticker"),
            F.col("market").alias("company_asset_type"),
            F.col("composite_figi").alias("company_composite_figi"),
            F.col("cik").alias("company_cik"),
            F.col("sic_description").alias("company_industry"),
            F.col("sic_code").alias("company_sic_code"),
        )

    @cached_property
    def markets(self) -> DataFrame:
        """One market document per region; its nations stand for the exchanges."""
        names = F.array(*[F.lit(x) for x in EXCHANGE_MIC])
        nations = self.table("nation").select("n_regionkey", "n_nationkey")
        listed = nations.groupBy("n_regionkey").agg(
            F.sort_array(F.collect_list("n_nationkey")).alias("keys")
        )
        joined = F.array_join(F.transform("keys", lambda k: F.get(names, k)), ", ")
        return (
            self.table("region").join(listed, F.col("r_regionkey") == F.col("n_regionkey"))
            .select(
                F.concat_ws("_", "r_name", F.lit("1704067200")).alias("_id"),
                F.lit("Equity").alias("market_type"),
                F.col("r_name").alias("region"),
                joined.alias("primary_exchanges"),
                F.lit("09:30").alias("local_open"),
                F.lit("16:00").alias("local_close"),
                F.when(F.col("r_regionkey") > 1, "open").otherwise("closed").alias("current_status"),
                F.lit("").alias("notes"),
                F.lit(NEWS_START).cast("long").alias("time_update"),
            )
        )


# The same views for the oracle. ---------------------------------------------------------

def r(expr: str, digits: int) -> str:
    """Half-up rounding, as ``functions.rounding.half_up``."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


TICKS = """ticks AS (
  SELECT concat('T', CAST(user_id % 8 AS VARCHAR)) AS ticker, ts, epoch_us(ts) // 1000 AS t, event_id,
         value AS price, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS volume
  FROM events)"""

BARS = TICKS + """, bars AS (
  SELECT ticker, bar AS t, min_by(price, ts) AS o, max(price) AS h, min(price) AS l,
         max_by(price, ts) AS c, CAST(sum(volume) AS DOUBLE) AS v, count(*) AS n,
         CASE WHEN sum(volume) <> 0 THEN sum(price * volume) / sum(volume) END AS vw,
         CAST(make_timestamp(bar * 1000) AS DATE) AS ingest_date
  FROM (SELECT *, t - t % 3600000 AS bar FROM ticks) q
  GROUP BY ticker, bar)"""

DAILY = """daily AS (
  SELECT ticker, d, max(CASE WHEN rf = 1 THEN px END) AS o, max(px) AS h, min(px) AS l,
         max(CASE WHEN rl = 1 THEN px END) AS c, sum(qty) AS v, count(*) AS n
  FROM (SELECT ticker, d, px, qty,
          row_number() OVER (PARTITION BY ticker, d ORDER BY ok, ln, px, qty) AS rf,
          row_number() OVER (PARTITION BY ticker, d ORDER BY ok DESC, ln DESC, px DESC, qty DESC) AS rl
        FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d,
                     l_extendedprice / l_quantity AS px, l_quantity AS qty,
                     l_orderkey AS ok, l_linenumber AS ln
              FROM lineitem JOIN part ON l_partkey = p_partkey) a) b
  GROUP BY ticker, d)"""

# Calendar gap fill: every day between the first and the last of a ticker.
FILLED = DAILY + """, filled AS (
  SELECT ticker, CAST(day AS DATE) AS d, o, h, l, c, CASE WHEN CAST(day AS DATE) = d THEN v ELSE 0 END AS v
  FROM (SELECT *, unnest(generate_series(CAST(d AS TIMESTAMP), CAST(coalesce(nd - 1, d) AS TIMESTAMP), INTERVAL 1 DAY)) AS day
        FROM (SELECT *, lead(d) OVER (PARTITION BY ticker ORDER BY d) AS nd FROM daily) x) y)"""


def _ret(x: str) -> str:
    return f"CASE WHEN p_{x} = 0 THEN 0 ELSE {x} / p_{x} - 1 END AS {x}_ret"


_F = "ohlcv"
RETURNS = FILLED + f""", lagged AS (
  SELECT *, {', '.join(f'lag({x}) OVER (PARTITION BY ticker ORDER BY d) AS p_{x}' for x in _F)} FROM filled),
returns AS (
  SELECT ticker, d, o, h, l, c, v, {', '.join(_ret(x) for x in _F)} FROM lagged
  WHERE p_o IS NOT NULL AND NOT ({' OR '.join(f'(p_{x} = 0 AND {x} = 0)' for x in _F)}))"""

NEWS = """news AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS message_id, concat('doc ', doc_id) AS title,
         concat('http://news.example/', doc_id) AS url, source, lang, text AS summary,
         1704067200 + (doc_id % 1000) * 2592 AS published_s,
         make_timestamp((1704067200 + (doc_id % 1000) * 2592) * 1000000) AS published_at,
         strftime(make_timestamp((1704067200 + (doc_id % 1000) * 2592) * 1000000), '%Y%m%dT%H%M%S') AS time_published,
         CAST(((doc_id * 53) % 201) - 100 AS DOUBLE) / 100 AS overall_score
  FROM documents)"""


def label(score: str) -> str:
    return f"CASE WHEN {score} >= 0.35 THEN 'Bullish' WHEN {score} <= -0.35 THEN 'Bearish' ELSE 'Neutral' END"


def category(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 0.35 THEN 'very_positive' WHEN {score} >= 0.15 THEN 'positive' "
        f"WHEN {score} >= -0.15 THEN 'neutral' WHEN {score} >= -0.35 THEN 'negative' ELSE 'very_negative' END"
    )


MENTIONS = NEWS + f""", raw_mentions AS (
  SELECT n.*, i, concat('T', CAST((doc_id * (i + 1) + i) % 8 AS VARCHAR)) AS ticker,
         CAST(((doc_id * 37 + i * 61) % 201) - 100 AS DOUBLE) / 100 AS score,
         CAST((doc_id * 13 + i * 29) % 101 AS DOUBLE) / 100 AS relevance
  FROM news n CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x),
mentions AS (SELECT *, {label('score')} AS label, score * relevance AS weighted FROM raw_mentions),
unique_mentions AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ticker ORDER BY i DESC) AS rn FROM mentions) q
  WHERE rn = 1)"""

DAILY_SENTIMENT_SELECT = f"""SELECT ticker, CAST(published_at AS DATE) AS date, count(*) AS news_count,
  {r('avg(score)', 6)} AS avg_sentiment_score,
  count(*) FILTER (label = 'Bullish') AS bullish_count, count(*) FILTER (label = 'Bearish') AS bearish_count,
  count(*) FILTER (label = 'Neutral') AS neutral_count, max(score) AS top_sentiment_score"""

COMPANIES = """companies AS (
  SELECT concat(p_brand, '_', tu) AS _id, p_brand AS ticker, name, size, industry, CAST(tu AS BIGINT) AS time_update,
         CASE WHEN size > 1 THEN 'XNAS' ELSE 'XNYS' END AS primary_exchange,
         CASE WHEN tu = 2 THEN CAST(size AS VARCHAR) END AS cik
  FROM (SELECT p_brand, min(p_name) AS name, min(p_type) AS industry, min(p_size) AS size FROM part GROUP BY p_brand) b
  CROSS JOIN (SELECT 1 AS tu UNION ALL SELECT 2) s)"""

_NAMES = ", ".join(f"'{x}'" for x in EXCHANGE_MIC)
_MICS = ", ".join(f"'{x}'" for x in EXCHANGE_MIC.values())
EXCHANGES = f"""exchanges AS (
  SELECT r_name AS exchange_region, ([{_NAMES}])[n_nationkey + 1] AS exchange_name,
         ([{_MICS}])[n_nationkey + 1] AS exchange_mic
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
