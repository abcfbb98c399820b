"""Queries over articles and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import news as nf
from tapeloom.functions import text, timing
from tapeloom.functions.rounding import half_up
from tapeloom.operators import articles as art
from tapeloom.operators import documents, indicators, joins, quality, ranking
from tapeloom.queries.registry import ORACLE, query
from tapeloom.session import work_dir
from tapeloom.sinks import lake as lake_sink
from tapeloom.sinks import news_index
from tapeloom.views import (
    COMPANIES, DAILY_SENTIMENT_SELECT, EXCHANGES, MENTIONS, NEWS, Views, category, label, r,
)

_LATEST = "(SELECT max(published_at) FROM news)"


def _as_of(v: Views):
    return v.news_table.agg(F.max("time_published")).scalar()


# Scalars ----------------------------------------------------------------------------------

@query("scl1_sentiment_category", f"WITH {NEWS} SELECT doc_id, overall_score, {category('overall_score')} AS category FROM news")
def scl1(v: Views):
    s = F.col("overall_sentiment_score").cast("double")
    return v.articles.select("doc_id", s.alias("overall_score"), nf.sentiment_category(s).alias("category"))


@query(
    "scl2_sentiment_bucket",
    f"WITH {MENTIONS} SELECT doc_id, i, score, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS bucket FROM (SELECT doc_id, CAST(i AS INTEGER) AS i, score FROM mentions) m",
)
def scl2(v: Views):
    s = F.col("sentiment_score")
    return v.mentions.select("doc_id", "i", s.alias("score"), nf.sentiment_bucket(s).alias("bucket"))


@query(
    "scl3_weighted_sentiment",
    f"WITH {MENTIONS} SELECT doc_id, CASE WHEN sum(relevance) > 0 THEN {r('sum(weighted) / nullif(sum(relevance), 0)', 4)} ELSE 0 END AS avg_weighted_sentiment, {r('sum(relevance)', 2)} AS total_relevance FROM mentions GROUP BY doc_id",
)
def scl3(v: Views):
    m = nf.mention_structs(F.col("ticker_sentiment"))
    return v.articles.select(
        "doc_id", nf.weighted_sentiment(m).alias("avg_weighted_sentiment"),
        half_up(nf.total(m, "relevance"), 2).alias("total_relevance"),
    )


@query(
    "scl4_metrics_map",
    f"WITH {MENTIONS} SELECT doc_id, ticker, score AS sentiment_score, relevance, {r('weighted', 6)} AS weighted_score, label AS sentiment_label FROM unique_mentions",
)
def scl4(v: Views):
    m = nf.metrics_map(nf.mention_structs(F.col("ticker_sentiment")))
    return v.articles.select("doc_id", F.explode(m).alias("ticker", "x")).select(
        "doc_id", "ticker", "x.sentiment_score", "x.relevance", half_up(F.col("x.weighted_score"), 6).alias("weighted_score"),
        "x.sentiment_label",
    )


@query("scl10_parse_published", f"WITH {NEWS} SELECT doc_id, published_s AS from_compact, published_s AS from_iso, CAST(NULL AS BIGINT) AS from_junk FROM news")
def scl10(v: Views):
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    secs = lambda c: F.unix_seconds(timing.parse_published(c))
    return v.articles.select(
        "doc_id", secs(F.col("time_published")).alias("from_compact"), secs(iso).alias("from_iso"),
        secs(F.col("summary")).alias("from_junk"),
    )


@query(
    "scl11_epoch_conversions",
    f"WITH {NEWS} SELECT doc_id, strftime(published_at, '%Y-%m-%d') AS day_text, strftime(published_at, '%Y%m%dT%H%M') AS compact_minute, CAST(published_at AS DATE) AS day FROM news",
)
def scl11(v: Views):
    s = F.col("published_s")
    return v.articles.select(
        "doc_id", timing.epoch_s_to_date_text(s).alias("day_text"), timing.epoch_s_to_compact_minute(s).alias("compact_minute"),
        timing.epoch_ms_to_date(s * 1000).alias("day"),
    )


@query("scl12_date_text_to_epoch", f"WITH {NEWS} SELECT doc_id, CAST(epoch(CAST(CAST(published_at AS DATE) AS TIMESTAMP)) AS BIGINT) AS day_epoch FROM news")
def scl12(v: Views):
    return v.articles.select("doc_id", timing.date_text_to_epoch_s(F.date_format("published_at", "yyyy-MM-dd")).alias("day_epoch"))


@query("scl13_truncate_epoch", f"WITH {NEWS} SELECT doc_id, published_s - published_s % 86400 AS day_start, published_s - published_s % 3600 AS hour_start FROM news")
def scl13(v: Views):
    s = F.col("published_s")
    return v.articles.select("doc_id", timing.truncate_epoch(s).alias("day_start"), timing.truncate_epoch(s, 3600).alias("hour_start"))


@query(
    "scl14_month_bounds",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) + 1 AS start_ts, CAST(epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS BIGINT) AS end_ts FROM orders",
)
def scl14(v: Views):
    d = v.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select("d", timing.month_bounds(F.col("d")).alias("b")).select("d", "b.start_ts", "b.end_ts")


@query(
    "scl15_date_parts",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS time_day_of_week, CAST(month(o_orderdate) AS INTEGER) AS time_month, CAST(quarter(o_orderdate) AS INTEGER) AS time_quarter, CAST(year(o_orderdate) AS INTEGER) AS time_year FROM orders",
)
def scl15(v: Views):
    d = v.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.withColumns(timing.date_parts(F.col("d")))


@query(
    "scl16_iso_week",
    "SELECT CAST(isoyear(o_orderdate) AS INTEGER) AS year, CAST(week(o_orderdate) AS INTEGER) AS week, count(*) AS orders FROM orders GROUP BY ALL",
)
def scl16(v: Views):
    d = v.table("orders").withColumns(timing.iso_week_parts(F.col("o_orderdate").cast("date")))
    return d.groupBy("year", "week").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "scl17_relative_dates",
    f"WITH {NEWS} SELECT count(*) FILTER (published_at >= {_LATEST} - INTERVAL 24 HOURS) AS last_day, count(*) FILTER (published_at >= {_LATEST} - INTERVAL 7 DAYS) AS last_week, "
    f"count(*) FILTER (published_at >= {_LATEST} - INTERVAL 30 DAYS) AS last_month, count(*) FILTER (CAST(published_at AS DATE) = CAST({_LATEST} AS DATE)) AS today FROM news",
)
def scl17(v: Views):
    at, now = F.col("time_published"), _as_of(v)
    since = lambda text: F.count_if(at >= now - F.expr(f"INTERVAL {text}"))
    return v.news_table.agg(
        since("24 HOURS").alias("last_day"), since("7 DAYS").alias("last_week"), since("30 DAYS").alias("last_month"),
        F.count_if(F.to_date(at) == F.to_date(now)).alias("today"),
    )


@query(
    "scl18_conditional_sums",
    f"WITH {MENTIONS} SELECT CAST(published_at AS DATE) AS day, count(*) FILTER (label = 'Bullish') AS bullish, {r('sum(relevance) / nullif(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END), 0)', 4)} AS relevance_per_positive FROM mentions GROUP BY ALL",
)
def scl18(v: Views):
    positive = F.count_if(F.col("sentiment_score") > 0)
    return v.mentions.groupBy(F.to_date("published_at").alias("day")).agg(
        F.count_if(F.col("sentiment_label") == "Bullish").alias("bullish"),
        half_up(F.sum("relevance") / F.nullif(positive, F.lit(0)), 4).alias("relevance_per_positive"),
    )


@query(
    "scl19_surrogate_keys",
    f"WITH {MENTIONS} SELECT ticker, CAST(published_at AS DATE) AS d, count(*) AS mentions, CAST(1 AS BIGINT) AS keys FROM mentions GROUP BY ALL",
)
def scl19(v: Views):
    """The hash key groups exactly as the natural key does."""
    d = F.to_date("published_at")
    keyed = v.mentions.select("ticker", d.alias("d"), text.surrogate_key(F.col("ticker"), d).alias("key"))
    return keyed.groupBy("ticker", "d").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("key").alias("keys"))


@query("scl20_composite_key", f"WITH {NEWS} SELECT doc_id, concat(source, '_', published_s) AS key FROM news")
def scl20(v: Views):
    return v.articles.select("doc_id", text.composite_key(F.col("source"), F.col("published_s")).alias("key"))


@query("scl21_content_hash", f"WITH {NEWS} SELECT doc_id, concat(sha256(concat(title, '_', url)), '_', 1706572800) AS _id, sha256(summary) AS text_hash FROM news")
def scl21(v: Views):
    return v.articles.select(
        "doc_id", text.content_key(F.col("title"), F.col("url"), F.lit(1706572800)).alias("_id"), F.sha2("summary", 256).alias("text_hash")
    )


@query(
    "scl22_json_explode",
    f"WITH {MENTIONS} SELECT message_id, ticker, relevance, score FROM mentions",
)
def scl22(v: Views):
    x = art.tickers_from_json(v.lake_news, "message_id")
    return x.select(
        "message_id", "ticker", F.col("relevance_score").cast("double").alias("relevance"),
        F.col("ticker_sentiment_score").cast("double").alias("score"),
    )


@query(
    "scl23_lenient_lists",
    f"WITH {NEWS} SELECT doc_id, 2 AS topics, source AS first_author, source AS scalar_author, 0 AS junk FROM news",
)
def scl23(v: Views):
    """The same lists as JSON, as a quoted list, as a bare scalar and as free text."""
    quoted = F.replace(F.to_json("topics"), F.lit('"'), F.lit("'"))
    return v.articles.select(
        "doc_id",
        F.size(text.lenient_array(quoted, schemas.TOPICS)).alias("topics"),
        F.element_at(text.lenient_strings(F.to_json("authors")), 1).alias("first_author"),
        F.element_at(text.lenient_strings(F.col("source")), 1).alias("scalar_author"),
        F.size(text.lenient_array(F.col("summary"), schemas.TOPICS)).alias("junk"),
    )


@query("scl24_safe_double", f"WITH {NEWS} SELECT doc_id, overall_score AS number, 0.0::DOUBLE AS junk FROM news")
def scl24(v: Views):
    return v.articles.select(
        "doc_id", text.safe_double(F.col("overall_sentiment_score")).alias("number"), text.safe_double(F.col("title")).alias("junk")
    )


@query(
    "scl25_json_serialize",
    f"WITH {NEWS} SELECT message_id, concat('[{{\"topic\":\"', lang, '\",\"relevance_score\":\"1.0\"}},{{\"topic\":\"', source, '\",\"relevance_score\":\"1.0\"}}]') AS topics_json, concat('[\"', source, '\"]') AS authors_json FROM news",
)
def scl25(v: Views):
    return v.lake_news.select("message_id", "topics_json", "authors_json")


@query("scl26_split_trim", f"WITH {EXCHANGES} SELECT exchange_region AS region, exchange_name AS exchange FROM exchanges")
def scl26(v: Views):
    return v.markets.select("region", F.explode(text.split_trim(F.col("primary_exchanges"))).alias("exchange"))


@query("scl27_sizes_and_defaults", f"WITH {NEWS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END AS ticker_count, CASE WHEN doc_id % 7 = 0 THEN 'Unknown' ELSE source END AS label FROM news")
def scl27(v: Views):
    """Some articles lack the array, some the source."""
    rows = v.articles.select(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("ticker_sentiment")).alias("tickers"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    size = F.when(F.col("tickers").isNull(), 0).otherwise(F.size("tickers"))
    return rows.select("doc_id", size.alias("ticker_count"), F.coalesce("source", F.lit("Unknown")).alias("label"))


@query(
    "scl28_article_line",
    f"WITH {NEWS} SELECT doc_id, concat('Processed News: ', CASE WHEN doc_id % 3 = 0 THEN 'No title' ELSE coalesce(substr(summary, 1, 50), 'No title') END, '... | Sentiment: ', {label('overall_score')}, ' (', CAST(CAST(overall_score AS DECIMAL(18,2)) AS VARCHAR), ') | Tickers: 3') AS line FROM news",
)
def scl28_article_line(v: Views):
    """The text stands for the title; some articles lack it."""
    score = F.col("overall_sentiment_score").cast("double")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("summary"))
    return v.articles.select("doc_id", nf.article_line(title, nf.ticker_label(score), score, F.size("ticker_sentiment")).alias("line"))


@query("scl30_message_id", f"WITH {NEWS} SELECT doc_id, sha256(concat(message_id, '|', published_s)) AS message_key, CAST(36 AS INTEGER) AS uuid_length FROM news")
def scl30(v: Views):
    return v.articles.select(
        "doc_id", F.sha2(F.concat_ws("|", "message_id", F.col("published_s").cast("string")), 256).alias("message_key"),
        F.length(F.uuid()).alias("uuid_length"),
    )


# Projections ------------------------------------------------------------------------------

@query("prj5_news_dimension", f"WITH {NEWS} SELECT message_id, CAST(published_at AS DATE) AS news_date, overall_score AS news_overall_score, title AS news_title, summary AS news_summary, lang AS news_category_within_source, source AS news_source FROM news")
def prj5(v: Views):
    from tapeloom.plans.news_job import news_dimension

    n = news_dimension(v.lake_news)
    return n.select(
        "message_id", F.col("ingest_date").alias("news_date"), "news_overall_score", "news_title", "news_summary",
        "news_category_within_source", "news_source",
    )


@query("prj6_envelope", f"WITH {MENTIONS} SELECT message_id, message_id AS source_id, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, ticker AS partition_key, title, overall_score FROM mentions WHERE i = 0")
def prj6(v: Views):
    e = art.to_envelope(v.articles, F.col("message_id"), F.timestamp_seconds("published_s"))
    return e.select(
        "message_id", "source_id", "timestamp", "metadata.partition_key", "data.title",
        F.col("data.overall_sentiment_score").alias("overall_score"),
    )


@query(
    "prj7_envelope_flatten",
    f"WITH {MENTIONS} SELECT message_id, title, url, time_published, summary, source, lang AS category_within_source, overall_score AS overall_sentiment_score, {label('overall_score')} AS overall_sentiment_label, "
    f"ticker AS primary_ticker, score AS primary_ticker_sentiment_score, label AS primary_ticker_sentiment_label, CAST(published_at AS DATE) AS ingest_date FROM mentions WHERE i = 0",
)
def prj7(v: Views):
    return v.lake_news.select(
        "message_id", "title", "url", "time_published", "summary", "source", "category_within_source", "overall_sentiment_score",
        "overall_sentiment_label", "primary_ticker", "primary_ticker_sentiment_score", "primary_ticker_sentiment_label", "ingest_date",
    )


@query("prj9_news_documents", f"WITH {NEWS} SELECT concat(sha256(concat(title, '_', url)), '_', 1706572800) AS _id, title, url, time_published, summary, source, CAST(1706572800 AS BIGINT) AS time_update FROM news")
def prj9(v: Views):
    d = art.news_documents(v.articles, F.lit(1706572800))
    return d.select("_id", "title", "url", "time_published", "summary", "source", "time_update")


@query(
    "prj15_sentiment_summary",
    f"WITH {MENTIONS} SELECT doc_id, {label('overall_score')} AS overall_sentiment, overall_score, 3 AS ticker_count, ticker, label AS sentiment, score, relevance FROM mentions",
)
def prj15(v: Views):
    m = nf.mention_structs(F.col("ticker_sentiment"))
    s = nf.sentiment_summary(F.col("overall_sentiment_label"), F.col("overall_sentiment_score"), m)
    return v.articles.select("doc_id", s.alias("s")).select(
        "doc_id", "s.overall_sentiment", "s.overall_score", "s.ticker_count", F.explode("s.tickers").alias("t")
    ).select("doc_id", "overall_sentiment", "overall_score", "ticker_count", "t.*")


@query("prj16_processing_metadata", f"WITH {NEWS} SELECT doc_id, 'tapeloom' AS processor, TRUE AS stamped FROM news")
def prj16(v: Views):
    return art.enrich_news(v.articles).select("doc_id", "processor", F.col("processed_at").isNotNull().alias("stamped"))


# Filters ----------------------------------------------------------------------------------

@query("flt1_header_skip", f"WITH {NEWS} SELECT doc_id, title FROM news WHERE title <> 'title'")
def flt1(v: Views):
    """A header row, as an export repeated into the table leaves one, and the articles."""
    header = v.articles.orderBy("doc_id").limit(1).withColumn("title", F.lit("title"))
    return art.skip_header(v.articles.unionByName(header)).select("doc_id", "title")


@query("flt2_compact_date_range", f"WITH {NEWS} SELECT doc_id, time_published FROM news WHERE time_published >= '20240108T000000' AND time_published < '20240116T000000'")
def flt2(v: Views):
    return art.published_between(v.articles, "2024-01-08", "2024-01-15").select("doc_id", "time_published")


@query(
    "flt5_news_search",
    f"WITH {MENTIONS} SELECT DISTINCT doc_id, time_published FROM mentions WHERE regexp_matches(ticker, '(?i)t[35]') AND time_published >= '20240108T000000' AND time_published <= '20240116T000000'",
)
def flt5(v: Views):
    return documents.find_news(v.articles, "t[35]", "20240108T000000", "20240116T000000").select("doc_id", "time_published")


@query("flt5_indexed_search", ORACLE["flt5_news_search"])
def flt5_indexed(v: Views):
    """The same search in a store whose dictionary, postings and days tell what to open."""
    path = work_dir(v.spark, "news-index")
    news_index.write_index(v.articles, path)
    return news_index.search(v.spark, path, "t[35]", "20240108T000000", "20240116T000000").select("doc_id", "time_published")


@query("src5_collection_filters", f"WITH {NEWS} SELECT message_id, time_published, source FROM news WHERE title <> 'title' AND time_published >= '20240105T000000' AND time_published < '20240121T000000'")
def src5(v: Views):
    docs = art.published_between(art.skip_header(v.articles), "2024-01-05", "2024-01-20")
    return docs.select("message_id", "time_published", "source")


# Joins and aggregates ---------------------------------------------------------------------

@query("joi1_news_mapping_join", f"WITH {MENTIONS} SELECT message_id, CAST(i AS INTEGER) AS i, ticker, score AS ticker_sentiment_score, overall_score AS overall_sentiment_score, published_s FROM mentions")
def joi1(v: Views):
    return v.mapping.select(
        "message_id", "i", "ticker", "ticker_sentiment_score", "overall_sentiment_score", F.unix_seconds("time_published").alias("published_s")
    )


@query("agg1_daily_ticker_sentiment", f"WITH {MENTIONS} {DAILY_SENTIMENT_SELECT} FROM mentions GROUP BY ALL")
def agg1(v: Views):
    return art.daily_ticker_sentiment(v.mapping)


@query(
    "agg2_label_distribution",
    f"WITH {MENTIONS} SELECT label AS ticker_sentiment_label, count(*) AS mentions, {r('avg(score)', 6)} AS avg_score FROM mentions WHERE ticker = 'T3' AND published_at >= {_LATEST} - INTERVAL 7 DAYS GROUP BY label",
)
def agg2(v: Views):
    return art.label_distribution(v.mapping, "T3", _as_of(v))


@query(
    "agg3_most_mentioned",
    f"WITH {MENTIONS} SELECT ticker, count(*) AS mention_count, {r('avg(score)', 6)} AS avg_sentiment, count(*) FILTER (label = 'Bullish') AS bullish, count(*) FILTER (label = 'Bearish') AS bearish FROM mentions WHERE published_at >= {_LATEST} - INTERVAL 24 HOURS GROUP BY ticker ORDER BY mention_count DESC, ticker LIMIT 20",
)
def agg3(v: Views):
    return art.most_mentioned(v.mapping, _as_of(v))


@query(
    "agg4_daily_summary",
    f"WITH {MENTIONS}, a AS ({DAILY_SENTIMENT_SELECT} FROM mentions GROUP BY ALL) SELECT ticker, date, news_count, avg_sentiment_score, bullish_count, bearish_count, neutral_count, {r('CAST(bullish_count AS DOUBLE) / nullif(news_count, 0) * 100', 6)} AS bullish_pct "
    f"FROM a WHERE ticker = 'T3' AND date >= CAST({_LATEST} - INTERVAL 30 DAYS AS DATE)",
)
def agg4(v: Views):
    return art.daily_summary(art.daily_ticker_sentiment(v.mapping), "T3", _as_of(v))


def _share(cond: str) -> str:
    return r(f"CAST(count(*) FILTER ({cond}) AS DOUBLE) / count(*)", 2)


@query(
    "agg5_ticker_report",
    f"WITH {MENTIONS} SELECT ticker, (SELECT count(*) FROM news) AS news_count, {r('avg(score)', 4)} AS avg_sentiment, {r('avg(relevance)', 4)} AS avg_relevance, {r('avg(weighted)', 4)} AS avg_weighted_sentiment, {r('stddev_pop(score)', 4)} AS sentiment_volatility, "
    f"count(*) FILTER (score > 0.15) AS positive_count, count(*) FILTER (score < -0.15) AS negative_count, count(*) FILTER (score BETWEEN -0.15 AND 0.15) AS neutral_count, {_share('score > 0.15')} AS positive_ratio, {_share('score < -0.15')} AS negative_ratio, {_share('score BETWEEN -0.15 AND 0.15')} AS neutral_ratio, "
    f"(SELECT min(time_published) FROM news) AS window_start, (SELECT max(time_published) FROM news) AS window_end FROM unique_mentions GROUP BY ticker",
)
def agg5(v: Views):
    whole = v.articles.agg(F.struct(
        F.count(F.lit(1)).alias("items"), F.min("time_published").alias("start"), F.max("time_published").alias("end"))).scalar()
    return art.ticker_sentiment_report(v.unique_mentions, whole["items"], whole["start"], whole["end"])


@query(
    "agg6_sentiment_accumulator",
    f"WITH {MENTIONS}, per AS (SELECT doc_id, source, overall_score, {r('sum(relevance)', 2)} AS rel FROM mentions GROUP BY doc_id, source, overall_score) SELECT source, count(*) AS news_count, {r('sum(overall_score) / count(*)', 4)} AS avg_sentiment, {r('sum(rel)', 2)} AS total_relevance, "
    f"{_share('overall_score > 0.15')} AS positive_ratio, {_share('overall_score < -0.15')} AS negative_ratio, {_share('overall_score BETWEEN -0.15 AND 0.15')} AS neutral_ratio FROM per GROUP BY source",
)
def agg6(v: Views):
    return art.sentiment_accumulation(art.enrich_news(v.articles), "source")


@query(
    "agg6_stored_partials",
    f"WITH {MENTIONS}, per AS (SELECT doc_id, source, overall_score, {r('sum(relevance)', 2)} AS rel FROM mentions WHERE published_s >= 1704412800 AND published_s < 1705708800 GROUP BY doc_id, source, overall_score) SELECT source, count(*) AS news_count, {r('sum(overall_score) / count(*)', 4)} AS avg_sentiment, {r('sum(rel)', 2)} AS total_relevance, "
    f"{_share('overall_score > 0.15')} AS positive_ratio, {_share('overall_score < -0.15')} AS negative_ratio, {_share('overall_score BETWEEN -0.15 AND 0.15')} AS neutral_ratio FROM per GROUP BY source",
)
def agg6_partials(v: Views):
    """Partials of every day are stored, the first half of the days twice; a range of days is answered from them alone."""
    path, day = work_dir(v.spark, "partials"), F.to_date("published_at").alias("day")
    enriched = art.enrich_news(v.articles)
    for rows in (enriched.filter(F.col("published_at") < F.lit("2024-01-15").cast("timestamp")), enriched):
        lake_sink.write_lake(art.sentiment_partials(rows, "source", day), path, ("day",), "overwrite")
    d = F.col("day")
    days = v.spark.read.parquet(path).filter((d >= F.lit("2024-01-05").cast("date")) & (d < F.lit("2024-01-20").cast("date")))
    return art.merged_sentiment(days, "source")


@query(
    "agg10_null_profile",
    f"WITH {COMPANIES} SELECT count(*) FILTER (name IS NULL) AS name_nulls, count(*) FILTER (cik IS NULL) AS cik_nulls, count(*) AS composite_figi_nulls, count(*) FILTER (industry IS NULL) AS sic_description_nulls FROM companies",
)
def agg10(v: Views):
    return documents.null_profile(v.companies.select("name", "cik", "composite_figi", "sic_description"))


@query("agg14_success_rate", "SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS errors, " + r("count(*) FILTER (event_type <> 'error') * 100.0 / count(*)", 6) + " AS success_rate FROM events")
def agg14(v: Views):
    return v.table("events").agg(*documents.success_rate(F.col("event_type") != "error")).withColumn("success_rate", half_up(F.col("success_rate"), 6))


@query("agg15_output_counts", f"WITH {MENTIONS} SELECT 'news' AS output, (SELECT count(*) FROM news) AS rows UNION ALL SELECT 'mentions', (SELECT count(*) FROM mentions) UNION ALL SELECT 'ticks', (SELECT count(*) FROM events)")
def agg15(v: Views):
    return documents.output_counts({"news": v.news_table, "mentions": v.mapping_table, "ticks": v.ticks})


_TOUCHED = f"SELECT DISTINCT CAST(published_at AS DATE) FROM news WHERE published_at >= {_LATEST} - INTERVAL 3 DAYS"


@query("agg16_touched_dates", f"WITH {MENTIONS} {DAILY_SENTIMENT_SELECT} FROM mentions WHERE CAST(published_at AS DATE) IN ({_TOUCHED}) GROUP BY ALL")
def agg16(v: Views):
    batch = v.news_table.filter(F.col("time_published") >= _as_of(v) - F.expr("INTERVAL 3 DAYS"))
    return art.recompute_dates(batch, v.mapping)


@query(
    "agg17_batch_rate",
    f"WITH {NEWS} SELECT CAST(published_at AS DATE) AS batch, count(*) AS messages, max(published_s) - min(published_s) AS elapsed_s, {r('count(*) / nullif(CAST(max(published_s) - min(published_s) AS DOUBLE), 0)', 6)} AS messages_per_s FROM news GROUP BY ALL",
)
def agg17(v: Views):
    return quality.batch_rate(v.articles.withColumn("batch", F.to_date("published_at")), "batch", "published_s")


# Windows ----------------------------------------------------------------------------------

_H = "(PARTITION BY ticker ORDER BY published_s, doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "win12_sentiment_anomaly",
    f"WITH {MENTIONS}, h AS (SELECT ticker, doc_id, CAST(i AS INTEGER) AS i, score, count(*) OVER {_H} AS n, avg(score) OVER {_H} AS mean, stddev_pop(score) OVER {_H} AS sd, min(score) OVER {_H} AS lo, max(score) OVER {_H} AS hi FROM (SELECT ticker, doc_id, i, published_s, score FROM mentions UNION ALL SELECT 'FLAT', doc_id, i, published_s, 0.25 FROM mentions WHERE i = 0) m), "
    f"k AS (SELECT *, n < 10 AS short, n >= 10 AND lo = hi AS flat, CASE WHEN n >= 10 AND lo <> hi THEN abs(score - mean) / sd END AS z FROM h) "
    f"SELECT ticker, doc_id, i, score, coalesce(z > 2, FALSE) AS is_anomaly, CASE WHEN short THEN 'insufficient_history' WHEN flat THEN 'no_variance' END AS reason, {r('z', 2)} AS z_score, "
    f"CASE WHEN z IS NOT NULL THEN {r('mean', 4)} END AS avg_sentiment, CASE WHEN z IS NOT NULL THEN {r('sd', 4)} END AS std_dev, CASE WHEN z IS NOT NULL THEN CASE WHEN score > mean THEN 'spike' ELSE 'drop' END END AS direction FROM k",
)
def win12(v: Views):
    """The mentions, and a series that never moves."""
    m = v.mentions.select("ticker", "doc_id", "i", "published_s", F.col("sentiment_score").alias("score"))
    flat = m.filter("i = 0").withColumns({"ticker": F.lit("FLAT"), "score": F.lit(0.25)})
    hour = F.floor(F.col("published_s") / F.lit(3_600))
    rows = m.unionByName(flat)
    return indicators.sentiment_anomalies(rows, "ticker", ["published_s", "doc_id", "i"], "score", hour).drop("published_s")


# Ranking ----------------------------------------------------------------------------------

@query(
    "top1_latest_news",
    f"WITH {MENTIONS} SELECT message_id, title, published_s, source AS source_name, overall_score AS overall_sentiment_score, score AS ticker_sentiment_score, label AS ticker_sentiment_label, url FROM mentions WHERE ticker = 'T3' ORDER BY published_s DESC, message_id, i LIMIT 10",
)
def top1(v: Views):
    return art.latest_for_ticker(v.mapping, "T3").select(
        "message_id", "title", F.unix_seconds("time_published").alias("published_s"), "source_name", "overall_sentiment_score",
        "ticker_sentiment_score", "ticker_sentiment_label", "url",
    )


@query(
    "top2_top_by_volume_today",
    f"WITH {MENTIONS}, a AS ({DAILY_SENTIMENT_SELECT} FROM mentions GROUP BY ALL) SELECT ticker, news_count, avg_sentiment_score, bullish_count, bearish_count FROM a WHERE date = CAST({_LATEST} AS DATE) ORDER BY news_count DESC, ticker LIMIT 10",
)
def top2(v: Views):
    today = v.mapping.filter(F.to_date("time_published") == F.to_date(_as_of(v)))
    return (
        art.daily_ticker_sentiment(today)
        .select("ticker", "news_count", "avg_sentiment_score", "bullish_count", "bearish_count")
        .orderBy(F.desc("news_count"), "ticker").limit(10)
    )


@query("top5_primary_ticker", f"WITH {MENTIONS} SELECT doc_id, ticker AS primary_ticker, 'UNKNOWN' AS of_nothing FROM mentions WHERE i = 0")
def top5(v: Views):
    none = F.array().cast(nf.TICKER_SENTIMENT_DDL)
    return v.articles.select("doc_id", nf.primary_ticker(F.col("ticker_sentiment")).alias("primary_ticker"), nf.primary_ticker(none).alias("of_nothing"))


@query("top8_label_counts", f"WITH {MENTIONS} SELECT label AS ticker_sentiment_label, count(*) AS mentions FROM mentions GROUP BY label ORDER BY mentions DESC, label")
def top8(v: Views):
    return (
        v.mapping_table.groupBy("ticker_sentiment_label").agg(F.count(F.lit(1)).alias("mentions"))
        .orderBy(F.desc("mentions"), "ticker_sentiment_label")
    )


# Sets -------------------------------------------------------------------------------------

@query("set3_distinct_topics", f"WITH {NEWS} SELECT lang AS topic FROM news UNION SELECT source FROM news")
def set3(v: Views):
    return art.topics_from_json(v.lake_news).select("topic").distinct()


@query("set4_dedupe_on_key", f"WITH {MENTIONS} SELECT ticker, label, min(doc_id) AS doc_id FROM mentions GROUP BY ticker, label")
def set4(v: Views):
    m = v.mentions.withColumn("key", text.surrogate_key(F.col("ticker"), F.col("sentiment_label")))
    kept = ranking.last_per_key(m, ["key"], [F.asc("doc_id"), F.asc("i")])
    return kept.select("ticker", F.col("sentiment_label").alias("label"), "doc_id")


@query("flt9_latest_snapshot", f"WITH {COMPANIES} SELECT _id, ticker, time_update FROM companies WHERE time_update = (SELECT max(time_update) FROM companies)")
def flt9(v: Views):
    return joins.latest_snapshot(v.companies).select("_id", "ticker", "time_update")
