"""Queries over merges, dimensions, the relational split and the batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up
from tapeloom.operators import articles as art
from tapeloom.operators import candles, documents, joins, merge, ranking
from tapeloom.plans import candles_job, companies_job, export_job, news_job
from tapeloom.queries.registry import query
from tapeloom.session import work_dir
from tapeloom.sinks import lake as lake_sink
from tapeloom.views import (
    BARS, BATCH_END, BATCH_START, COMPANIES, DAILY, DAILY_SENTIMENT_SELECT, EXCHANGES, MENTIONS, NEWS, Views, r,
)

_LOADED = "DATE '2024-01-16'"  # what the targets of the merge queries already hold ends here


def _loaded(column: str):
    return F.to_date(column) < F.lit("2024-01-16").cast("date")


# Projections and splits -------------------------------------------------------------------

@query("prj4_company_dimension", f"WITH {COMPANIES} SELECT name AS company_name, ticker AS company_ticker, 'stocks' AS company_security_type, 'Unknown' AS company_composite_figi, CAST(size AS VARCHAR) AS company_cik, industry AS company_industry_name, CAST(size AS VARCHAR) AS company_sic FROM companies WHERE time_update = 2")
def prj4(v: Views):
    return documents.company_dimension(v.lake_companies).drop("company_id")


@query(
    "prj10_snapshot_documents",
    f"WITH {COMPANIES} SELECT concat(ticker, '_1706572800') AS _id, ticker AS name, CAST(1706572800 AS BIGINT) AS time_update FROM companies WHERE time_update = 2 UNION ALL SELECT concat(r_name, '_1706572800'), r_name, 1706572800 FROM region",
)
def prj10(v: Views):
    at = F.lit(1706572800)
    c = documents.company_documents(v.companies.filter("time_update = 2"), at)
    m = documents.market_documents(v.markets, at)
    return c.select("_id", F.col("ticker").alias("name"), "time_update").unionByName(
        m.select("_id", F.col("region").alias("name"), "time_update")
    )


@query(
    "prj11_company_relations",
    f"WITH {COMPANIES} SELECT ticker AS company_ticker, cik AS company_cik, name AS company_name, CAST(size AS VARCHAR) AS company_sic_code, industry AS company_industry, primary_exchange AS company_status_primary_exchange, CAST(time_update AS INTEGER) AS company_status_time_update FROM companies",
)
def prj11(v: Views):
    s = documents.split_companies(v.companies)
    companies = s["companies"].select("company_ticker", "company_cik", "company_name", "company_sic_code", "company_industry")
    status = s["company_status"].withColumn("cik_known", F.col("company_status_time_update") == 2)
    same = (companies.company_ticker == status.company_status_ticker) & (companies.company_cik.isNotNull() == status.cik_known)
    return companies.join(status, same).select(
        *companies.columns, "company_status_primary_exchange", "company_status_time_update"
    )


@query("prj12_market_relations", f"WITH {EXCHANGES} SELECT exchange_region, exchange_name, exchange_mic, 'Equity' AS market_type, CASE WHEN r_regionkey > 1 THEN 'open' ELSE 'closed' END AS market_status_current_status FROM exchanges JOIN region ON r_name = exchange_region")
def prj12(v: Views):
    s = documents.split_markets(v.markets)
    return (
        s["exchanges"].join(s["markets"], F.col("exchange_region") == F.col("market_region"))
        .join(s["market_status"], F.col("exchange_region") == F.col("market_status_region"))
        .select("exchange_region", "exchange_name", "exchange_mic", "market_type", "market_status_current_status")
    )


@query("prj14_clamp", f"WITH {NEWS} SELECT doc_id, least(published_s, 1705363200) AS time_update, published_s > 1705363200 AS was_clamped FROM news")
def prj14(v: Views):
    return merge.clamp(v.articles.select("doc_id", F.col("published_s").alias("time_update")), "time_update", 1705363200)


@query("flt3_find_companies", f"WITH {COMPANIES} SELECT _id, ticker, primary_exchange, time_update FROM companies WHERE primary_exchange = 'XYZ' OR (ticker = 'Brand#7' AND time_update >= 1 AND time_update <= 2)")
def flt3(v: Views):
    found = documents.find_companies(v.companies, "Brand#7", None, 1, 2)
    none = documents.find_companies(v.companies, exchange="XYZ")
    return found.unionByName(none).select("_id", "ticker", "primary_exchange", "time_update")


@query("flt6_drop_null_keys", f"WITH {COMPANIES} SELECT _id, cik FROM companies WHERE cik IS NOT NULL")
def flt6(v: Views):
    return v.companies.select("_id", "cik").na.drop(subset=["cik"])


# Joins and merges -------------------------------------------------------------------------

@query("joi2_key_lookup", f"WITH {MENTIONS} SELECT doc_id AS news_id, ticker, relevance, score FROM mentions WHERE published_at < {_LOADED}")
def joi2(v: Views):
    """Mentions of the whole batch get their article's id; articles not stored are skipped."""
    stored = v.news_table.filter(_loaded("time_published")).select("id", "message_id")
    return v.mentions.join(stored, "message_id").select(
        F.col("id").alias("news_id"), "ticker", "relevance", F.col("sentiment_score").alias("score")
    )


@query(
    "joi3_insert_if_absent",
    "SELECT d AS time_date, CASE WHEN bool_or(old) THEN 'existing' ELSE 'staged' END AS origin FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, TRUE AS old FROM lineitem UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), FALSE FROM orders) q GROUP BY d",
)
def joi3(v: Views):
    def dim(table: str, column: str, origin: str):
        d = v.table(table).select(F.col(column).cast("date").alias("ingest_date"))
        return news_job.time_dimension(d).withColumn("origin", F.lit(origin))

    merged = merge.insert_if_absent(dim("lineitem", "l_shipdate", "existing"), dim("orders", "o_orderdate", "staged"), ["time_id"])
    return merged.select("time_date", "origin")


@query(
    "joi4_upsert",
    f"WITH {MENTIONS}, a AS ({DAILY_SENTIMENT_SELECT} FROM mentions GROUP BY ALL) SELECT ticker, date, CASE WHEN date >= DATE '2024-01-11' THEN news_count ELSE news_count + 1000 END AS news_count, avg_sentiment_score, CASE WHEN date < {_LOADED} THEN 'first load' ELSE 'second load' END AS created FROM a",
)
def joi4(v: Views):
    """Days from the 11th are loaded again over a target that ends on the 15th and counts wrongly."""
    daily = art.daily_ticker_sentiment(v.mapping).select("ticker", "date", "news_count", "avg_sentiment_score")
    target = daily.filter(_loaded("date")).withColumn("news_count", F.col("news_count") + 1000).withColumn("created", F.lit("first load"))
    source = daily.filter(F.col("date") >= F.lit("2024-01-11").cast("date")).withColumn("created", F.lit("second load"))
    return merge.upsert(target, source, ["ticker", "date"], keep=["created"])


@query(
    "joi5_new_keys_only",
    "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') GROUP BY o_custkey",
)
def joi5(v: Views):
    orders = v.table("orders")
    known = orders.filter(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).select("o_custkey")
    new = merge.new_rows(orders.select("o_custkey", "o_orderkey"), known.distinct(), ["o_custkey"], [F.asc("o_orderkey")])
    return new.withColumnRenamed("o_orderkey", "first_order")


_FKS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"),
]


@query(
    "joi6_orphan_check",
    " UNION ALL ".join(
        f"SELECT '{c}.{fk}' AS foreign_key, count(DISTINCT {fk}) AS orphan_keys, count(*) AS orphan_rows FROM {c} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p})"
        for c, fk, p, pk in _FKS
    ),
)
def joi6(v: Views):
    """Not every document is labelled: the last of the keys has orphans."""
    tables = {t: v.table(t) for c, _, p, _ in _FKS for t in (c, p)}
    return joins.orphan_report([(f"{c}.{fk}", tables[c], fk, tables[p], pk) for c, fk, p, pk in _FKS])


@query(
    "joi7_star_join",
    f"WITH {DAILY}, {COMPANIES} SELECT industry AS company_industry_name, CAST(year(d) AS INTEGER) AS time_year, CAST(quarter(d) AS INTEGER) AS time_quarter, count(*) AS candles, sum(daily.v) AS volume, count(*) FILTER (c > o) AS bullish FROM daily JOIN companies USING (ticker) WHERE time_update = 2 GROUP BY ALL",
)
def joi7(v: Views):
    lake = v.daily.withColumn("vw", F.lit(None).cast("double")).withColumnRenamed("d", "ingest_date")
    star = candles_job.star(
        candles.candle_facts(lake).drop("ingest_date"), documents.company_dimension(v.lake_companies), news_job.time_dimension(lake)
    )
    return star.groupBy("company_industry_name", "time_year", "time_quarter").agg(
        F.count(F.lit(1)).alias("candles"), F.sum("candle_volume").alias("volume"),
        F.count_if("candle_is_bullish").alias("bullish"),
    )


@query("joi10_exchange_codes", f"WITH {EXCHANGES} SELECT exchange_name, exchange_mic, CAST(NULL AS VARCHAR) AS unknown FROM exchanges")
def joi10(v: Views):
    s = documents.split_markets(v.markets)["exchanges"]
    return s.select("exchange_name", "exchange_mic", joins.exchange_mic(F.col("exchange_region")).alias("unknown"))


@query("joi11_universe", f"WITH {DAILY}, {COMPANIES} SELECT ticker, d, {r('c', 4)} AS c FROM daily WHERE ticker IN (SELECT ticker FROM companies WHERE time_update = 2)")
def joi11(v: Views):
    bars = v.daily.select("ticker", "d", half_up(F.col("c"), 4).alias("c"))
    return joins.in_latest_snapshot(bars, v.companies)


@query("set2_concat", "SELECT kind, count(*) AS rows FROM (SELECT 'order' AS kind, o_orderdate AS at FROM orders UNION ALL SELECT 'ship', l_shipdate FROM lineitem) q GROUP BY kind")
def set2(v: Views):
    orders = v.table("orders").select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"))
    ships = v.table("lineitem").select(F.col("l_shipdate").alias("at"), F.lit("ship").alias("kind"))
    return orders.unionByName(ships).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


@query("set5_first_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) q WHERE rn = 1")
def set5(v: Views):
    first = ranking.last_per_key(v.table("orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("set6_difference", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set6(v: Views):
    documents = v.table("documents").select("doc_id", "lang")
    return merge.new_rows(documents, v.table("labels").select("doc_id").distinct(), ["doc_id"])


@query("set7_unique_insert", f"WITH {NEWS} SELECT message_id, title FROM news WHERE published_at >= {_LOADED}")
def set7(v: Views):
    """The batch holds every article twice; only those not stored yet go in, once."""
    rows = v.news_table.select("message_id", "title", "time_published")
    stored = rows.filter(_loaded("time_published"))
    return merge.new_rows(rows.unionAll(rows), stored, ["message_id"], [F.asc("time_published")]).select("message_id", "title")


@query("snk6_set_fields", "SELECT CAST(d.doc_id AS VARCHAR) AS _id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snk6(v: Views):
    """Quality and toxicity arrive as separate partial updates of the documents."""
    blank = F.lit(None).cast("int")
    docs = v.table("documents").select(F.col("doc_id").cast("string").alias("_id"), "source", blank.alias("quality"), blank.alias("toxic"))
    labels = v.table("labels").select(F.col("doc_id").cast("string").alias("_id"), "quality", "toxic")
    updates = labels.select("_id", "quality", blank.alias("toxic"), F.lit(1).alias("seq")).unionByName(
        labels.select("_id", blank.alias("quality"), "toxic", F.lit(2).alias("seq"))
    )
    return merge.set_fields(docs, updates, "_id", [F.col("seq")])


# Jobs -------------------------------------------------------------------------------------

@query(
    "job1_candles",
    f"WITH {BARS} SELECT ticker, ingest_date, t, {r('h - greatest(o, c)', 4)} AS candle_upper_wick, CAST(dayofweek(ingest_date) + 1 AS INTEGER) AS time_day_of_week, CAST(quarter(ingest_date) AS INTEGER) AS time_quarter "
    f"FROM (SELECT ticker, ingest_date, CAST(0 AS BIGINT) AS t, o, h, c FROM bars) b WHERE ingest_date >= DATE '{BATCH_START}' AND ingest_date < DATE '2024-01-17'",
)
def job1(v: Views):
    """Two overlapping weekly runs load every bar once."""
    lake, wh = work_dir(v.spark, "lake-ohlc"), work_dir(v.spark, "warehouse")
    lake_sink.write_lake(v.lake_bars, lake)
    candles_job.run(v.spark, lake, wh, BATCH_START, BATCH_END)
    candles_job.run(v.spark, lake, wh, "2024-01-10", "2024-01-17")
    facts, time = v.spark.read.parquet(f"{wh}/fact_candles"), v.spark.read.parquet(f"{wh}/dim_time")
    return facts.join(time, F.col("candle_time_id") == F.col("time_id")).select(
        "ticker", "ingest_date", F.lit(0).cast("long").alias("t"), half_up(F.col("candle_upper_wick"), 4).alias("candle_upper_wick"),
        "time_day_of_week", "time_quarter",
    )


@query(
    "job2_news",
    f"WITH {MENTIONS}, w AS (SELECT * FROM mentions WHERE published_at >= TIMESTAMP '{BATCH_START}' AND published_at < TIMESTAMP '2024-01-17'), t AS (SELECT DISTINCT doc_id, lang, source, published_at FROM w) "
    "SELECT 'dim_news' AS table_name, count(DISTINCT doc_id) AS rows FROM w UNION ALL SELECT 'fact_news_companies', count(*) FROM w UNION ALL SELECT 'fact_news_topic', 2 * count(DISTINCT doc_id) FROM w "
    "UNION ALL SELECT 'dim_time', count(DISTINCT CAST(published_at AS DATE)) FROM w UNION ALL SELECT 'dim_topics', (SELECT count(*) FROM (SELECT lang FROM t UNION SELECT source FROM t) u)",
)
def job2(v: Views):
    lake, wh = work_dir(v.spark, "lake-news"), work_dir(v.spark, "warehouse")
    lake_sink.write_lake(v.lake_news, lake)
    news_job.run(v.spark, lake, wh, BATCH_START, BATCH_END)
    news_job.run(v.spark, lake, wh, "2024-01-10", "2024-01-17")
    names = ("dim_news", "fact_news_companies", "fact_news_topic", "dim_time", "dim_topics")
    counts = documents.output_counts({n: v.spark.read.parquet(f"{wh}/{n}") for n in names})
    return counts.withColumnRenamed("output", "table_name")


@query(
    "job3_companies",
    f"WITH {COMPANIES} SELECT CAST(0 AS BIGINT) AS company_name_nulls, CAST(0 AS BIGINT) AS company_cik_nulls, CAST(0 AS BIGINT) AS company_composite_figi_nulls, count(*) AS companies FROM companies WHERE time_update = 2",
)
def job3(v: Views):
    lake, wh = work_dir(v.spark, "lake-companies"), work_dir(v.spark, "warehouse")
    v.lake_companies.write.parquet(lake)
    profile = companies_job.run(v.spark, lake, wh)
    n = v.spark.read.parquet(f"{wh}/dim_companies").agg(F.count(F.lit(1))).scalar()
    return profile.select("company_name_nulls", "company_cik_nulls", "company_composite_figi_nulls", n.alias("companies"))


@query("job4_land_bars", f"WITH {BARS} SELECT ticker, t, o, h, l, c, v, ingest_date FROM bars")
def job4(v: Views):
    lake = work_dir(v.spark, "landing")
    landed = v.bars.withColumn("timestamp", F.timestamp_millis("t"))
    export_job.land_bars(landed, lake)
    export_job.land_bars(landed, lake)
    return v.spark.read.parquet(lake).select("ticker", "t", *"ohlcv", "ingest_date")


@query(
    "job5_relational_load",
    f"WITH {COMPANIES} SELECT 'companies' AS output, count(DISTINCT ticker) AS rows FROM companies UNION ALL SELECT 'company_status', count(*) FROM companies UNION ALL SELECT 'exchanges', (SELECT count(*) FROM nation) UNION ALL SELECT 'market_status', (SELECT count(*) FROM region) UNION ALL SELECT 'markets', (SELECT count(*) FROM region)",
)
def job5(v: Views):
    return documents.output_counts(companies_job.relational_batch(v.companies, v.markets))


@query(
    "job5_foreign_keys",
    f"WITH {COMPANIES}, {EXCHANGES} SELECT 'company_status.company_status_ticker' AS foreign_key, CAST(0 AS BIGINT) AS orphan_keys, CAST(0 AS BIGINT) AS orphan_rows "
    "UNION ALL SELECT 'company_status.company_status_primary_exchange', (SELECT count(DISTINCT primary_exchange) FROM companies WHERE primary_exchange NOT IN (SELECT exchange_mic FROM exchanges)), (SELECT count(*) FROM companies WHERE primary_exchange NOT IN (SELECT exchange_mic FROM exchanges)) "
    "UNION ALL SELECT 'exchanges.exchange_region', 0, 0 UNION ALL SELECT 'market_status.market_status_region', 0, 0",
)
def job5_keys(v: Views):
    return companies_job.violations(companies_job.relational_batch(v.companies, v.markets))


@query(
    "job6_export_all",
    f"WITH {MENTIONS}, {BARS} SELECT 'ohlc' AS output, count(*) AS rows FROM bars WHERE t >= epoch_ms(TIMESTAMP '2024-01-11') AND t <= epoch_ms(TIMESTAMP '2024-01-21') UNION ALL SELECT 'news_sentiment', count(*) FROM news WHERE published_at >= TIMESTAMP '2024-01-11' AND published_at <= TIMESTAMP '2024-01-21'",
)
def job6(v: Views):
    out = work_dir(v.spark, "export")
    bars = candles.enrich_bars(v.bars, now=F.timestamp_millis("t"))
    news = art.enrich_news(v.articles, now=F.col("published_at"))
    export_job.export_all(bars, news, out, "2024-01-21", 10)
    return documents.output_counts({n: v.spark.read.parquet(f"{out}/{n}") for n in ("ohlc", "news_sentiment")})
