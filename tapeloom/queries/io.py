"""Queries over sources and sinks: written to the working folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions.rounding import half_up
from tapeloom.functions.text import is_malformed
from tapeloom.operators import articles as art
from tapeloom.operators import candles, documents
from tapeloom.queries.registry import query
from tapeloom.session import work_dir
from tapeloom.sinks import lake as lake_sink
from tapeloom.sinks import snapshots, tables
from tapeloom.sources import readers
from tapeloom.views import BARS, COMPANIES, EXCHANGES, NEWS, Views, r


@query("src2_fixed_schema", "SELECT p_brand, p_name, CAST(NULL AS VARCHAR) AS p_sector FROM part")
def src2(v: Views):
    return readers.parquet_as(v.spark, f"{v.folder}/part.parquet", schemas._struct(p_brand=schemas.S, p_name=schemas.S, p_sector=schemas.S))


@query("src6_relational_extract", f"WITH {COMPANIES} SELECT name AS company_name, ticker AS company_ticker, 'stocks' AS company_asset_type, CAST(NULL AS VARCHAR) AS company_composite_figi, cik AS company_cik, industry AS company_industry, CAST(size AS VARCHAR) AS company_sic_code FROM companies WHERE time_update = 2")
def src6(v: Views):
    path = work_dir(v.spark, "companies")
    readers.company_extract(documents.split_companies(v.companies.filter("time_update = 2"))["companies"]).write.parquet(path)
    return readers.parquet_as(v.spark, path, schemas.COMPANY_LAKE)


@query(
    "src7_csv_tables",
    f"WITH {COMPANIES}, {EXCHANGES} SELECT ticker AS key, primary_exchange AS ref, CAST(time_update AS INTEGER) AS at FROM companies UNION ALL SELECT exchange_mic, exchange_region, NULL FROM exchanges",
)
def src7(v: Views):
    out = work_dir(v.spark, "csv")
    split = {**documents.split_companies(v.companies), **documents.split_markets(v.markets)}
    for name, df in split.items():
        tables.csv_sink(f"{out}/{name}")(df.select(*schemas.RELATIONAL_COLUMNS[name]))
    status = readers.csv_table(v.spark, f"{out}/company_status", "company_status").select(
        F.col("company_status_ticker").alias("key"), F.col("company_status_primary_exchange").alias("ref"),
        F.col("company_status_time_update").alias("at"),
    )
    exchanges = readers.csv_table(v.spark, f"{out}/exchanges", "exchanges").select(
        F.col("exchange_mic").alias("key"), F.col("exchange_region").alias("ref"), F.lit(None).cast("int").alias("at")
    )
    return status.unionByName(exchanges)


@query("src8_json_array_files", "SELECT r_name AS region, n_name AS name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def src8(v: Views):
    """One array file per region, as long as the region has nations."""
    path = work_dir(v.spark, "arrays")
    nations = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    doc = F.struct(F.col("r_name").alias("region"), F.col("n_name").alias("name"), "n_nationkey")
    arrays = nations.groupBy("r_name").agg(F.to_json(F.collect_list(doc), {"pretty": "true"}).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_array(v.spark, path, schemas._struct(region=schemas.S, name=schemas.S, n_nationkey=schemas.I))


@query("src9_read_export", f"WITH {BARS} SELECT ticker, t, c FROM bars WHERE ingest_date = DATE '2024-01-10'")
def src9(v: Views):
    base = work_dir(v.spark, "export")
    lake_sink.write_lake(v.lake_bars.withColumnRenamed("ingest_date", "date"), f"{base}/ohlc", ("date",))
    nothing = readers.exported(v.spark, base, "absent", schema=v.bars.select("ticker", "t", "c").schema)
    one_day = readers.exported(v.spark, base, "ohlc", {"date": "2024-01-10"}).select("ticker", "t", "c")
    return one_day.unionByName(nothing)


@query("src10_json_files", f"WITH {BARS} SELECT ticker, t, o, h, l, c, v FROM bars")
def src10(v: Views):
    base = work_dir(v.spark, "json")
    docs = candles.bar_documents(v.bars, F.lit(1706572800))
    docs.withColumn("part", F.col("ticker")).write.partitionBy("part").json(base)
    found = readers.json_files(v.spark, [f"{base}/part=*", f"{base}/gone"], schemas.OHLC)
    return found.select("ticker", "t", *"ohlcv")


# Sinks ------------------------------------------------------------------------------------

@query("snk1_table_sink", f"WITH {BARS} SELECT mode, count(*) AS rows FROM (SELECT 'append' AS mode FROM bars UNION ALL SELECT 'append' FROM bars UNION ALL SELECT 'overwrite' FROM bars) q GROUP BY mode")
def snk1(v: Views):
    base = work_dir(v.spark, "tables")
    for mode in ("append", "overwrite"):
        sink = tables.parquet_sink(f"{base}/{mode}", mode)
        sink(v.bars)
        sink(v.bars)
    counts = documents.output_counts({m: v.spark.read.parquet(f"{base}/{m}") for m in ("append", "overwrite")})
    return counts.withColumnRenamed("output", "mode")


@query("snk2_lake_sink", f"WITH {NEWS} SELECT CAST(published_at AS DATE) AS ingest_date, count(*) AS articles, CAST(sum(length(summary)) AS BIGINT) AS chars FROM news GROUP BY ALL")
def snk2(v: Views):
    path = work_dir(v.spark, "lake-news")
    dated, _ = lake_sink.dead_letters(v.lake_news)
    lake_sink.write_lake(dated, path)
    return v.spark.read.parquet(path).groupBy("ingest_date").agg(
        F.count(F.lit(1)).alias("articles"), F.sum(F.length("summary")).alias("chars")
    )


def _granularity(g: str, cols: str) -> str:
    return f"SELECT '{g}' AS granularity, {cols} AS part, count(*) AS rows FROM days GROUP BY ALL"


@query(
    "snk3_partitioned_export",
    f"WITH {BARS}, days AS (SELECT ingest_date AS d FROM bars) "
    + _granularity("day", "CAST(d AS VARCHAR)") + " UNION ALL "
    + _granularity("week", "concat(isoyear(d), '-', week(d))") + " UNION ALL "
    + _granularity("month", "strftime(d, '%Y-%m')"),
)
def snk3(v: Views):
    bars = candles.enrich_bars(v.bars, now=F.timestamp_millis("t"))
    parts = []
    for g, names in lake_sink.EXPORT_PARTITIONS.items():
        out = work_dir(v.spark, f"export-{g}")
        lake_sink.export_bars(bars, out, F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp"), g)
        df = v.spark.read.option("recursiveFileLookup", False).parquet(f"{out}/ohlc")
        text = [F.date_format("date", "yyyy-MM-dd")] if g == "day" else [
            F.col("year").cast("string"),
            F.format_string("%02d", F.col("month").cast("int")) if g == "month" else F.col("week").cast("string"),
        ]
        parts.append(
            df.groupBy(F.concat_ws("-", *text).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(g).alias("granularity"), "part", "rows")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snk4_news_export", f"WITH {NEWS} SELECT CAST(published_at AS DATE) AS date, count(*) AS rows, {r('sum(overall_score)', 4)} AS score FROM news WHERE published_at >= TIMESTAMP '2024-01-05' AND published_at <= TIMESTAMP '2024-01-20' GROUP BY ALL")
def snk4(v: Views):
    out = work_dir(v.spark, "export")
    news = art.enrich_news(v.articles, now=F.col("published_at"))
    lake_sink.export_news(news, out, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    df = v.spark.read.parquet(f"{out}/news_sentiment")
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), half_up(F.sum("sentiment_score"), 4).alias("score"))


@query("snk5_compaction", f"WITH {NEWS} SELECT CAST(published_at AS DATE) AS ingest_date, count(*) AS rows, CAST(sum(length(summary)) AS BIGINT) AS chars, CAST(1 AS BIGINT) AS files FROM news GROUP BY ALL")
def snk5(v: Views):
    """Six appends per day become one file per day."""
    path = work_dir(v.spark, "lake-small")
    rows = v.lake_news.select("message_id", "summary", "ingest_date")
    rows.repartition(6, F.xxhash64("message_id")).write.partitionBy("ingest_date").parquet(path)
    lake_sink.compact(v.spark, path, min_files=2)
    df = v.spark.read.parquet(path).withColumn("_file", F.input_file_name())
    return df.groupBy("ingest_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("summary")).alias("chars"), F.count_distinct("_file").alias("files")
    )


@query(
    "snk5_snapshots",
    f"""WITH {NEWS}, days AS (SELECT CAST(published_at AS DATE) AS ingest_date, summary, message_id FROM news), kept AS (SELECT ingest_date, count(*) AS rows, CAST(sum(length(summary)) AS BIGINT) AS chars FROM days GROUP BY ALL)
SELECT 'opened before' AS reader, ingest_date, rows, chars FROM kept UNION ALL SELECT 'opened after', ingest_date, rows, chars FROM kept WHERE ingest_date <> DATE '2024-01-10'
UNION ALL SELECT 'opened after', ingest_date, count(*), CAST(sum(length(summary)) AS BIGINT) FROM days WHERE ingest_date = DATE '2024-01-10' AND CAST(message_id AS BIGINT) % 2 = 0 GROUP BY ALL""",
)
def snk5_snapshots(v: Views):
    """A reader opens a table of four appends; it is compacted, and a day replaced, before that reader reads."""
    path = work_dir(v.spark, "snapshots")
    rows = v.lake_news.select("message_id", "summary", "ingest_date")
    for part in range(4):
        snapshots.append(rows.filter(F.pmod(F.xxhash64("message_id"), F.lit(4)) == part), path)
    before = snapshots.read(v.spark, path)
    snapshots.compact(v.spark, path, min_files=2)
    day = F.col("ingest_date") == F.lit("2024-01-10").cast("date")
    now = snapshots.read(v.spark, path)
    snapshots.overwrite(now.filter(day & (F.col("message_id").cast("long") % 2 == 0)), path)

    def told(df, reader: str):
        n = df.groupBy("ingest_date").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("summary")).alias("chars"))
        return n.select(F.lit(reader).alias("reader"), "*")

    return told(before, "opened before").unionByName(told(snapshots.read(v.spark, path), "opened after"))


@query("snk7_routed_sink", "SELECT CASE event_type WHEN 'view' THEN 'views' WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'sales' END AS collection, count(*) AS rows, " + r("sum(value)", 2) + " AS total FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL")
def snk7(v: Views):
    path = work_dir(v.spark, "routed")
    routes = {"view": "views", "click": "clicks", "purchase": "sales"}
    tables.write_routed(tables.routed(v.table("events"), F.col("event_type"), routes), path)
    return v.spark.read.parquet(path).groupBy("collection").agg(
        F.count(F.lit(1)).alias("rows"), half_up(F.sum("value"), 2).alias("total")
    )


@query("snk7_unknown_types", "SELECT event_type, count(*) AS rows, (SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')) AS counted FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL")
def snk7_unknown(v: Views):
    """Events of types without a collection, set aside, and their number as the sink tells it."""
    path = work_dir(v.spark, "routed")
    routes = {"view": "views", "click": "clicks", "purchase": "sales"}
    rows = tables.routed(v.table("events"), F.col("event_type"), routes)
    counted = tables.write_routed(rows, f"{path}/data", dead_path=f"{path}/dead")
    return v.spark.read.parquet(f"{path}/dead").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(counted).cast("long").alias("counted"))


@query("snk8_keyed_messages", f"WITH {BARS} SELECT ticker AS key, t, c, 'tapeloom' AS source, TRUE AS stamped FROM bars")
def snk8(v: Views):
    path = work_dir(v.spark, "messages")
    tables.keyed_messages(v.bars.select("ticker", "t", "c"), F.col("ticker"), "tapeloom").write.parquet(path)
    body = F.from_json("value", "t BIGINT, c DOUBLE, _kafka_timestamp STRING, _kafka_source STRING")
    return v.spark.read.parquet(path).withColumn("b", body).select(
        "key", "b.t", "b.c", F.col("b._kafka_source").alias("source"), F.col("b._kafka_timestamp").isNotNull().alias("stamped")
    )


@query("snk9_csv_sink", f"WITH {NEWS} SELECT doc_id, title, length(summary) AS chars, overall_score FROM news")
def snk9(v: Views):
    """Whole texts, with their quotes and line breaks, through CSV and back."""
    path = work_dir(v.spark, "csv")
    rows = v.articles.select("doc_id", "title", "summary", F.col("overall_sentiment_score").cast("double").alias("overall_score"))
    tables.csv_sink(path)(rows)
    back = v.spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(rows.schema).csv(path)
    return back.select("doc_id", "title", F.length("summary").cast("long").alias("chars"), "overall_score")


@query("snk11_dead_letters", "SELECT CASE WHEN ok THEN 'valid' ELSE 'dead' END AS output, count(*) AS rows FROM (SELECT TRUE AS ok FROM events UNION ALL SELECT FALSE FROM documents) q GROUP BY ok")
def snk11(v: Views):
    """JSON records and free text on one feed: what does not parse goes to the dead letters."""
    feed = v.table("events").select(F.col("props").alias("value")).unionByName(v.table("documents").select(F.col("text").alias("value")))
    path = work_dir(v.spark, "feed")
    parsed = feed.withColumn("data", F.from_json("value", "k BIGINT"))
    bad = is_malformed(F.col("value"), F.col("data"), "k")
    parsed.withColumn("output", F.when(bad, "dead").otherwise("valid")).write.partitionBy("output").parquet(path)
    return v.spark.read.parquet(path).groupBy("output").agg(F.count(F.lit(1)).alias("rows"))


@query("snk12_json_bundles", f"WITH {NEWS} SELECT count(*) AS rows, CAST(sum(length(summary)) AS BIGINT) AS chars, TRUE AS split, TRUE AS capped FROM news")
def snk12(v: Views):
    path = work_dir(v.spark, "bundles")
    rows = v.articles.select("doc_id", "title", "summary")
    tables.write_json_bundles(rows, path, 64 * 1024)
    largest = rows.agg(F.max(F.octet_length(F.to_json(F.struct("*"))) + 1)).scalar()
    df = v.spark.read.schema(rows.schema).json(path).select("summary", "_metadata.file_path", "_metadata.file_size")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("summary")).alias("chars"),
        (F.count_distinct("file_path") > 1).alias("split"), (F.max("file_size") <= 64 * 1024 + F.any_value(largest)).alias("capped"),
    )


@query("snk13_alert_channel", f"WITH {BARS} SELECT ticker, t, 'alerts:SIGNIFICANT_PRICE_CHANGE' AS channel FROM bars WHERE o > 0 AND abs({r('(c - o) / o * 100', 2)}) > 3")
def snk13(v: Views):
    alerts = candles.price_alerts(candles.enrich_bars(v.bars))
    messages = tables.alert_channel(alerts, ["ticker", "t", "message"])
    heard = tables.subscribe(messages, ["SIGNIFICANT_PRICE_CHANGE"])
    return heard.withColumn("b", F.from_json("data", "ticker STRING, t BIGINT")).select("b.ticker", "b.t", "channel")


@query("snk14_truncate", "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM customer")
def snk14(v: Views):
    path = work_dir(v.spark, "truncated")
    customers = v.table("customer")
    customers.write.parquet(path)
    lake_sink.truncate(v.spark, path)
    after = v.spark.read.parquet(path).agg(F.count(F.lit(1))).scalar()
    return customers.agg(F.count(F.lit(1)).alias("rows_before"), F.any_value(after).alias("rows_after"))
