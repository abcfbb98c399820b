"""Streaming queries: a file stream is drained and its output read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import news as nf
from tapeloom.functions.rounding import half_up
from tapeloom.operators import articles as art
from tapeloom.operators import candles, documents, indicators, ranking
from tapeloom.plans import news_stream_job
from tapeloom.queries import bars as bar_queries
from tapeloom.queries.registry import ORACLE, query
from tapeloom.session import materialize, work_dir
from tapeloom.sinks import lake as lake_sink
from tapeloom.streaming import batches, sinks, sources, state, timed, windows
from tapeloom.views import BARS, DAILY_SENTIMENT_SELECT, MENTIONS, NEWS, TICKS, Views, r


class StreamViews(Views):
    """The row-wise views over a stream of the same tables."""

    def table(self, name: str):
        return sources.parquet_table(self.spark, f"{self.folder}/{name}.parquet")


def _live(v: Views) -> StreamViews:
    return StreamViews(v.spark, v.folder)


def _drained(df, mode="append", batch=sinks.batch_folder):
    spark = df.sparkSession
    out = work_dir(spark, "stream")
    sinks.drain(df, batch(f"{out}/data"), f"{out}/checkpoint", mode)
    return f"{out}/data"


def _latest(df, *keys):
    """An update stream drained into the table of its newest versions."""
    return sinks.latest_of(df.sparkSession, _drained(df, "update", lambda path: sinks.latest_table(path, keys)), keys)


def _timed(ticks):
    """Ticks with a zoned event time, as watermarks need."""
    return ticks.withColumn("at", F.col("ts").cast("timestamp"))


@query(
    "str1_sentiment_windows",
    f"WITH {MENTIONS}, per AS (SELECT doc_id, published_s, overall_score, max(CASE WHEN i = 0 THEN ticker END) AS ticker, {r('sum(relevance)', 2)} AS rel FROM mentions GROUP BY doc_id, published_s, overall_score) "
    f"SELECT (published_s - published_s % 3600) * 1000 AS window_start, ticker, count(*) AS news_count, {r('avg(overall_score)', 4)} AS avg_sentiment, {r('sum(rel)', 2)} AS total_relevance, {r('CAST(count(*) FILTER (overall_score > 0.15) AS DOUBLE) / count(*)', 2)} AS positive_ratio FROM per GROUP BY ALL",
)
def str1(v: Views):
    e = art.enrich_news(_live(v).articles).withColumn("ticker", nf.primary_ticker(F.col("ticker_sentiment")))
    w = _latest(windows.sentiment_windows(e), "window_start", "ticker")
    return w.select("window_start", "ticker", "news_count", "avg_sentiment", "total_relevance", "positive_ratio")


def _topic_of(v: Views, rows):
    """Rows as JSON lines in a folder, standing for a topic; compressed, as a producer sends them."""
    path = work_dir(v.spark, "topic")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    return path


@query(
    "str2_ohlc_windows",
    f"WITH {BARS} SELECT t - t % 86400000 AS window_start, ticker, min_by(o, t) AS open, max(h) AS high, min(l) AS low, max_by(c, t) AS close, sum(v) AS volume, count(*) AS bar_count, {r('avg(c)', 2)} AS avg_price FROM bars GROUP BY ALL",
)
def str2(v: Views):
    path = work_dir(v.spark, "bars")
    v.bars.write.parquet(path)
    live = sources.parquet_folder(v.spark, path, v.bars.schema).withColumn("ts", F.timestamp_millis("t"))
    w = _latest(windows.bar_windows(live), "window_start", "ticker")
    return w.select("window_start", "ticker", "open", "high", "low", "close", "volume", "bar_count", "avg_price")


def _delivered(v: Views, rows, ts: str, order: str, files: int = 5, minutes: int = 9, silence: int = 7_200) -> str:
    """The rows in a folder of files that come one after another, each row up to ``minutes`` late and out of order.

    A last file holds one row without values, ``silence`` seconds after the others: it carries time forward.
    """
    path = work_dir(v.spark, "deliveries")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    arrival = us + F.pmod(F.xxhash64(order), F.lit(minutes * 60)) * 1_000_000
    staged = materialize(rows.withColumn("_arrival", arrival), "staged")
    low, high, last = staged.agg(F.min("_arrival"), F.max("_arrival"), F.max(ts)).first()
    part = F.floor((F.col("_arrival") - low) * files / F.lit(high - low + 1))
    for i in range(files):
        staged.filter(part == i).drop("_arrival").coalesce(1).sortWithinPartitions(F.xxhash64(order)).write.mode("append").parquet(path)
    types = {f.name: f.dataType for f in rows.schema.fields}
    at = (F.lit(last) + F.make_dt_interval(secs=F.lit(silence))).cast(types[ts])
    v.spark.range(1).select(*[at.alias(c) if c == ts else F.lit(None).cast(types[c]).alias(c) for c in rows.columns]).coalesce(
        1).write.mode("append").parquet(path)
    return path


def _one_by_one(v: Views, path: str):
    return sources.parquet_folder(v.spark, path, v.spark.read.parquet(path).schema, max_files=1)


@query("str3_stateful_indicators", ORACLE["indicators_all"])
def str3(v: Views):
    """Bars out of order over several micro-batches, in order again by event time."""
    bars = v.bars.select("ticker", "t", "c", F.timestamp_millis("t").alias("ts"))
    path = _delivered(v, bars.withColumn("at", F.concat_ws(":", "ticker", "t")), "ts", "at")
    out = sinks.rows_of(v.spark, _drained(timed.close_history(_one_by_one(v, path))))
    return state.indicators_of(out.filter("NOT late").drop("late", "batch_id"))


@query(
    "str4_bar_enrichment",
    f"WITH {BARS} SELECT ticker, t, {bar_queries._PCT} AS price_change_pct, CASE WHEN c > o THEN 'bullish' WHEN c < o THEN 'bearish' ELSE 'neutral' END AS trend FROM bars",
)
def str4(v: Views):
    """JSON messages in, enriched rows out, without Python between."""
    docs = candles.bar_documents(v.bars, F.lit(1706572800))
    live = sources.valid(sources.decoded(sources.text_messages(v.spark, _topic_of(v, docs)), schemas.OHLC), "ticker")
    out = sinks.rows_of(v.spark, _drained(candles.enrich_bars(live)))
    ti = F.col("technical_indicators")
    return out.select("ticker", "t", ti["price_change_pct"].alias("price_change_pct"), ti["trend"].alias("trend"))


@query(
    "str5_news_enrichment",
    f"WITH {MENTIONS} SELECT doc_id, CASE WHEN sum(relevance) > 0 THEN {r('sum(weighted) / nullif(sum(relevance), 0)', 4)} ELSE 0 END AS avg_weighted_sentiment, count(*) AS ticker_count FROM mentions GROUP BY doc_id",
)
def str5(v: Views):
    out = sinks.rows_of(v.spark, _drained(art.enrich_news(_live(v).articles).select("doc_id", "sentiment_analytics")))
    a = F.col("sentiment_analytics")
    return out.select("doc_id", a["avg_weighted_sentiment"].alias("avg_weighted_sentiment"), a["ticker_count"].cast("long").alias("ticker_count"))


@query("str6_alert_stream", ORACLE["set1_bars_with_alerts"])
def str6(v: Views):
    path = work_dir(v.spark, "bars")
    v.bars.write.parquet(path)
    live = sources.parquet_folder(v.spark, path, v.bars.schema)
    out = sinks.rows_of(v.spark, _drained(candles.bars_with_alerts(candles.enrich_bars(live))))
    return out.select(
        "ticker", "t", "record_type", F.col("technical_indicators.price_change_pct").alias("pct"), "alert_type", "message"
    )


@query("str7_sent_once", f"WITH {NEWS} SELECT message_id, published_s FROM news")
def str7(v: Views):
    """Every article arrives twice and goes out once."""
    docs = _live(v).articles.select("message_id", "published_s", "published_at")
    once = windows.unseen(docs.union(docs), "message_id", "published_at")
    return sinks.rows_of(v.spark, _drained(once)).select("message_id", "published_s")


@query("str8_latest_price_stream", f"WITH {TICKS} SELECT ticker, max_by(price, ts) AS price, max(t) AS t FROM ticks GROUP BY ticker")
def str8(v: Views):
    return _latest(windows.latest_values(_live(v).ticks, "price", "t"), "ticker")


@query("str8_latest_sentiment_stream", f"WITH {MENTIONS} SELECT ticker, max_by(score, doc_id * 10 + i) AS score, max(doc_id * 10 + i) AS at FROM mentions GROUP BY ticker")
def str8_sentiment(v: Views):
    """The newest sentiment of every ticker; a mention's place stands for its time."""
    m = _live(v).mentions.select("ticker", F.col("sentiment_score").alias("score"), (F.col("doc_id") * 10 + F.col("i")).alias("at"))
    return _latest(windows.latest_values(m, "score", "at"), "ticker")


@query(
    "str8_expiry",
    f"WITH {TICKS}, latest AS (SELECT ticker, max_by(price, ts) AS price, max(t) AS t FROM ticks GROUP BY ticker) "
    "SELECT CAST(ttl AS INTEGER) AS ttl_s, ticker, price, t FROM latest, (VALUES (300), (3600)) s(ttl) WHERE t + ttl * 1000 > (SELECT max(t) FROM ticks)",
)
def str8_expiry(v: Views):
    """Latest prices that expire in the stream, which is stopped and started again on its checkpoint half way."""
    ticks = _timed(v.ticks).select("ticker", "at", "event_id", "price")
    middle = ticks.agg(F.timestamp_micros(F.avg(F.unix_micros("at")).cast("long"))).scalar()
    path, out = work_dir(v.spark, "ticks"), {ttl: work_dir(v.spark, "stream") for ttl in (300, 3600)}
    for half in (F.col("at") <= middle, F.col("at") > middle):
        ticks.filter(half).coalesce(1).write.mode("append").parquet(path)
        for ttl, folder in out.items():
            latest = timed.expiring_latest(_one_by_one(v, path), "price", "at", "event_id", ttl)
            sinks.drain(latest, sinks.latest_table(f"{folder}/data", ["ticker"]), f"{folder}/checkpoint", "update")
    found = None
    for ttl, folder in out.items():
        live = sinks.latest_of(v.spark, f"{folder}/data", ["ticker"]).filter("live").select(
            F.lit(ttl).alias("ttl_s"), "ticker", F.col("value").alias("price"), F.expr("us div 1000").alias("t"))
        found = live if found is None else found.unionByName(live)
    return found


@query("str9_per_tick", ORACLE["agg9_window_statistics"])
def str9_per_tick(v: Views):
    """The exact trailing windows of every single tick of a stream, delivered out of order."""
    ticks = _timed(v.ticks).select("ticker", "at", "event_id", "price", "volume")
    live = timed.trailing_windows(_one_by_one(v, _delivered(v, ticks, "at", "event_id")), tuple(indicators.WINDOW_NAMES), ts="at")
    s = indicators.window_report(
        sinks.rows_of(v.spark, _drained(live)).filter("NOT late"), "ticker", F.expr("us div 1000").alias("t"), "event_id")
    rounded = {c: half_up(F.col(c), 4) for c in ("avg_price", "price_change", "price_change_pct")}
    return s.withColumns(rounded)


@query(
    "str10_refresh",
    f"WITH {TICKS}, latest AS (SELECT ticker, max_by(price, ts) AS price, max(t) AS t FROM ticks GROUP BY ticker), "
    "board AS (SELECT max(t) + 200000 - (max(t) + 200000) % 60000 AS refreshed FROM ticks) "
    "SELECT ticker, price, refreshed FROM latest, board WHERE t + 3600000 > refreshed ORDER BY price DESC, ticker DESC LIMIT 5",
)
def str10_refresh(v: Views):
    """The board 200 s after the last tick: it has been refreshed in the silence, without what has expired."""
    ticks = _timed(v.ticks).select("ticker", "at", "event_id", "price")
    path = _delivered(v, ticks, "at", "event_id", silence=740)  # the watermark is nine minutes behind
    boards = timed.refreshed_board(_one_by_one(v, path), "price", "at", "event_id", 5, 3_600, lateness="9 minutes")
    parts = _latest(boards, "part")
    return timed.merged_board(parts, "price", 5).withColumn("refreshed", F.lit(parts.agg(F.max("at")).scalar()))


#: Scores are hundredths: below this a difference from a mean is an error of rounding, whatever the order of its sum.
NOISE = 1e-10


@query("win12_stream", ORACLE["win12_sentiment_anomaly"].replace("score > mean", f"score - mean > {NOISE!r}"))
def win12_stream(v: Views):
    """The anomalies of a stream, from five numbers per ticker; mentions come out of order. A score equal to the mean is a drop."""
    m = v.mentions.select(
        "ticker", F.timestamp_seconds("published_s").alias("at"), (F.col("doc_id") * 10 + F.col("i")).alias("tie"), F.col("sentiment_score").alias("score"))
    flat = m.filter("tie % 10 = 0").withColumns({"ticker": F.lit("FLAT"), "score": F.lit(0.25)})
    path = _delivered(v, m.unionByName(flat), "at", "tie")
    history = sinks.rows_of(v.spark, _drained(timed.running_moments(_one_by_one(v, path), "ticker", "score", "at", "tie")))
    told = history.filter("NOT late").select(
        "*", F.expr("tie div 10").alias("doc_id"), F.expr("CAST(tie % 10 AS INT)").alias("i"), F.col("value").alias("score"))
    return indicators.anomaly_report(told, "score", ["ticker", "doc_id", "i", "score"], noise=NOISE)


WIDTHS = (5, 15, 60)


@query(
    "str9_sliding_windows",
    f"WITH {TICKS}, w AS (SELECT *, m AS minutes, t - t % 60000 - k * 60000 AS window_start FROM ticks CROSS JOIN (SELECT m, unnest(range(m)) AS k FROM (VALUES (5), (15), (60)) s(m)) s) "
    f"SELECT minutes, window_start, ticker, {r('avg(price)', 4)} AS avg_price, max(price) AS max_price, min(price) AS min_price, min_by(price, ts) AS first_price, max_by(price, ts) AS last_price, CAST(sum(volume) AS DOUBLE) AS total_volume, count(*) AS data_points FROM w GROUP BY minutes, window_start, ticker",
)
def str9(v: Views):
    """One stream per width, each into a table of its own."""
    out = None
    for minutes in WIDTHS:
        w = windows.sliding_price_windows(_timed(_live(v).ticks), "at", f"{minutes} minutes")
        part = _latest(w, "window_start", "ticker").drop("window_end").withColumn("minutes", F.lit(minutes))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("avg_price", half_up(F.col("avg_price"), 4))


@query(
    "str10_leaderboard_refresh",
    f"WITH {TICKS}, latest AS (SELECT ticker, max_by(price, ts) AS price FROM ticks GROUP BY ticker) SELECT ticker, price FROM latest ORDER BY price DESC, ticker DESC LIMIT 5",
)
def str10(v: Views):
    board = ranking.leaderboard(_live(v).ticks, "price", "price", "ts", 5)
    return v.spark.read.parquet(_drained(board, "complete", sinks.snapshot))


@query("str11_micro_batches", "SELECT count(*) AS rows, TRUE AS several_batches FROM events")
def str11(v: Views):
    path = work_dir(v.spark, "files")
    ticks = v.ticks.select("ticker", "t", "event_id")
    ticks.repartition(4, F.col("event_id")).write.parquet(path)
    live = sources.parquet_folder(v.spark, path, ticks.schema, max_files=1)
    out = sinks.rows_of(v.spark, _drained(live))
    return out.agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct("batch_id") > 1).alias("several_batches"))


@query("str11_rows_or_seconds", "SELECT count(*) AS rows, (count(*) + 249) // 250 AS batches, least(count(*), 250) AS most FROM documents")
def str11_rows(v: Views):
    """Articles in batches of 250 whatever the files they come in; the last one is closed by its age. Batches that wait go together."""
    path, out = work_dir(v.spark, "messages"), work_dir(v.spark, "stream")
    v.articles.select(F.to_json(F.struct("message_id", "time_published"))).repartition(3).write.text(path)
    live = batches.message_batches(v.spark, path, f"{out}/log", 250, 0, together=400)
    query = sinks.start(live, sinks.batch_folder(f"{out}/data"), f"{out}/checkpoint", every_seconds=0)
    query.processAllAvailable()
    query.stop()
    sizes = sinks.rows_of(v.spark, f"{out}/data").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("batches"), F.max("n").alias("most"))


@query("str12_restart", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def str12(v: Views):
    """The stream is stopped and started again on its checkpoint: nothing is read twice."""
    out = work_dir(v.spark, "stream")
    for _ in range(2):
        sinks.drain(_live(v).table("events"), sinks.batch_folder(f"{out}/data"), f"{out}/checkpoint")
    return sinks.rows_of(v.spark, f"{out}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("str14_malformed_records", ORACLE["snk11_dead_letters"])
def str14(v: Views):
    live = _live(v)
    feed = live.table("events").select(F.col("props").alias("value")).union(live.table("documents").select(F.col("text").alias("value")))
    data = sources.decoded(feed, schemas._struct(k=schemas.L))
    out = work_dir(v.spark, "stream")
    sinks.drain(sources.valid(data, "k"), sinks.batch_folder(f"{out}/valid"), f"{out}/c1")
    sinks.drain(sources.malformed(data, "k"), sinks.batch_folder(f"{out}/dead"), f"{out}/c2")
    return documents.output_counts({n: sinks.rows_of(v.spark, f"{out}/{n}") for n in ("valid", "dead")})


@query(
    "str15_topic_dispatch",
    f"SELECT 'purchase' AS topic, count(*) AS rows, {r('sum(value * 2)', 2)} AS total FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'view', count(*), {r('sum(value)', 2)} FROM events WHERE event_type = 'view'",
)
def str15(v: Views):
    out = work_dir(v.spark, "stream")
    hooks = {"purchase": lambda df: df.withColumn("value", F.col("value") * 2), "view": lambda df: df}
    sinks.drain(_live(v).table("events"), sinks.dispatch(hooks, "event_type", f"{out}/data"), f"{out}/checkpoint")
    parts = [
        sinks.rows_of(v.spark, f"{out}/data/{t}").agg(
            F.lit(t).alias("topic"), F.count(F.lit(1)).alias("rows"), half_up(F.sum("value"), 2).alias("total")
        )
        for t in hooks
    ]
    return parts[0].unionByName(parts[1])


@query(
    "str17_watermark",
    f"WITH {TICKS} SELECT t - t % 300000 AS window_start, ticker, count(*) AS data_points FROM ticks WHERE (t - t % 300000 + 300000) * 1000 <= (SELECT epoch_us(max(ts)) FROM ticks) - 600000000 GROUP BY ALL",
)
def str17(v: Views):
    """Append mode: a window goes out once the watermark has passed its end."""
    w = windows.sliding_price_windows(_timed(_live(v).ticks), "at", "5 minutes", "5 minutes")
    return sinks.rows_of(v.spark, _drained(w)).select("window_start", "ticker", "data_points")


@query(
    "snk6_stream_upsert",
    f"WITH {TICKS} SELECT 'keyed' AS kind, ticker AS name, count(*) AS rows, max(t) AS newest FROM ticks GROUP BY ticker UNION ALL SELECT 'keyless', ticker, count(*), max(t) FROM ticks WHERE t % 3 = 0 GROUP BY ticker",
)
def snk6_stream(v: Views):
    """Documents with keys, which repeat, and without; the last batch is applied twice, as after a failure."""
    docs = v.ticks.select(F.col("event_id").cast("string").alias("_id"), "ticker", "t")
    loose = docs.filter(F.col("t") % 3 == 0).withColumn("_id", F.lit(None).cast("string"))
    path, out = work_dir(v.spark, "documents"), work_dir(v.spark, "stream")
    docs.unionByName(docs).unionByName(loose).write.parquet(path)
    live = sources.parquet_folder(v.spark, path, docs.schema)
    upsert = sinks.upsert_table(f"{out}/table", "_id", ["t"])

    def twice(df, batch_id: int) -> None:
        upsert(df, batch_id)
        upsert(df, batch_id)

    sinks.drain(live, twice, f"{out}/checkpoint")
    kind = F.when(F.col("_id").startswith("auto-"), "keyless").otherwise("keyed")
    return sinks.upserted_rows(v.spark, f"{out}/table", "_id", ["t"]).groupBy(kind.alias("kind"), F.col("ticker").alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("t").alias("newest"))


@query("src4_json_topic", ORACLE["src10_json_files"] if "src10_json_files" in ORACLE else None)
def src4(v: Views):
    docs = candles.bar_documents(v.bars, F.lit(1706572800))
    live = sources.valid(sources.decoded(sources.text_messages(v.spark, _topic_of(v, docs)), schemas.OHLC), "ticker")
    return sinks.rows_of(v.spark, _drained(live)).select("ticker", "t", *"ohlcv")


@query("src11_incremental_poll", f"WITH {BARS} SELECT ticker, t, c, CASE WHEN ingest_date < DATE '2024-01-16' THEN 'first poll' ELSE 'second poll' END AS poll FROM bars")
def src11(v: Views):
    """A second poll of the folder sends only the files that have come since."""
    path, out = work_dir(v.spark, "folder"), work_dir(v.spark, "stream")
    rows = v.lake_bars.select("ticker", "t", "c", "ingest_date")
    early = F.col("ingest_date") < F.lit("2024-01-16").cast("date")
    for part in (early, ~early):
        rows.filter(part).drop("ingest_date").write.mode("append").parquet(path)
        live = sources.parquet_folder(v.spark, path, rows.drop("ingest_date").schema)
        sinks.drain(live, sinks.batch_folder(f"{out}/data"), f"{out}/checkpoint")
    poll = F.when(F.col("batch_id") == 0, "first poll").otherwise("second poll")
    return sinks.rows_of(v.spark, f"{out}/data").select("ticker", "t", "c", poll.alias("poll"))


def _envelope_topic(v: Views, rows):
    return _topic_of(v, art.to_envelope(rows, F.col("message_id"), F.timestamp_seconds("published_s")))


def _envelopes(v: Views, path: str):
    messages = sources.decoded(sources.text_messages(v.spark, path), schemas.NEWS_ENVELOPE)
    return sources.valid(messages, "message_id")


@query(
    "str18_sql_micro_batches",
    f"WITH {MENTIONS} {DAILY_SENTIMENT_SELECT} FROM mentions GROUP BY ALL",
)
def str18(v: Views):
    """Two overlapping deliveries; the second repeats the first's articles under the next day. Each is stored once."""
    out = work_dir(v.spark, "stream")
    early = F.col("published_at") < F.lit("2024-01-20").cast("timestamp")
    later = F.date_format(F.col("published_at") + F.expr("INTERVAL 1 DAY"), "yyyyMMdd'T'HHmmss")
    again = v.articles.withColumn("time_published", F.when(early, later).otherwise(F.col("time_published")))
    for run, rows in (("first", v.articles.filter(early)), ("second", again)):
        live = _envelopes(v, _envelope_topic(v, rows))
        sinks.drain(live, news_stream_job.into_tables(f"{out}/db", run), f"{out}/checkpoint-{run}")
    daily = news_stream_job.table(v.spark, f"{out}/db", news_stream_job.DAILY, news_stream_job.DAILY_DDL)
    return daily.drop("created_batch", "updated_batch")


@query(
    "job7_news_stream",
    f"WITH {MENTIONS} SELECT 'lake' AS output, (SELECT count(*) FROM news) AS rows UNION ALL SELECT 'news', (SELECT count(*) FROM news) UNION ALL SELECT 'mapping', (SELECT count(*) FROM mentions)",
)
def job7(v: Views):
    out, path = work_dir(v.spark, "stream"), _envelope_topic(v, v.articles)
    live = _envelopes(v, path)
    sinks.drain(news_stream_job.lake_rows(live), sinks.lake(f"{out}/landing", dead_path=f"{out}/dead"), f"{out}/c1")
    for _ in range(2):
        lake_sink.publish_days(v.spark, f"{out}/landing", f"{out}/lake", "2024-01-01", "2024-02-01")
    sinks.drain(live, news_stream_job.into_tables(f"{out}/db"), f"{out}/c2")
    n = news_stream_job
    return documents.output_counts({
        "lake": v.spark.read.parquet(f"{out}/lake"),
        "news": n.table(v.spark, f"{out}/db", n.NEWS, n.NEWS_DDL),
        "mapping": n.table(v.spark, f"{out}/db", n.MAPPING, n.MAPPING_DDL),
    })
