import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import news as nf
from tapeloom.functions import text, timing
from tapeloom.operators import articles as art
from tapeloom.operators import documents, merge

MENTIONS = nf.TICKER_SENTIMENT_DDL


def article(spark, mentions, score="0.45"):
    rows = [("m1", "A title", "20240101T120000", score, "Bullish", mentions)]
    return spark.createDataFrame(
        rows, f"message_id string, title string, time_published string, overall_sentiment_score string, "
              f"overall_sentiment_label string, ticker_sentiment {MENTIONS}")


def test_one_article(spark):
    a = art.enrich_news(article(spark, [("AAPL", "0.9", "0.5", "Bullish")])).first().sentiment_analytics
    assert (a.overall_score, a.sentiment_category, a.ticker_count) == (0.45, "very_positive", 1)
    assert (a.avg_weighted_sentiment, a.total_relevance) == (0.5, 0.9)
    assert a.tickers[0].weighted_score == pytest.approx(0.45)


def test_article_without_mentions(spark):
    a = art.enrich_news(article(spark, [], None)).first()
    assert (a.sentiment_analytics.avg_weighted_sentiment, a.sentiment_analytics.ticker_count) == (0.0, 0)
    assert a.sentiment_analytics.overall_score == 0.0
    null = art.enrich_news(article(spark, None)).first()
    assert null.sentiment_summary.ticker_count == 0 and null.sentiment_summary.tickers == []


def test_boundaries_differ_between_the_two_scales(spark):
    df = spark.createDataFrame([(x,) for x in (0.35, 0.15, -0.15, -0.35, -0.36)], "s double")
    got = [(r.a, r.b) for r in df.select(nf.sentiment_category(F.col("s")).alias("a"), nf.sentiment_bucket(F.col("s")).alias("b")).collect()]
    assert got == [("very_positive", "positive"), ("positive", "neutral"), ("neutral", "neutral"),
                   ("negative", "negative"), ("very_negative", "negative")]


def test_last_mention_of_a_ticker_wins(spark):
    m = [("A", "1", "0.1", "x"), ("B", "1", "0.2", "x"), ("A", "1", "0.3", "y"), (None, "1", "0.9", "x")]
    a = article(spark, m)
    got = a.select(nf.metrics_map(nf.mention_structs(F.col("ticker_sentiment"))).alias("m")).first().m
    assert {k: v.sentiment_score for k, v in got.items()} == {"A": 0.3, "B": 0.2}
    assert art.mentions_of(a).count() == 4 and art.unique_mentions_of(a).count() == 2


def test_five_copies(spark):
    a = article(spark, [("AAPL", "0.9", "0.5", "Bullish")])
    five = a
    for _ in range(4):
        five = five.unionAll(a)
    items = F.lit(5).cast("long")
    r = art.ticker_sentiment_report(art.unique_mentions_of(five), items, F.lit("s"), F.lit("e")).first()
    assert (r.news_count, r.avg_sentiment, r.avg_relevance, r.avg_weighted_sentiment) == (5, 0.5, 0.9, 0.45)
    assert (r.sentiment_volatility, r.positive_count, r.positive_ratio) == (0.0, 5, 1.0)


def test_lenient_lists(spark):
    values = ['[{"topic":"x","relevance_score":"1"}]', "[{'topic':'x','relevance_score':'1'}]",
              "[{'topic':'it's','relevance_score':'1'}]", '[{"topic":', None, "", "words"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [len(r[0]) for r in df.select(text.lenient_array(F.col("v"), schemas.TOPICS)).collect()] == [1, 1, 0, 0, 0, 0, 0]
    names = spark.createDataFrame([("['Ann', 'Bob']",), ("Ann",), ('["Ann"]',), (None,), ("",)], "v string")
    assert [r[0] for r in names.select(text.lenient_strings(F.col("v"))).collect()] == [["Ann", "Bob"], ["Ann"], ["Ann"], [], []]


def test_safe_numbers_and_times(spark):
    df = spark.createDataFrame([("1.5",), ("overall_sentiment_score",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(text.safe_double(F.col("v"))).collect()] == [1.5, 0.0, 0.0, 0.0]
    t = spark.createDataFrame([("20251216T120000",), ("2025-12-16T12:00:00Z",), ("soon",), (None,)], "v string")
    noon = dt.datetime(2025, 12, 16, 12)
    assert [r[0] for r in t.select(timing.parse_published(F.col("v"))).collect()] == [noon, noon, None, None]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    assert df.select(*[c.alias(k) for k, c in timing.iso_week_parts(F.col("d")).items()]).first() == (2025, 1)
    b = df.select(timing.month_bounds(F.col("d")).alias("b")).first().b
    assert (b.start_ts, b.end_ts) == (1733011201, 1735689600)
    neg = spark.createDataFrame([(-1,), (-86401,), (86399,)], "t long")
    assert [r[0] for r in neg.select(timing.truncate_epoch(F.col("t"))).collect()] == [0, -86400, 0]


def test_keys(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2))], "k string, d date")
    same = df.select(text.surrogate_key(F.col("d")) == text.surrogate_key(F.lit("2024-01-02"))).first()[0]
    assert same
    assert df.select(text.composite_key(F.col("k"), F.lit(5))).first()[0] == "A_5"


def test_envelope_round_trip(spark):
    quoted = "[{'ticker': 'AAPL', 'relevance_score': '0.9', 'ticker_sentiment_score': '0.5', 'ticker_sentiment_label': 'Bullish'}]"
    docs = spark.createDataFrame(
        [("d1", "T", "20240102T000000", "Ann", quoted, "bad"), ("d2", "T", "20240103T000000", None, "junk", None)],
        "_id string, title string, time_published string, authors string, ticker_sentiment string, overall_sentiment_score string")
    e = art.to_envelope(docs)
    rows = {r.source_id: r for r in e.collect()}
    assert rows["d1"].metadata.partition_key == "AAPL" and rows["d2"].metadata.partition_key == "UNKNOWN"
    assert rows["d1"].data.authors == ["Ann"] and rows["d1"].data.overall_sentiment_score == 0.0
    assert len(rows["d1"].message_id) == 36
    flat = art.with_ingest_date(art.flatten_envelope(e))
    assert len(flat.columns) == 22
    r = {x.source_id: x for x in flat.collect()}
    assert (r["d1"].primary_ticker, r["d1"].primary_ticker_sentiment_score) == ("AAPL", 0.5)
    assert (r["d2"].primary_ticker, r["d2"].ticker_sentiment_json, r["d2"].ingest_date) == ("", "[]", dt.date(2024, 1, 3))
    flat_form = article(spark, [("AAPL", "0.9", "0.5", "Bullish")])
    for form in (e, flat_form):
        one = art.from_either_shape(form).filter(F.size("ticker_sentiment") > 0).first()
        assert one.ticker_sentiment[0].ticker == "AAPL" and one.message_id


def test_search_and_ranges(spark):
    docs = spark.createDataFrame(
        [("1", "title", "20240101T000000", [("AAPL", "1", "1", "x")]), ("2", None, "20240102T235959", [("msft", "1", "1", "x")]),
         ("3", "ok", "20240103T000000", [("AAPL", "1", "1", "x")])],
        f"_id string, title string, time_published string, ticker_sentiment {MENTIONS}")
    ids = lambda df: sorted(r._id for r in df.collect())
    assert ids(art.skip_header(docs)) == ["2", "3"]
    assert ids(art.published_between(docs, "2024-01-01", "2024-01-02")) == ["1", "2"]
    assert ids(documents.find_news(docs, "aapl", "20240102T000000", "20240103T000000")) == ["3"]
    assert ids(documents.find_news(docs, "MS")) == ["2"]


def test_partial_updates(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "_id string, n int, s string")
    updates = spark.createDataFrame([("a", 5, None, 1), ("a", None, "z", 2), ("a", 6, None, 3), ("c", 9, None, 1), (None, 7, "loose", 1)],
                                    "_id string, n int, s string, seq int")
    got = merge.apply_documents(target, updates, "_id", [F.col("seq")])
    assert sorted(("loose" if r._id.startswith("auto-") else r._id, r.n, r.s) for r in got.collect()) == [
        ("a", 6, "z"), ("b", 2, "y"), ("c", 9, None), ("loose", 7, "loose")]
    again = merge.set_fields(merge.set_fields(target, updates.na.drop(subset=["_id"]), "_id", [F.col("seq")]),
                             updates.na.drop(subset=["_id"]), "_id", [F.col("seq")])
    assert sorted((r._id, r.n) for r in again.collect()) == [("a", 6), ("b", 2), ("c", 9)]


def test_upsert_can_set_null_and_keeps_columns(spark):
    target = spark.createDataFrame([("a", 1, "old")], "k string, n int, created string")
    source = spark.createDataFrame([("a", None, "new"), ("b", 2, "new")], "k string, n int, created string")
    got = sorted(tuple(r) for r in merge.upsert(target, source, ["k"], keep=["created"]).collect())
    assert got == [("a", None, "old"), ("b", 2, "new")]


def test_new_rows_with_a_hot_copy(spark):
    source = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), (None, 1)], "k string, n int")
    target = spark.createDataFrame([("b", 0)], "k string, n int")
    assert [tuple(r) for r in merge.new_rows(source, target, ["k"], [F.asc("n")]).collect()] == [("a", 0)]


def test_clamp(spark):
    df = spark.createDataFrame([(5,), (11,), (None,)], "t int")
    assert [tuple(r) for r in merge.clamp(df, "t", 10).collect()] == [(5, False), (10, True), (None, False)]


def test_merged_partials_equal_one_accumulation(spark):
    analytics = "struct<overall_score: double, total_relevance: double>"
    rows = [("a" if i % 3 else "b", i % 4, ((i % 7 - 3) / 10, i / 8)) for i in range(40)] + [(None, 1, (0.15, None))]
    enriched = spark.createDataFrame(rows, f"source string, day int, sentiment_analytics {analytics}")
    partials = art.sentiment_partials(enriched, "source", "day").repartition(3)
    got = art.merged_sentiment(partials, "source")
    want = art.sentiment_accumulation(enriched, "source")
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    days = art.merged_sentiment(partials.filter("day < 2"), "source")
    want = art.sentiment_accumulation(enriched.filter("day < 2"), "source")
    assert {tuple(r) for r in days.collect()} == {tuple(r) for r in want.collect()}
    assert art.merged_sentiment(partials.limit(0), "source").collect() == []


def test_article_line(spark):
    rows = spark.createDataFrame([("x" * 60, "Bullish", 0.4, 2), (None, None, -0.125, 0)], "title string, label string, score double, n int")
    got = [r[0] for r in rows.select(nf.article_line(F.col("title"), F.col("label"), F.col("score"), F.col("n"))).collect()]
    assert got[0] == f"Processed News: {'x' * 50}... | Sentiment: Bullish (0.40) | Tickers: 2"
    assert got[1].startswith("Processed News: No title... | Sentiment: null (-0.1")
