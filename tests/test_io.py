import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import articles as art
from tapeloom.operators import candles
from tapeloom.plans import candles_job, companies_job, news_stream_job
from tapeloom.queries import ORACLE, QUERIES
from tapeloom.session import work_dir
from tapeloom.sinks import lake, tables
from tapeloom.sources import paths, readers
from tapeloom.streaming import sinks, sources, windows
from tapeloom.views import Views

BARS = "ticker string, t long, o double, h double, l double, c double, v double, n long, vw double"


def days(n, per_day=3, ticker="A"):
    return [(ticker, (d * 24 + h) * 3_600_000, 1.0, 2.0, 0.5, 1.5, 10.0, 4, 1.2) for d in range(n) for h in range(per_day)]


def lake_bars(spark, rows):
    return spark.createDataFrame(rows, BARS).withColumn("ingest_date", F.timestamp_millis("t").cast("date"))


def test_rows_with_schema(spark):
    df = readers.employees(spark, [(1, "Alice", "HR", 5000, "2021-03-15"), (2, "Bob", None, None, None)])
    assert df.schema == schemas.EMPLOYEE and df.filter("salary is null").count() == 1


def test_lake_range_prunes_and_is_half_open(spark):
    path = work_dir(spark, "t")
    lake.write_lake(lake_bars(spark, days(5)), path)
    df = readers.lake_range(spark, path, "1970-01-02", "1970-01-04")
    assert {str(r.ingest_date) for r in df.collect()} == {"1970-01-02", "1970-01-03"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan


def test_overlapping_job_runs_do_not_repeat_facts(spark):
    src, wh = work_dir(spark, "t"), work_dir(spark, "t")
    lake.write_lake(lake_bars(spark, days(6)), src)
    candles_job.run(spark, src, wh, "1970-01-01", "1970-01-05")
    for _ in range(2):
        candles_job.run(spark, src, wh, "1970-01-03", "1970-01-07")
    assert spark.read.parquet(f"{wh}/fact_candles").count() == 18
    dim = spark.read.parquet(f"{wh}/dim_time")
    assert dim.count() == 6 and dim.select("time_id").distinct().count() == 6


def test_missing_parts(spark):
    base = work_dir(spark, "t")
    assert readers.exported(spark, base, "ohlc").count() == 0
    assert readers.json_files(spark, [f"{base}/none"], schemas.OHLC).count() == 0


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"ticker": "A", "t": 1}, {"ticker": "B"}], indent=2))
    rows = readers.json_array(spark, str(tmp_path), schemas.OHLC).orderBy("ticker").collect()
    assert [(r.ticker, r.t) for r in rows] == [("A", 1), ("B", None)]


def test_csv_keeps_quotes(spark):
    path = work_dir(spark, "t")
    rows = spark.createDataFrame([("XNYS", "US", 'New "York", big'), ("XLON", "UK", None)], schemas.relational_schema("exchanges"))
    tables.csv_sink(path)(rows)
    assert sorted(map(tuple, readers.csv_table(spark, path, "exchanges").collect())) == sorted(map(tuple, rows.collect()))


def test_compaction_keeps_rows_and_splits_big_partitions(spark):
    path = work_dir(spark, "t")
    df = lake_bars(spark, days(3, 24) + days(1, 24, "HOT") * 8).repartition(6, F.col("t"), F.rand(1))
    df.write.partitionBy("ingest_date").parquet(path)
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    sizes = {r.folder[-10:]: r.bytes for r in lake.small_file_partitions(spark, path, 2).collect()}
    small = max(sizes.values()) // 2 + 1  # the largest day needs two files
    assert lake.compact(spark, path, min_files=3, target_bytes=small) == 3
    after = spark.read.parquet(path)
    assert sorted(map(tuple, after.collect())) == before
    files = {str(r.ingest_date): r.n for r in after.withColumn("f", F.input_file_name()).groupBy("ingest_date").agg(F.count_distinct("f").alias("n")).collect()}
    assert all(n <= 2 for n in files.values())
    assert not paths.exists(spark, f"{path}/_compacting")


def test_replacing_a_table_that_is_read(spark):
    path = work_dir(spark, "t")
    spark.range(3).write.parquet(path)
    lake.replace_table(spark.read.parquet(path).selectExpr("id + 10 as id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    paths.rename(spark, path, f"{path}.old")  # as if stopped between the renames
    lake.recover_table(spark, path)
    assert spark.read.parquet(path).count() == 3
    lake.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_dimension_rebuild_profile(spark):
    src, wh = work_dir(spark, "t"), work_dir(spark, "t")
    spark.createDataFrame([("Apple", "AAPL")], "company_name string, company_ticker string").write.parquet(src)
    for _ in range(2):
        profile = companies_job.run(spark, src, wh).first()
    assert set(profile.asDict().values()) == {0}
    assert spark.read.parquet(f"{wh}/dim_companies").first().company_cik == "Unknown"


def test_messages_and_routes(spark):
    df = spark.createDataFrame([("A", 1.5), (None, 2.0)], "ticker string, c double")
    got = {r.key: json.loads(r.value) for r in tables.keyed_messages(df, F.col("ticker"), "test").collect()}
    assert set(got) == {"A", "UNKNOWN"} and got["A"]["_kafka_source"] == "test" and "_kafka_timestamp" in got["A"]
    r = tables.routed(df, F.col("ticker"), {"A": "a_docs"}).collect()
    assert [x.collection for x in r] == ["a_docs", None]


# Streams ----------------------------------------------------------------------------------

TICKS = "ticker string, ts timestamp, price double, volume long"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


def add_file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_counted(spark):
    path, out = work_dir(spark, "t"), work_dir(spark, "t")
    paths_schema = spark.createDataFrame([], TICKS).schema
    dropped = 0
    batches = [
        [("A", at(1), 1.0, 1)],
        [("A", at(30), 2.0, 1)],                          # moves the watermark to minute 20
        [("A", at(2), 9.0, 1), ("A", at(21), 3.0, 1)],    # one late row, one within the watermark
        [("A", at(59), 4.0, 1)],                          # closes everything before
    ]
    for rows in batches:
        add_file(spark, path, rows, TICKS)
        live = sources.parquet_folder(spark, path, paths_schema)
        q = sinks.drain(windows.sliding_price_windows(live, width="5 minutes", slide="5 minutes"),
                        sinks.batch_folder(f"{out}/d"), f"{out}/c")
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    rows = sinks.rows_of(spark, f"{out}/d").orderBy("window_start").collect()
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [((r.window_start - start) // 60_000, r.data_points) for r in rows] == [(0, 1), (20, 1), (30, 1)]
    assert dropped == 1


def test_stream_windows_equal_batch_over_many_batches(spark):
    path, out = work_dir(spark, "t"), work_dir(spark, "t")
    rows = [(t, at(m), float(m % 7), 1) for m in range(40) for t in ("A", "B")]
    for i in range(0, 80, 20):
        add_file(spark, path, rows[i:i + 20], TICKS)
    batch = spark.createDataFrame(rows, TICKS)
    live = sources.parquet_folder(spark, path, batch.schema, max_files=1)
    sinks.drain(windows.sliding_price_windows(live), sinks.latest_table(f"{out}/d", ["window_start", "ticker"]), f"{out}/c", "update")
    got = sinks.latest_of(spark, f"{out}/d", ["window_start", "ticker"])
    want = windows.sliding_price_windows(batch)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_compaction_that_stopped_is_finished(spark):
    path = work_dir(spark, "t")
    rows = spark.range(40).selectExpr("id", "id % 2 as ingest_date")
    rows.repartition(4).write.partitionBy("ingest_date").parquet(path)
    rows.repartition(1).write.partitionBy("ingest_date").parquet(f"{path}/{lake.STAGED}")
    paths.delete(spark, f"{path}/ingest_date=0")
    lake.finish_compaction(spark, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(40))
    assert not paths.exists(spark, f"{path}/{lake.STAGED}")


def test_missing_inputs_are_skipped(spark):
    path = work_dir(spark, "t")
    spark.range(3).write.json(f"{path}/a")
    schema = spark.range(0).schema
    wanted = [f"{path}/a/*.json", f"{path}/b/*.json", f"{path}/c"]
    assert readers.json_files(spark, wanted, schema).count() == 3
    assert readers.json_files(spark, f"{path}/none*", schema).count() == 0


class Options:
    """Stands for a reader or writer and keeps what it is told."""

    def __init__(self):
        self.told, self.read, self.readStream = {}, self, self

    def option(self, key, value):
        self.told[key] = value
        return self

    def options(self, **more):
        self.told.update(more)
        return self

    def format(self, name):
        return self.option("format", name)

    def mode(self, name):
        return self.option("mode", name)

    def load(self):
        return self

    def select(self, *_):
        return self

    def save(self):
        self.option("saved", True)

    @property
    def write(self):
        return self


def test_options_of_connectors_that_are_absent_here():
    told = Options()
    sources.kafka_messages(told, "b:1", "t", max_offsets=5, flush=sources.LAKE_FLUSH)
    assert told.told["minOffsetsPerTrigger"] == 1000 and told.told["maxTriggerDelay"] == "60s"
    assert told.told["subscribe"] == "t" and told.told["maxOffsetsPerTrigger"] == 5
    told = Options()
    readers.jdbc_table(told, "u", "t", ["a"], {"user": "x"}, ("id", 0, 9, 3))
    assert told.told["numPartitions"] == 3 and told.told["partitionColumn"] == "id" and told.told["user"] == "x"
    for sink, fmt in ((tables.jdbc_sink("u", "t", {}), "jdbc"), (tables.kafka_sink("b", "t"), "kafka")):
        told = Options()
        sink(told)
        assert told.told["format"] == fmt and told.told["saved"]


def test_sent_once_across_batches_and_restarts(spark):
    path, out = work_dir(spark, "t"), work_dir(spark, "t")
    schema = "message_id string, at timestamp"
    for rows in ([("a", at(0)), ("a", at(1))], [("a", at(2)), ("b", at(2))], [("b", at(3))]):
        add_file(spark, path, rows, schema)
        live = sources.parquet_folder(spark, path, spark.createDataFrame([], schema).schema)
        sinks.drain(windows.unseen(live, "message_id", "at"), sinks.batch_folder(f"{out}/d"), f"{out}/c")
    assert sorted(r.message_id for r in sinks.rows_of(spark, f"{out}/d").collect()) == ["a", "b"]


def test_upsert_stream_is_idempotent(spark):
    path = work_dir(spark, "t")
    write = sinks.upsert_table(path, "_id", ["seq"])
    first = spark.createDataFrame([(str(i), i, None, 0) for i in range(12)], "_id string, n int, s string, seq int")
    partial = spark.createDataFrame([("3", None, "x", 1), ("12", 12, None, 1)], "_id string, n int, s string, seq int")
    for i, df in enumerate([first, partial, partial]):
        write(df, i)
    rows = {r._id: (r.n, r.s) for r in sinks.upserted_rows(spark, path, "_id", ["seq"]).collect()}
    assert len(rows) == 13 and rows["3"] == (3, "x") and rows["12"] == (12, None)


def test_upsert_stream_inserts_keyless_documents_once(spark):
    path = work_dir(spark, "t")
    write = sinks.upsert_table(path, "_id", ["seq"])
    rows = [(None, 1, 0), (None, 1, 0), (None, 2, 0), ("a", 3, 0)]
    docs = spark.createDataFrame(rows, "_id string, n int, seq int")
    for batch_id in (0, 0, 1):
        write(docs, batch_id)
    assert sorted(r.n for r in sinks.upserted_rows(spark, path, "_id", ["seq"]).collect()) == [1, 1, 1, 1, 2, 2, 3]


def test_latest_table_holds_one_row_per_key(spark):
    path = work_dir(spark, "t")
    write = sinks.latest_table(path, ["k"])
    for i, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("a", 2)], [("c", 3)]]):
        write(spark.createDataFrame(rows, "k string, x int"), i)
    assert sorted(map(tuple, sinks.latest_of(spark, path, ["k"]).select("k", "x").collect())) == [("a", 2), ("b", 1), ("c", 3)]


def parts_of(spark, path):
    return {n: paths.size(spark, f"{path}/{n}") for n in paths.children(spark, path) if "-" in n}


def test_a_batch_writes_its_own_rows_and_not_the_table(spark, monkeypatch):
    path = work_dir(spark, "t")
    write = sinks.latest_table(path, ["k"])
    monkeypatch.setattr(sinks, "FOLD_DELTAS", 1)
    write(spark.range(50_000).select(F.col("id").alias("k"), F.lit(0).alias("x")), 0)
    monkeypatch.undo()
    before = parts_of(spark, path)
    write(spark.range(1_000).select((F.col("id") * 50).alias("k"), F.lit(1).alias("x")), 1)
    after = parts_of(spark, path)
    assert {n: after[n] for n in before} == before and set(after) - set(before) == {"delta-1"}
    assert spark.read.parquet(f"{path}/delta-1").count() == 1_000
    table = sinks.latest_of(spark, path, ["k"])
    assert (table.count(), table.agg(F.sum("x")).first()[0]) == (50_000, 1_000)


@pytest.mark.parametrize("crash", [None, "before", "after"])
def test_deltas_fold_into_a_base(spark, monkeypatch, crash):
    """With a fold that stops before its base is complete, or before old files are deleted, and with batches repeated."""
    path, keys = work_dir(spark, "t"), ["k"]
    write = sinks.latest_table(path, keys)
    monkeypatch.setattr(sinks, "FOLD_DELTAS", 3)
    want, opened = {}, None
    for batch in range(11):
        rows = [(f"k{(batch * 3 + i) % 10}", batch * 10 + i) for i in range(4)]
        want |= dict(rows)
        df = spark.createDataFrame(rows, "k string, x int")
        if crash and batch in (2, 5):
            name, at = ("merged_on_read", sinks) if crash == "before" else ("delete", paths)

            def fail(*args):
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(at, name, fail)
                try:
                    write(df, batch)
                except RuntimeError:
                    pass
        write(df, batch)
        write(df, batch)
        if batch == 8:
            assert opened.count() == 10  # its files are there after one more fold
        assert {r.k: r.x for r in sinks.latest_of(spark, path, keys).collect()} == want
        if batch == 7:
            opened = sinks.latest_of(spark, path, keys)
    assert len([n for n in parts_of(spark, path) if n.startswith("base")]) <= 2
    spark.createDataFrame([("k0", -1)], "k string, x int").write.parquet(f"{path}/delta-99")
    paths.delete(spark, f"{path}/delta-99/_SUCCESS")  # a batch that stopped while it was written
    assert {r.k: r.x for r in sinks.latest_of(spark, path, keys).collect()} == want


def test_unknown_topics_are_set_aside(spark):
    out = work_dir(spark, "t")
    write = sinks.dispatch({"x": lambda df: df}, "topic", f"{out}/data", f"{out}/dead")
    write(spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "topic string, n int"), 0)
    assert sorted(r.n for r in sinks.rows_of(spark, f"{out}/dead").collect()) == [2, 3]


def test_console_and_trigger(spark):
    path, out = work_dir(spark, "t"), work_dir(spark, "t")
    add_file(spark, path, [("A", at(1), 1.0, 1)], TICKS)
    live = sources.parquet_folder(spark, path, spark.createDataFrame([], TICKS).schema)
    sinks.to_console(live).awaitTermination()
    q = sinks.start(live, sinks.batch_folder(f"{out}/d"), f"{out}/c", every_seconds=1)
    q.processAllAvailable()
    q.stop()
    assert sinks.rows_of(spark, f"{out}/d").count() == 1


def envelopes(spark, names):
    quoted = json.dumps([{"ticker": "A", "relevance_score": "1", "ticker_sentiment_score": "0.5", "ticker_sentiment_label": "Bullish"}])
    docs = spark.createDataFrame([(n, n, day, quoted) for n, day in names], "_id string, title string, time_published string, ticker_sentiment string")
    return art.to_envelope(docs, F.col("_id"), F.lit("2024-01-01").cast("timestamp"))


def test_sql_batches_survive_repetition_and_duplicates(spark):
    base = work_dir(spark, "t")
    n = news_stream_job
    one = envelopes(spark, [("m1", "20240101T000000"), ("m2", "20240101T010000"), ("m1", "20240101T000000")])
    two = envelopes(spark, [("m2", "20240101T010000"), ("m3", "20240101T020000"), ("m4", "20240102T000000"), ("m5", "never")])
    for i, batch in enumerate([one, one, two, two]):
        n.process_batch(batch, i, base)
    ids = sorted(r.message_id for r in n.table(spark, base, n.NEWS, n.NEWS_DDL).collect())
    assert ids == ["m1", "m2", "m3", "m4"]
    assert n.table(spark, base, n.MAPPING, n.MAPPING_DDL).count() == 4
    daily = {str(r.date): r for r in n.table(spark, base, n.DAILY, n.DAILY_DDL).collect()}
    assert {d: r.news_count for d, r in daily.items()} == {"2024-01-01": 3, "2024-01-02": 1}
    assert (daily["2024-01-01"].created_batch, daily["2024-01-01"].updated_batch) == (0, 3)


@pytest.mark.parametrize("done", [1, 2, 3])
def test_a_batch_that_failed_between_its_writes_is_made_up_for(spark, done, monkeypatch):
    base, n, writes = work_dir(spark, "t"), news_stream_job, []
    batch = envelopes(spark, [("m1", "20240101T000000"), ("m2", "20240102T000000")])

    def failing(*args, **kwargs):
        if len(writes) == done:
            raise RuntimeError("lost")
        writes.append(lake.write_lake(*args, **kwargs))

    monkeypatch.setattr(n, "write_lake", failing)
    with pytest.raises(RuntimeError):
        n.process_batch(batch, 0, base)
    monkeypatch.undo()
    other = envelopes(spark, [("m1", "20240103T000000"), ("m3", "20240101T000000")])
    n.process_batch(other, 0, base, "other")  # another stream meets what the first had begun
    n.process_batch(batch, 0, base)
    for name, ddl in ((n.NEWS, n.NEWS_DDL), (n.MAPPING, n.MAPPING_DDL)):
        assert n.table(spark, base, name, ddl).count() == 3
    daily = {str(r.date): r.news_count for r in n.table(spark, base, n.DAILY, n.DAILY_DDL).collect()}
    assert daily == {"2024-01-01": 2, "2024-01-02": 1}


def test_an_id_is_stored_once_whatever_its_day(spark):
    base, n = work_dir(spark, "t"), news_stream_job
    n.process_batch(envelopes(spark, [("m1", "20240101T000000")]), 0, base)
    n.process_batch(envelopes(spark, [("m1", "20240102T000000"), ("m2", "20240102T000000")]), 1, base)
    both = envelopes(spark, [("m3", "20240105T000000"), ("m3", "20240104T000000")])
    n.process_batch(both, 2, base)
    news = {r.message_id: str(r.date) for r in n.table(spark, base, n.NEWS, n.NEWS_DDL).collect()}
    assert news == {"m1": "2024-01-01", "m2": "2024-01-02", "m3": "2024-01-04"}
    mapped = n.table(spark, base, n.MAPPING, n.MAPPING_DDL)
    assert sorted(str(r.date) for r in mapped.collect()) == sorted(news.values())


def test_only_the_days_of_a_batch_are_read(spark):
    base, n = work_dir(spark, "t"), news_stream_job
    n.process_batch(envelopes(spark, [(f"m{i}", f"202401{i + 1:02d}T000000") for i in range(9)]), 0, base)
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 5)]
    some = n.days_of(n.table(spark, base, n.MAPPING, n.MAPPING_DDL), days)
    assert some.count() == 2
    rows = some.select("ticker", "date")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().get("numPartitions").get().value() == 2


def test_lake_stream_keeps_undated_rows_apart(spark):
    out = work_dir(spark, "t")
    rows = n_rows = news_stream_job.lake_rows(envelopes(spark, [("m1", "20240101T000000"), ("m2", "soon")]))
    write = sinks.lake(f"{out}/lake", dead_path=f"{out}/dead")
    write(rows, 0)
    write(n_rows, 0)
    assert spark.read.parquet(f"{out}/lake").count() == 1
    assert [r.message_id for r in spark.read.parquet(f"{out}/dead").collect()] == ["m2"]


def test_bad_json_goes_to_the_dead_letters(spark):
    raw = ['{"ticker":"A","t":1}', '{"ticker":"A",', "{'ticker':'A'}", None, "", '{"t":3}']
    df = sources.decoded(spark.createDataFrame([(v,) for v in raw], "value string"), schemas.OHLC)
    assert [r.ticker for r in sources.valid(df, "ticker").collect()][0] == "A"
    good, bad = sources.valid(df, "ticker").count(), sources.malformed(df, "ticker").count()
    assert good + bad == len(raw) and bad >= 3


def test_work_dir_needs_a_shared_folder(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("granularity, folder", [("day", "date=1970-01-01"), ("week", "year=1970/week=1"), ("month", "year=1970/month=01")])
def test_export_layout(spark, granularity, folder):
    out = work_dir(spark, "t")
    bars = candles.enrich_bars(spark.createDataFrame(days(1), BARS), now=F.timestamp_millis("t"))
    lo, hi = F.lit("1970-01-01").cast("timestamp"), F.lit("1970-01-01 01:00:00").cast("timestamp")
    lake.export_bars(bars, out, lo, hi, granularity)
    assert paths.exists(spark, f"{out}/ohlc/{folder}")
    assert spark.read.parquet(f"{out}/ohlc").count() == 2


def test_routed_sink_counts_and_keeps_unknown_types(spark):
    path = work_dir(spark, "t")
    rows = tables.routed(spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "kind string, n int"), F.col("kind"), {"a": "as"})
    assert tables.write_routed(rows, f"{path}/data", dead_path=f"{path}/dead") == 3
    assert [tuple(r) for r in spark.read.parquet(f"{path}/data").select("n", "collection").collect()] == [(1, "as")]
    assert sorted(r.n for r in spark.read.parquet(f"{path}/dead").collect()) == [2, 3, 4]


@pytest.mark.parametrize("parts", [1, 3])
def test_a_stream_of_a_table_of_one_file_or_a_folder_of_parts(spark, parts):
    """F1-F4, F6: a table that was a folder gave a stream without rows."""
    folder, out = work_dir(spark, "t"), work_dir(spark, "t")
    spark.range(90).repartition(parts).write.parquet(f"{folder}/whole.parquet")
    spark.range(5).write.parquet(f"{folder}/other.parquet")
    path = f"{folder}/whole.parquet"
    if parts == 1:
        path = f"{path}/" + next(n for n in paths.children(spark, path) if n.startswith("part-"))
    sinks.drain(sources.parquet_table(spark, path), sinks.batch_folder(f"{out}/d"), f"{out}/c")
    assert sorted(r.id for r in sinks.rows_of(spark, f"{out}/d").collect()) == list(range(90))


def test_a_landing_folder_is_written_without_a_shuffle(spark, monkeypatch):
    """the rows of a batch were shuffled on their way into the landing folder, and again when they were published."""
    plans = []
    monkeypatch.setattr(lake, "spread_by", lambda df, *partitions: plans.append(partitions) or df.hint("rebalance", *partitions))
    path = work_dir(spark, "t")
    rows = spark.range(60).selectExpr("id", "date_add(date'2024-01-01', cast(id % 3 as int)) as ingest_date")
    for _ in range(2):
        sinks.lake(f"{path}/landing")(rows, 7)
    assert plans == []
    lake.publish_days(spark, f"{path}/landing", f"{path}/lake", "2024-01-01", "2024-02-01")
    assert plans == [("ingest_date",)]
    assert sorted(r.id for r in spark.read.parquet(f"{path}/lake").collect()) == list(range(60))


def test_bundles_are_put_in_their_places_by_tasks(spark, monkeypatch):
    """the driver moved every bundle's file by itself."""
    from pyspark.sql import DataFrameWriter

    told, option = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, key, value: told.update({key: value}) or option(self, key, value))
    path = work_dir(spark, "t")
    for _ in range(2):
        tables.write_json_bundles(spark.range(300), path, 200)
    assert told["mapreduce.fileoutputcommitter.algorithm.version"] == "2" and paths.exists(spark, f"{path}/_SUCCESS")
    assert sorted(r.id for r in spark.read.json(path).select("id").collect()) == list(range(300))


@pytest.mark.parametrize("name", ["str5_news_enrichment", "str7_sent_once"])
def test_articles_are_streamed_from_a_table_of_parts(spark, name):
    """without rows these queries had no output folder to read and failed."""
    folder, docs = work_dir(spark, "t"), [(i, f"text {i}", "en", "src0", 6) for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES[name](Views(spark, folder))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT i AS doc_id, 'text ' || i AS text, 'en' AS lang, 'src0' AS source, 6 AS n_chars FROM range(40) t(i)")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE[name]).fetchall())
