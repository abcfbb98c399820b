"""Stream operators that act when event time passes, against plain computations."""

import datetime as dt
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from tapeloom.session import work_dir
from tapeloom.streaming import batches, sinks, sources, timed

TICKS = "ticker string, at timestamp, event_id long, price double, volume long"
BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


class Stream:
    """A folder that grows file by file, and a stream over it that goes on where it stopped."""

    def __init__(self, spark, process, mode="append", keys=None):
        self.spark, self.process, self.mode = spark, process, mode
        self.path, self.out = work_dir(spark, "t"), work_dir(spark, "t")
        self.keys = keys
        self.sink = sinks.latest_table(f"{self.out}/d", keys) if keys else sinks.batch_folder(f"{self.out}/d")

    def send(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(self.path)
        schema = self.spark.createDataFrame([], TICKS).schema
        live = sources.parquet_folder(self.spark, self.path, schema, max_files=1)
        sinks.drain(self.process(live), self.sink, f"{self.out}/c", self.mode)
        return sinks.latest_of(self.spark, f"{self.out}/d", self.keys) if self.keys else sinks.rows_of(self.spark, f"{self.out}/d")


def shuffled(rng, n, tickers, span, lateness, files):
    """Ticks in files, each tick in one file with those that arrive with it, up to `lateness` seconds late."""
    rows = [(rng.choice(tickers), rng.choice([rng.randrange(span), 60 * rng.randrange(span // 60)]), i) for i in range(n)]
    ticks = sorted(((t + rng.randrange(lateness), (k, at(t), i, round(rng.uniform(1, 9), 2), rng.randrange(5))) for k, t, i in rows), key=lambda x: x[0])
    size = -(-len(ticks) // files)
    return [[row for _, row in ticks[i : i + size]] for i in range(0, len(ticks), size)]


def closing(seconds):
    return [(None, at(seconds), None, None, None)]


def test_windows_of_every_tick_and_history_in_event_time(spark, monkeypatch):
    """Out of order, equal times, edges hit exactly, a hot ticker, more ticks than an answer holds."""
    monkeypatch.setattr(timed, "ANSWER_ROWS", 37)
    files = shuffled(random.Random(5), 400, ["HOT"] * 5 + ["A", "B"], 4000, 500, 5)
    ticks = sorted((r for f in files for r in f), key=lambda r: (r[1], r[2]))
    widths = (60, 900)
    windows = Stream(spark, lambda live: timed.trailing_windows(live, widths, ts="at"))
    got = {(r.event_id, r.window_s): r for r in windows.send(*files, closing(9000)).collect()}
    assert len(got) == len(ticks) * 2 and not any(r.late for r in got.values())
    for i, (ticker, t, event, price, volume) in enumerate(ticks):
        for w in widths:
            inside = [x for x in ticks[: i + 1] if x[0] == ticker and x[1] > t - dt.timedelta(seconds=w)]
            prices, r = [x[3] for x in inside], got[event, w]
            assert (r.ticker, r.data_points, r.min_price, r.max_price, r.first_price, r.last_price, r.total_volume) == (
                ticker, len(inside), min(prices), max(prices), prices[0], price, sum(x[4] for x in inside))
            assert r.avg_price == pytest.approx(statistics.fmean(prices))
    history = Stream(spark, lambda live: timed.close_history(
        live.select("ticker", "at", F.col("event_id").alias("c")), 10, 3, ts="at"))
    got = {}
    for r in history.send(*files, closing(9000)).collect():
        got[r.ticker, int(r.c)] = list(r.closes)
    for ticker in ("HOT", "A", "B"):
        own = [float(r[2]) for r in ticks if r[0] == ticker]
        assert [got[ticker, int(x)] for x in own] == [own[max(0, i - 2) : i + 1] for i in range(len(own))]


def test_rows_behind_the_watermark_are_left_out_and_counted(spark):
    stream = Stream(spark, lambda live: timed.running_moments(live, "ticker", "price", "at", "event_id"))
    rows = stream.send(
        [("A", at(0), 1, 2.0, 0), ("A", at(60), 3, 6.0, 0)], [("A", at(30), 2, 4.0, 0), ("A", at(1200), 4, 5.0, 0)],
        [("A", at(5), 9, 100.0, 0), ("A", at(700), 5, 8.0, 0)], closing(9000)).orderBy("us").collect()
    assert [(r.value, r.tie, r.hist_n) for r in rows if r.late] == [(100.0, 9, None)]
    rows = [r for r in rows if not r.late]
    assert [(r.value, r.hist_n, r.hist_lo, r.hist_hi) for r in rows] == [
        (2.0, 0, None, None), (4.0, 1, 2.0, 2.0), (6.0, 2, 2.0, 4.0), (8.0, 3, 2.0, 6.0), (5.0, 4, 2.0, 8.0)]
    values = [r.value for r in rows]
    for i, r in enumerate(rows[2:], 2):
        assert r.hist_mean == pytest.approx(statistics.fmean(values[:i]))
        assert r.hist_m2 == pytest.approx(statistics.pvariance(values[:i]) * i)


def test_values_expire_without_new_ones(spark):
    """A removal in silence, a renewal before the end, an older tick that changes nothing, and a restart between all."""
    stream = Stream(spark, lambda live: timed.expiring_latest(live, "price", "at", "event_id", 300), "update", ["ticker"])

    def live(rows):
        return {r.ticker: (r.value, r.us // 1_000_000 - int(BASE.replace(tzinfo=dt.timezone.utc).timestamp()))
                for r in rows.filter("live").collect()}

    rows = stream.send([("A", at(0), 1, 1.0, 0), ("B", at(10), 2, 2.0, 0), ("A", at(0), 3, 1.5, 0)])
    assert live(rows) == {"A": (1.5, 0), "B": (2.0, 10)}
    rows = stream.send([("A", at(200), 4, 3.0, 0), ("A", at(150), 5, 9.0, 0), (None, at(309), None, None, None)])
    assert live(rows) == {"A": (3.0, 200), "B": (2.0, 10)}
    assert live(stream.send(closing(310))) == {"A": (3.0, 200)}  # B's time is up exactly now
    rows = stream.send([("B", at(320), 6, 4.0, 0)], closing(600))
    assert live(rows) == {"B": (4.0, 320)} and rows.count() == 2


@pytest.mark.parametrize("ascending", [False, True])
def test_a_board_is_refreshed_in_silence(spark, ascending):
    stream = Stream(spark, lambda live: timed.refreshed_board(
        live, "price", "at", "event_id", 3, 300, ascending=ascending, parts=3), "update", ["part"])
    rng = random.Random(2)
    ticks = [(f"T{i % 11}", at(10 * i), i, float(rng.randrange(6)), 0) for i in range(60)]

    def expected(now):
        latest = {k: (p, t) for k, t, _, p, _ in ticks}
        live = [(p, k) for k, (p, t) in latest.items() if t + dt.timedelta(seconds=300) > at(now - now % 60)]
        return [(k, p) for p, k in sorted(live, reverse=not ascending)[:3]]

    def board(parts):
        rows = timed.merged_board(parts, "price", 3, ascending).collect()
        return [(r.ticker, r.price) for r in rows]

    assert board(stream.send(ticks[:30], ticks[30:], closing(650))) == expected(650) and len(expected(650)) == 3
    assert board(stream.send(closing(845))) == expected(845)
    parts = stream.send(closing(2000))
    assert board(parts) == expected(2000) == []
    assert parts.filter("at % 60000 <> 0").count() == 0


def test_batches_close_by_rows_or_age_and_go_on_in_the_middle_of_a_file(spark, tmp_path):
    folder, out, sent = tmp_path / "in", tmp_path / "out", []
    folder.mkdir()

    def add(name, n):
        lines = [f"{name} {i} é" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (n % 2))
        (tmp_path / name).rename(folder / name)
        sent.extend(lines)

    def run(seconds):
        live = batches.message_batches(spark, str(folder), str(out / "log"), 100, seconds)
        query = sinks.start(live, sinks.batch_folder(f"{out}/d"), f"{out}/c", every_seconds=0)
        query.processAllAvailable()
        query.stop()
        rows = spark.read.parquet(f"{out}/d").collect()
        assert len({r.value for r in rows}) == len(rows)
        sizes = {}
        for r in rows:
            sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
        return [sizes[k] for k in sorted(sizes)], {r.value for r in rows}

    add("b", 150)
    add("a", 71)
    assert run(3600) == ([100, 100], set(sent[:200]))  # 21 rows wait
    add("c", 90)
    assert run(3600) == ([100] * 3, set(sent[:300]))
    assert run(3600)[0] == [100] * 3
    assert run(0) == ([100, 100, 100, 11], set(sent))
    add("d", 100)
    assert run(3600) == ([100, 100, 100, 11, 100], set(sent))


def test_full_batches_that_wait_go_together_and_are_read_from_their_place(spark, tmp_path, monkeypatch):
    """each trigger took one batch and read its file from the beginning."""
    monkeypatch.setattr(batches, "MARK", 16)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    lines = [f"{'é' * (i % 7)}{i}" for i in range(1030)]
    for name, some in (("a", lines[:333]), ("b", lines[333:])):
        (folder / name).write_text("\n".join(some) + "\n")
        time.sleep(0.01)
    reader = batches.MessageReader({"path": str(folder), "log": str(out / "x"), "rows": "50", "seconds": "3600", "together": "4"})
    ends = [batches.START]
    while (end := reader.latestOffset()) != ends[-1]:
        ends.append(dict(end))
    assert [e["batch"] for e in ends] == [0, 4, 8, 12, 16, 20]
    pieces = [p for a, b in zip(ends, ends[1:], strict=False) for p in reader.partitions(a, b)]
    assert all((p.seek > 0) == (p.first >= 16) for p in pieces)
    assert [row for p in pieces for row in reader.read(p)] == [(line, i // 50) for i, line in enumerate(lines[:1000])]

    live = batches.message_batches(spark, str(folder), str(out / "log"), 50, 0, together=4)
    query = sinks.start(live, sinks.batch_folder(f"{out}/d"), f"{out}/c", every_seconds=0)
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(f"{out}/d").collect()
    assert {(r.value, r.batch) for r in rows} == {(line, i // 50) for i, line in enumerate(lines)}
    assert len({r.batch_id for r in rows}) == 6
