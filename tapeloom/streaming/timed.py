"""Stateful operators that act when event time passes: ordered release, expiry, refresh.

Each keeps one event-time timer per key. Where order matters, rows that come after the
watermark has passed them change nothing and go out at once, marked ``late``, to be counted
or kept apart. A row without a value only carries time forward, so silence is told by such
rows.

All need the RocksDB state store. Only the bookkeeping runs in Python; what is derived
from the answers are the column expressions of the batch operators.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators import indicators as ind

# The processors travel to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATENESS = "10 minutes"
#: Rows of one answer to Spark.
ANSWER_ROWS = 10_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


L, D = T.LongType(), T.DoubleType()
#: A buffered row: event time in microseconds, what orders rows of the same time, and its values.
ROW = _struct(us=L, tie=L, x=D, y=D)
DUE = _struct(due=L)


class Timer:
    """The one timer of a key, remembered so that an earlier one can take its place."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.state = handle, handle.getValueState("due", DUE)

    def at(self) -> int | None:
        return self.state.get()[0] if self.state.exists() else None

    def set(self, due: int | None) -> None:
        before = self.at()
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.state.clear()
        elif before != due:
            self.handle.registerTimer(due)
            self.state.update((due,))

    def fired(self) -> None:
        self.state.clear()


class Ordered(StatefulProcessor):
    """An event-time reorder buffer: rows wait in the state until the watermark passes them, then go on in order.

    A subclass takes the rows of a key, in the order of (time, tie), from `released`. Its answers have
    the columns `columns`; `told` are those that hold time, tie and value of a late row.
    """

    columns: list[str]
    told: dict[str, str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", ROW)
        self.timer = Timer(handle)
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def released(self, key: tuple, rows: np.ndarray, until: int) -> Iterator[pd.DataFrame]:
        """Answers to rows (us, tie, x, y) up to the time `until`; later ones will be beyond it."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, passed = None, timerValues.getCurrentWatermarkInMs() * 1000
        for chunk in rows:
            chunk = chunk[chunk["x"].notna()]
            late, chunk = chunk[chunk["us"] <= passed], chunk[chunk["us"] > passed]
            if len(late):
                named = {out: late[name].to_numpy() for out, name in self.told.items()}
                if "t" in named:
                    named["t"] = named["t"] // 1000
                blank = {c: [None] * len(late) for c in self.columns}
                yield pd.DataFrame({**blank, **named, "ticker": key[0], "late": True})
            if len(chunk):
                self.pending.appendList([
                    (int(us), int(tie), float(x), float(y))
                    for us, tie, x, y in zip(chunk["us"], chunk["tie"], chunk["x"], chunk["y"], strict=True)])
                low = -(-int(chunk["us"].min()) // 1000)
                first = low if first is None else min(first, low)
        if first is not None:
            due = self.timer.at()
            self.timer.set(first if due is None else min(first, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.fired()
        held = list(self.pending.get()) if self.pending.exists() else []
        waiting = [row for row in held if row[0] > until]
        ready = np.array(sorted(tuple(row) for row in held if row[0] <= until), dtype=[("us", "i8"), ("tie", "i8"), ("x", "f8"), ("y", "f8")])
        if waiting:
            self.pending.put(waiting)
            self.timer.set(-(-min(row[0] for row in waiting) // 1000))
        else:
            self.pending.clear()
        if len(ready):
            for answer in self.released(key, ready, until):
                yield answer.assign(late=False)

    def close(self) -> None:
        pass


class CloseHistory(Ordered):
    """Hands each bar the last `emit` closes up to it; `keep` of them stay in the state."""

    columns = ["ticker", "t", "c", "closes"]
    told = {"t": "us", "c": "x"}

    def __init__(self, keep: int, emit: int):
        self.keep, self.emit = keep, emit

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.closes = handle.getListState("closes", _struct(c=D))

    def released(self, key, rows, until):
        history = [x[0] for x in self.closes.get()] if self.closes.exists() else []
        for at in range(0, len(rows), ANSWER_ROWS):
            some = rows[at : at + ANSWER_ROWS]
            known = len(history)
            history.extend(some["x"].tolist())
            ends = range(known + 1, len(history) + 1)
            yield pd.DataFrame({
                "ticker": key[0], "t": some["us"] // 1000, "c": some["x"],
                "closes": [history[max(0, e - self.emit) : e] for e in ends],
            })
            history = history[-self.keep :]
        self.closes.put([(c,) for c in history])


class TrailingWindows(Ordered):
    """For each tick the statistics of (t - W, t] for every W; the ticks of the longest window stay in the state."""

    columns = [
        "ticker", "us", "event_id", "window_s", "avg_price", "max_price", "min_price", "first_price", "last_price",
        "total_volume", "data_points",
    ]
    told = {"us": "us", "event_id": "tie", "last_price": "x"}

    def __init__(self, widths: tuple[int, ...]):
        self.widths = widths

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", ROW)

    def released(self, key, rows, until):
        recent = np.array([tuple(r) for r in self.recent.get()] if self.recent.exists() else [], dtype=rows.dtype)
        every = np.concatenate([recent, rows])
        us, price = every["us"], every["x"]
        # Sums from the first tick held: never from the beginning of the stream, so no error builds up.
        prices, volumes = (np.concatenate([[0.0], np.cumsum(every[c])]) for c in ("x", "y"))
        lows, highs = [price], [price]
        while 2 ** len(lows) <= len(every):  # extremes of 1, 2, 4, ... ticks from each
            half = 2 ** (len(lows) - 1)
            lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
            highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
        for at in range(len(recent), len(every), ANSWER_ROWS):
            i = np.arange(at, min(at + ANSWER_ROWS, len(every)))
            for width in self.widths:
                low = np.searchsorted(us, us[i] - width * 1_000_000, "right")
                n = i + 1 - low
                level = np.frexp(n.astype(float))[1] - 1
                least, most = np.empty(len(i)), np.empty(len(i))
                for k in np.unique(level):
                    some = level == k
                    a, b = low[some], i[some] + 1 - 2 ** int(k)
                    least[some] = np.minimum(lows[k][a], lows[k][b])
                    most[some] = np.maximum(highs[k][a], highs[k][b])
                yield pd.DataFrame({
                    "ticker": key[0], "us": us[i], "event_id": every["tie"][i], "window_s": np.full(len(i), width, np.int32),
                    "avg_price": (prices[i + 1] - prices[low]) / n, "max_price": most, "min_price": least,
                    "first_price": price[low], "last_price": price[i], "total_volume": volumes[i + 1] - volumes[low], "data_points": n,
                })
        kept = every[us > until - max(self.widths) * 1_000_000]
        if len(kept):
            self.recent.put(kept.tolist())
        else:
            self.recent.clear()


class Moments(Ordered):
    """For each value how many came before it, their mean, squared deviation and extremes: five numbers in the state."""

    columns = ["ticker", "us", "tie", "value", "hist_n", "hist_mean", "hist_m2", "hist_lo", "hist_hi"]
    told = {"us": "us", "tie": "tie", "value": "x"}

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", _struct(n=L, mean=D, m2=D, lo=D, hi=D))

    def released(self, key, rows, until):
        n, mean, m2, lo, hi = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, float("inf"), float("-inf"))
        for at in range(0, len(rows), ANSWER_ROWS):
            some, before = rows[at : at + ANSWER_ROWS], []
            for x in some["x"].tolist():
                before.append((n, mean, m2, lo, hi) if n else (0, None, None, None, None))
                n += 1
                step = x - mean
                mean += step / n
                m2 += step * (x - mean)
                lo, hi = min(lo, x), max(hi, x)
            told = dict(zip(("hist_n", "hist_mean", "hist_m2", "hist_lo", "hist_hi"), zip(*before, strict=True), strict=True))
            yield pd.DataFrame({"ticker": key[0], "us": some["us"], "tie": some["tie"], "value": some["x"], **told})
        self.moments.update((n, mean, m2, lo, hi))


class Expiring(StatefulProcessor):
    """The newest value per key; when its time to live has passed, a removal."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", ROW)
        self.timer = Timer(handle)

    def handleInputRows(self, key, rows, timerValues):
        known = tuple(self.newest.get()) if self.newest.exists() else None
        best, over = known, (timerValues.getCurrentWatermarkInMs() - self.ttl_ms + 1) * 1000
        for chunk in rows:
            chunk = chunk[chunk["x"].notna() & (chunk["us"] >= over)]  # the time of others is up already
            if len(chunk):
                row = chunk.sort_values(["us", "tie"]).iloc[-1]
                new = (int(row["us"]), int(row["tie"]), float(row["x"]), float(row["y"]))
                best = new if best is None or new[:2] > best[:2] else best
        if best != known:
            self.newest.update(best)
            self.timer.set(best[0] // 1000 + self.ttl_ms - 1)  # a timer fires once the watermark is beyond it
            yield pd.DataFrame({"ticker": [key[0]], "us": [best[0]], "value": [best[2]], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        row = self.newest.get()
        self.timer.fired()
        self.newest.clear()
        yield pd.DataFrame({"ticker": [key[0]], "us": [row[0]], "value": [row[2]], "live": [False]})

    def close(self) -> None:
        pass


class Board(StatefulProcessor):
    """The best live values of one part of the tickers, told anew at every refresh."""

    def __init__(self, n: int, ascending: bool, ttl_ms: int, refresh_ms: int):
        self.n, self.ascending, self.ttl_ms, self.refresh_ms = n, ascending, ttl_ms, refresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", _struct(ticker=T.StringType()), ROW)
        self.timer = Timer(handle)

    def handleInputRows(self, key, rows, timerValues):
        met = False
        for chunk in rows:
            chunk = chunk[chunk["x"].notna()]
            last = chunk.sort_values(["us", "tie"]).drop_duplicates("ticker", keep="last")
            for ticker, us, tie, x in zip(last["ticker"], last["us"], last["tie"], last["x"], strict=True):
                met, new = True, (int(us), int(tie), float(x), 0.0)
                if not self.newest.containsKey((ticker,)) or tuple(self.newest.getValue((ticker,)))[:2] < new[:2]:
                    self.newest.updateValue((ticker,), new)
        if met and self.timer.at() is None:
            now = max(timerValues.getCurrentWatermarkInMs(), 0)
            self.timer.set(now - now % self.refresh_ms + self.refresh_ms - 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        at = now - now % self.refresh_ms  # of refreshes passed at once the last
        self.timer.fired()
        live, gone = [], []
        for ticker, row in self.newest.iterator():
            (live if row[0] // 1000 + self.ttl_ms > at else gone).append((row[2], ticker[0]))
        for _, ticker in gone:
            self.newest.removeKey((ticker,))
        best = (heapq.nsmallest if self.ascending else heapq.nlargest)(self.n, live)
        if live:
            self.timer.set(at + self.refresh_ms - 1)
        yield pd.DataFrame({
            "part": [key[0]], "at": [at], "tickers": [[t for _, t in best]], "values": [[x for x, _ in best]]})

    def close(self) -> None:
        pass


def _rows(df: DataFrame, key: str, ts: str, tie: str, x: str, y: str | None, lateness: str) -> DataFrame:
    second = F.col(y).cast("double") if y else F.lit(0.0)
    at = F.col(ts).cast("timestamp")
    return df.select(
        F.col(key).alias("ticker"), at.alias("at"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("tie"),
        F.col(x).cast("double").alias("x"), F.coalesce(second, F.lit(0.0)).alias("y"),
    ).withWatermark("at", lateness)


def _processed(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, mode: str = "append") -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, out, mode, "eventTime")


def close_history(
    bars: DataFrame, keep: int = ind.HISTORY, emit: int = 50, lateness: str = LATENESS, ts: str = "ts"
) -> DataFrame:
    """Every bar with the closes up to it in event time, whatever order bars arrive in within the lateness.

    A bar goes out once the watermark has passed it; until then it waits in the state. Bars that come later
    still go out without closes, as ``late``.
    """
    rows = _rows(bars.withColumn("_tie", F.lit(0)), "ticker", ts, "_tie", "c", None, lateness)
    return _processed(rows, "ticker", CloseHistory(keep, emit), "ticker string, t long, c double, closes array<double>, late boolean")


def trailing_windows(ticks: DataFrame, widths: tuple[int, ...], lateness: str = LATENESS, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """`slices.trailing_stats` of every single tick of a stream, once the watermark has passed it."""
    out = (
        "ticker string, us long, event_id long, window_s int, avg_price double, max_price double, min_price double, "
        "first_price double, last_price double, total_volume double, data_points long, late boolean"
    )
    rows = _rows(ticks, "ticker", ts, tie, "price", "volume", lateness)
    return _processed(rows, "ticker", TrailingWindows(tuple(widths)), out)


def running_moments(scores: DataFrame, key: str, value: str, ts: str, tie: str, lateness: str = LATENESS) -> DataFrame:
    """Each value with the moments of all earlier ones of its key: (ticker, us, tie, value, hist_n … hist_hi)."""
    out = (
        "ticker string, us long, tie long, value double, hist_n long, hist_mean double, hist_m2 double, "
        "hist_lo double, hist_hi double, late boolean"
    )
    return _processed(_rows(scores, key, ts, tie, value, None, lateness), "ticker", Moments(), out)


def expiring_latest(df: DataFrame, value: str, ts: str, tie: str, ttl_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """The newest value per ticker as it changes, and a row with ``live`` false when it has outlived its time.

    For the table of the newest versions (`sinks.latest_table`, update mode): its live rows are the answer,
    without a clock where it is read. A value is gone at its time plus ``ttl_seconds``.
    """
    rows = _rows(df, "ticker", ts, tie, value, None, lateness)
    return _processed(rows, "ticker", Expiring(ttl_seconds * 1000), "ticker string, us long, value double, live boolean", "update")


def refreshed_board(
    df: DataFrame, value: str, ts: str, tie: str, n: int, ttl_seconds: int, refresh_seconds: int = 60,
    ascending: bool = False, parts: int = 16, lateness: str = "0 seconds",
) -> DataFrame:
    """The best ``n`` live tickers of each part of the tickers, at every refresh: (part, at, tickers, values).

    Tickers are dealt over ``parts`` states, each of which sends at most ``n`` rows per refresh;
    `merged_board` puts them together. Boards change without new ticks too, as values expire.
    """
    rows = _rows(df, "ticker", ts, tie, value, None, lateness)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("ticker"), F.lit(parts)).cast("int"))
    board = Board(n, ascending, ttl_seconds * 1000, refresh_seconds * 1000)
    return _processed(rows, "part", board, "part int, at long, tickers array<string>, values array<double>", "update")


def merged_board(parts: DataFrame, name: str, n: int, ascending: bool = False) -> DataFrame:
    """The best ``n`` of the newest board of every part; ties as in `ranking.leaderboard`."""
    rows = parts.select(F.explode(F.arrays_zip("tickers", "values")).alias("e")).select(
        F.col("e.tickers").alias("ticker"), F.col("e.values").alias(name))
    order = [F.asc(name), F.asc("ticker")] if ascending else [F.desc(name), F.desc("ticker")]
    return rows.orderBy(*order).limit(n)
