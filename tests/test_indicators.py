"""Indicators against numbers worked out by hand and against plain loops."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators, slices
from tapeloom.streaming import state, timed

START = 1_700_000_000_000
HOUR = 3_600_000


def bars_of(spark, closes, ticker="AAPL"):
    rows = [(ticker, START + i * HOUR, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, t long, c double")


def by_time(df):
    return [r.asDict() for r in df.orderBy("ticker", "t").collect()]


@pytest.fixture(scope="module")
def rising(spark):
    return by_time(indicators.all_indicators(bars_of(spark, [150.5 + i / 2 for i in range(30)])))


def test_rising_series(rising):
    last = rising[-1]
    # Closes are 150.5 .. 165.0; the last twenty are 155.5 .. 165.0.
    assert last["sma_20"] == 160.25
    assert last["sma_50"] is None and last["ema_50"] is None
    assert last["rsi_14"] == 100.0
    assert last["price_change"] == 0.5
    assert last["price_change_pct"] == 0.3
    assert last["macd_line"] == pytest.approx(last["signal_line"] + last["histogram"], abs=0.011)


def test_history_gates(rising):
    first_with = {k: next(i for i, r in enumerate(rising) if r[k] is not None) for k in (
        "sma_20", "ema_20", "rsi_14", "macd_line", "price_change", "volatility")}
    assert first_with == {
        "sma_20": 19, "ema_20": 19, "rsi_14": 14, "macd_line": 25, "price_change": 1, "volatility": 19}


def test_ema_is_seeded_by_the_oldest_close_of_its_window(spark):
    closes = [float(x) for x in [10, 11, 9, 14, 13, 8, 17, 12, 15, 11] * 3]
    got = by_time(indicators.exponential_averages(bars_of(spark, closes), (20,)))[-1]["ema_20"]
    m, ema = 2 / 21, closes[-20]
    for x in closes[-19:]:
        ema = x * m + ema * (1 - m)
    assert got == pytest.approx(round(ema, 2))


def test_rsi_and_volatility_against_loops(spark):
    rng = random.Random(3)
    closes = [100 + rng.uniform(-5, 5) for _ in range(40)]
    got = by_time(indicators.all_indicators(bars_of(spark, closes)))
    for i in (14, 20, 39):
        deltas = [closes[j] - closes[j - 1] for j in range(i - 13, i + 1)]
        gain, loss = sum(d for d in deltas if d > 0), -sum(d for d in deltas if d < 0)
        assert got[i]["rsi_14"] == pytest.approx(100 - 100 / (1 + gain / loss), abs=0.006)
    rets = [closes[j] / closes[j - 1] - 1 for j in range(21, 40)]
    assert got[39]["volatility"] == pytest.approx(statistics.pstdev(rets), abs=6e-5)


def test_zero_previous_close(spark):
    got = by_time(indicators.all_indicators(bars_of(spark, [0, 5, 6])))
    assert got[1]["price_change_pct"] == 0.0 and got[2]["price_change_pct"] == 20.0


@pytest.mark.parametrize("slice_ms", [HOUR, 3 * HOUR, 7 * HOUR, 60 * HOUR])
def test_slices_change_nothing(spark, slice_ms):
    """One ticker with far more rows than the others, cut into slices down to one row."""
    rng = random.Random(5)
    rows = [("HOT", START + i * HOUR, 50 + rng.random()) for i in range(150) if rng.random() < 0.8]
    rows += [(f"T{k}", START + i * HOUR, 10 + rng.random()) for k in range(3) for i in range(0, 60, k + 1)]
    bars = spark.createDataFrame(rows, "ticker string, t long, c double")
    assert by_time(indicators.all_indicators(bars, slice_ms)) == by_time(indicators.all_indicators(bars, 10**15))


def test_array_form_equals_window_form(spark):
    rng = random.Random(9)
    bars = bars_of(spark, [100 + rng.uniform(-9, 9) for _ in range(70)])
    from pyspark.sql import Window as W

    w = W.partitionBy("ticker").orderBy("t").rowsBetween(-49, 0)
    arrays = bars.withColumn("closes", F.collect_list("c").over(w))
    expected = indicators.all_indicators(bars)
    assert by_time(state.indicators_of(arrays).select(expected.columns)) == by_time(expected)


def test_trailing_windows_against_brute_force(spark):
    """Ticks with equal times, window edges hit exactly, and one hot ticker."""
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(400):
        ticker = "HOT" if rng.random() < 0.7 else f"T{k % 3}"
        at = base + dt.timedelta(seconds=rng.choice([rng.randrange(1800), 60 * rng.randrange(30)]))
        rows.append((ticker, at, k, round(rng.uniform(1, 9), 2), rng.randrange(5)))
    ticks = spark.createDataFrame(rows, "ticker string, ts timestamp, event_id long, price double, volume long")
    got = slices.trailing_stats(ticks, (120, 300)).collect()
    assert len(got) == 2 * len(rows)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for g in got:
        inside = [
            r for r in ordered
            if r[0] == g.ticker and (r[1], r[2]) <= (g.ts, g.event_id)
            and r[1] > g.ts - dt.timedelta(seconds=g.window_s)
        ]
        prices = [r[3] for r in inside]
        assert g.data_points == len(inside)
        assert g.avg_price == pytest.approx(sum(prices) / len(prices))
        assert (g.max_price, g.min_price) == (max(prices), min(prices))
        assert (g.first_price, g.last_price) == (prices[0], prices[-1])
        assert g.total_volume == pytest.approx(sum(r[4] for r in inside))


def test_window_must_be_whole_buckets(spark):
    ticks = spark.createDataFrame([], "ticker string, ts timestamp, event_id long, price double, volume long")
    with pytest.raises(ValueError):
        slices.trailing_stats(ticks, (90,))


@pytest.mark.parametrize("base", [0.0, 1e9])
def test_prior_totals_against_loops(spark, base):
    """A large mean does not swallow the deviations."""
    rng = random.Random(2)
    rows = [("HOT" if rng.random() < 0.7 else "B", i, base + rng.uniform(-1, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    for r in slices.prior_totals(df, "k", ["i"], "x", F.floor(F.col("i") / 16)).collect():
        earlier = [x for k, i, x in rows if k == r.k and i < r.i]
        assert r.hist_n == len(earlier)
        assert (r.hist_mean is None) == (not earlier)
        if earlier:
            assert r.hist_mean == pytest.approx(statistics.fmean(earlier), abs=1e-6)
            assert r.hist_m2 == pytest.approx(statistics.pvariance(earlier) * len(earlier), abs=1e-4)
        assert (r.hist_lo, r.hist_hi) == ((min(earlier), max(earlier)) if earlier else (None, None))


def anomaly(spark, history, current):
    rows = [("A", i, float(x)) for i, x in enumerate([*history, current])]
    df = spark.createDataFrame(rows, "ticker string, i int, score double")
    out = indicators.sentiment_anomalies(df, "ticker", ["i"], "score", F.floor(F.col("i") / 4))
    return out.orderBy(F.desc("i")).first()


def test_anomalies(spark):
    history = [0.1, 0.15, 0.12, 0.18, 0.14, 0.11, 0.16, 0.13, 0.17, 0.12]
    r = anomaly(spark, history, 0.8)
    mean, sd = statistics.mean(history), statistics.pstdev(history)
    assert r.is_anomaly and r.direction == "spike" and r.reason is None
    assert r.z_score == pytest.approx((0.8 - mean) / sd, abs=0.006)
    assert (r.avg_sentiment, r.std_dev) == (pytest.approx(mean, abs=6e-5), pytest.approx(sd, abs=6e-5))
    assert anomaly(spark, history[:9], 0.8).reason == "insufficient_history"
    assert anomaly(spark, [0.1] * 12, 0.8).reason == "no_variance"
    assert anomaly(spark, history, -0.8).direction == "drop"
    assert not math.isnan(r.z_score)


def test_state_processor_needs_no_package_on_the_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = tmp_path / "processor"
    blob.write_bytes(cloudpickle.dumps(timed.CloseHistory(5, 3)))
    code = f"import pickle; p = pickle.load(open({str(blob)!r}, 'rb')); print(p.keep, p.emit)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip().endswith("5 3"), done.stderr
