"""Queries over ticks and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import prices
from tapeloom.functions.rounding import half_up
from tapeloom.operators import candles, documents, indicators, joins, ranking
from tapeloom.queries.registry import ORACLE, query
from tapeloom.session import work_dir
from tapeloom.sinks import page_directory
from tapeloom.views import BARS, BATCH_END, BATCH_START, DAILY, FILLED, RETURNS, TICKS, Views, r

_W = "PARTITION BY ticker ORDER BY t"


def _ema(p: int, x: str = "c") -> str:
    m = 2.0 / (p + 1)
    frame = f"({_W} ROWS {p - 1} PRECEDING)"
    fold = f"list_reduce(list({x}) OVER {frame}, lambda e, y: y * {m!r} + e * {1 - m!r})"
    return f"CASE WHEN count({x}) OVER {frame} = {p} THEN {r(fold, 2)} END"


def _sma(p: int) -> str:
    frame = f"({_W} ROWS {p - 1} PRECEDING)"
    return f"CASE WHEN count(c) OVER {frame} = {p} THEN {r(f'avg(c) OVER {frame}', 2)} END"


_RSI_FRAME = f"({_W} ROWS 13 PRECEDING)"
_DELTAS = f"deltas AS (SELECT *, c - lag(c) OVER ({_W}) AS delta, lag(c) OVER ({_W}) AS prev FROM bars)"
_GAIN = f"sum(greatest(delta, 0)) OVER {_RSI_FRAME}"
_LOSS = f"sum(greatest(-delta, 0)) OVER {_RSI_FRAME}"
_RSI = (
    f"CASE WHEN count(delta) OVER {_RSI_FRAME} = 14 THEN CASE WHEN {_LOSS} = 0 THEN 100.0 "
    f"ELSE {r(f'100 - 100 / (1 + {_GAIN} / nullif({_LOSS}, 0))', 2)} END END"
)
_RET = "CASE WHEN prev <> 0 THEN (c - prev) / prev END"
_VOL_FRAME = f"({_W} ROWS 18 PRECEDING)"
_VOL = (
    f"CASE WHEN count({_RET}) OVER {_VOL_FRAME} = 19 "
    f"THEN {r(f'stddev_pop({_RET}) OVER {_VOL_FRAME}', 4)} END"
)
_CHANGE = r("c - prev", 2)
_CHANGE_PCT = f"CASE WHEN prev = 0 THEN 0.0 ELSE {r('(c - prev) / prev * 100', 2)} END"
_MACD_CTE = (
    f"averages AS (SELECT *, {_ema(26)} AS slow, "
    f"CASE WHEN count(c) OVER ({_W} ROWS 25 PRECEDING) = 26 THEN {_ema(12)} END AS fast FROM deltas)"
)
_MACD = (
    f"{r('fast - slow', 2)} AS macd_line, {r('(fast - slow) * 0.9', 2)} AS signal_line, "
    f"{r('(fast - slow) - (fast - slow) * 0.9', 2)} AS histogram"
)


@query(
    "indicators_all",
    f"WITH {BARS}, {_DELTAS}, {_MACD_CTE} SELECT ticker, t, c, {_sma(20)} AS sma_20, {_sma(50)} AS sma_50, "
    f"{_ema(20)} AS ema_20, {_ema(50)} AS ema_50, {_RSI} AS rsi_14, {_MACD}, {_CHANGE} AS price_change, "
    f"{_CHANGE_PCT} AS price_change_pct, {_VOL} AS volatility FROM averages",
)
def indicators_all(v: Views):
    return indicators.all_indicators(v.bars.select("ticker", "t", "c"))


@query("win1_sma", f"WITH {BARS} SELECT ticker, t, c, {_sma(20)} AS sma_20, {_sma(50)} AS sma_50 FROM bars")
def win1(v: Views):
    return indicators.moving_averages(v.bars.select("ticker", "t", "c"))


@query("win2_ema", f"WITH {BARS} SELECT ticker, t, c, {_ema(20)} AS ema_20, {_ema(50)} AS ema_50 FROM bars")
def win2(v: Views):
    return indicators.exponential_averages(v.bars.select("ticker", "t", "c"))


@query("win3_rsi14", f"WITH {BARS}, {_DELTAS} SELECT ticker, t, c, {_RSI} AS rsi_14 FROM deltas")
def win3(v: Views):
    return indicators.rsi(v.bars.select("ticker", "t", "c"))


@query("win4_macd", f"WITH {BARS}, {_DELTAS}, {_MACD_CTE} SELECT ticker, t, c, {_MACD} FROM averages")
def win4(v: Views):
    return indicators.macd(v.bars.select("ticker", "t", "c"))


@query(
    "win5_price_change",
    f"WITH {BARS}, {_DELTAS} SELECT ticker, t, c, {_CHANGE} AS price_change, {_CHANGE_PCT} AS price_change_pct FROM deltas",
)
def win5(v: Views):
    return indicators.price_change(v.bars.select("ticker", "t", "c"))


@query("win6_volatility", f"WITH {BARS}, {_DELTAS} SELECT ticker, t, c, {_VOL} AS volatility FROM deltas")
def win6(v: Views):
    return indicators.volatility(v.bars.select("ticker", "t", "c"))


def _filled_cols(src: str) -> str:
    return f"SELECT ticker, d, {', '.join(f'{r(x, 4)} AS {x}' for x in 'ohlcv')} FROM {src}"


@query("prj16_bar_metadata", f"WITH {BARS} SELECT ticker, t, ticker AS named, t AS at, TRUE AS stamped FROM bars")
def prj16_bars(v: Views):
    m = F.col("metadata")
    return candles.enrich_bars(v.bars).select(
        "ticker", "t", m["ticker"].alias("named"), m["timestamp"].alias("at"), m["processing_time"].isNotNull().alias("stamped"))


@query("win7_gap_fill", f"WITH {FILLED} {_filled_cols('filled')}")
def win7(v: Views):
    filled = candles.fill_calendar(v.daily)
    return filled.select("ticker", "d", *[half_up(F.col(x), 4).alias(x) for x in "ohlcv"])


@query(
    "win8_percent_returns",
    f"WITH {RETURNS} SELECT ticker, d, {', '.join(f'{r(x + "_ret", 6)} AS {x}_ret' for x in 'ohlcv')} FROM returns",
)
def win8(v: Views):
    returns = candles.percent_returns(candles.fill_calendar(v.daily))
    return returns.select("ticker", "d", *[half_up(F.col(f"{x}_ret"), 6).alias(f"{x}_ret") for x in "ohlcv"])


def _trailing_sql(select) -> str:
    """Ticks in the order of (ts, event_id) as one number: a window ends with the tick itself, not with others of its time."""
    parts, scale = [], "9223372036854775808::HUGEINT"
    for seconds, name in indicators.WINDOW_NAMES.items():
        frame = (
            f"(PARTITION BY ticker ORDER BY epoch_us(ts) * {scale} + event_id RANGE BETWEEN "
            f"{seconds * 1_000_000 - 1} * {scale} + event_id PRECEDING AND CURRENT ROW)"
        )
        parts.append(f"SELECT ticker, t, event_id, {select(frame, name, seconds)} FROM ticks")
    return f"WITH {TICKS} " + " UNION ALL ".join(parts)


@query(
    "win9_trailing_window",
    _trailing_sql(
        lambda f, name, s: f"CAST({s} AS INTEGER) AS window_s, count(*) OVER {f} AS data_points, "
        f"first_value(price) OVER {f} AS first_price, price AS last_price"
    ),
)
def win9(v: Views):
    from tapeloom.operators.slices import trailing_stats

    s = trailing_stats(v.ticks, tuple(indicators.WINDOW_NAMES))
    return s.select("ticker", "t", "event_id", "window_s", "data_points", "first_price", "last_price")


def _agg9(f: str, name: str, _: int) -> str:
    n, first = f"count(*) OVER {f}", f"first_value(price) OVER {f}"
    return (
        f"'{name}' AS \"window\", {r(f'avg(price) OVER {f}', 4)} AS avg_price, max(price) OVER {f} AS max_price, "
        f"min(price) OVER {f} AS min_price, {r(f'CASE WHEN {n} > 1 THEN price - {first} ELSE 0 END', 4)} AS price_change, "
        f"{r(f'CASE WHEN {n} > 1 AND {first} <> 0 THEN (price - {first}) / {first} * 100 ELSE 0 END', 4)} AS price_change_pct, "
        f"CAST(sum(volume) OVER {f} AS DOUBLE) AS total_volume, {n} AS data_points"
    )


@query("agg9_window_statistics", _trailing_sql(_agg9))
def agg9(v: Views):
    s = indicators.window_statistics(v.ticks)
    return s.select(
        "ticker", "t", "event_id", "window", half_up(F.col("avg_price"), 4).alias("avg_price"), "max_price",
        "min_price", half_up(F.col("price_change"), 4).alias("price_change"),
        half_up(F.col("price_change_pct"), 4).alias("price_change_pct"), "total_volume", "data_points",
    )


@query(
    "win13_bounded_history",
    f"WITH {BARS} SELECT ticker, t, c, rn AS recency FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY t DESC) AS rn FROM bars) q WHERE rn <= 200",
)
def win13(v: Views):
    return indicators.recent_history(v.bars.select("ticker", "t", "c")).withColumn(
        "recency", F.col("recency").cast("long")
    )


# Roll-ups ---------------------------------------------------------------------------------

def _rollup_sql(keys: str, change: bool) -> str:
    tail = (
        f", {r('close - open', 2)} AS price_change, CASE WHEN open = 0 THEN 0.0 ELSE "
        f"{r('(close - open) / open * 100', 2)} END AS price_change_pct" if change else ""
    )
    return (
        f"WITH {BARS}, rolled AS (SELECT {keys}, min(t) AS start_timestamp, max(t) AS end_timestamp, min_by(o, t) AS open, "
        f"max(h) AS high, min(l) AS low, max_by(c, t) AS close, sum(v) AS volume, count(*) AS bar_count, "
        f"{r('avg(c)', 2)} AS avg_price FROM bars GROUP BY ALL) SELECT *{tail} FROM rolled"
    )


@query("agg7_ohlc_rollup", _rollup_sql("ticker, t // 14400000 AS period", True))
def agg7(v: Views):
    return candles.roll_up(v.bars, ["ticker", F.floor(F.col("t") / F.lit(14_400_000)).alias("period")])


@query("agg8_ohlc_window", _rollup_sql("ticker, t - t % 86400000 AS window_start", False))
def agg8(v: Views):
    window = F.window(F.timestamp_millis("t"), "1 day")
    rolled = candles.roll_up(v.bars, ["ticker", window.alias("w")])
    return rolled.withColumn("window_start", F.unix_millis("w.start")).drop("w", "price_change", "price_change_pct")


@query(
    "agg11_daily_resample",
    f"WITH {BARS} SELECT ticker, ingest_date AS d, min_by(o, t) AS o, max(h) AS h, min(l) AS l, max_by(c, t) AS c, "
    f"sum(v) AS v FROM bars GROUP BY ticker, ingest_date",
)
def agg11(v: Views):
    return candles.daily_bars(v.bars)


@query(
    "agg13_bar_coverage",
    f"WITH {BARS} SELECT ticker, count(*) AS bars, min(t) AS first_t, min_by(c, t) AS first_close, max(t) AS latest_t, "
    f"max_by(c, t) AS latest_close FROM bars WHERE t >= 1704672000000 AND t <= 1705276800000 GROUP BY ticker",
)
def agg13(v: Views):
    return candles.bar_coverage(v.bars, 1704672000000, 1705276800000)


# Projections ------------------------------------------------------------------------------

@query(
    "prj1_candle_fact_projection",
    f"WITH {BARS} SELECT ticker, ingest_date, coalesce(v, 0) AS candle_volume, {r('coalesce(vw, 0)', 4)} AS candle_volume_weighted, "
    f"o AS candle_open, c AS candle_close, h AS candle_high, l AS candle_low, n AS candle_num_of_trades FROM bars",
)
def prj1(v: Views):
    f = candles.candle_facts(v.lake_bars)
    return f.select(
        "ticker", "ingest_date", "candle_volume", half_up(F.col("candle_volume_weighted"), 4).alias("candle_volume_weighted"),
        "candle_open", "candle_close", "candle_high", "candle_low", "candle_num_of_trades",
    )


@query(
    "prj2_candle_shape",
    f"WITH {BARS} SELECT ticker, t, {r('h - greatest(o, c)', 4)} AS upper_wick, {r('least(o, c) - l', 4)} AS lower_wick, "
    f"{r('abs(c - o)', 4)} AS body_size, c > o AS is_bullish, {r('(h + l + c) / 3', 4)} AS typical_price, "
    f"{r('CASE WHEN n > 0 THEN v / n ELSE 0 END', 4)} AS avg_trade_size FROM bars",
)
def prj2(v: Views):
    s = candles.shape_columns(v.bars, prefix="")
    num = ("upper_wick", "lower_wick", "body_size", "typical_price", "avg_trade_size")
    return s.select("ticker", "t", "is_bullish", *[half_up(F.col(x), 4).alias(x) for x in num])


@query(
    "prj3_fill_nulls",
    f"WITH {BARS} SELECT ticker, t, {r('coalesce(vw, 0)', 4)} AS vw, coalesce(CASE WHEN c > o THEN 'up' END, 'Unknown') AS move FROM bars",
)
def prj3(v: Views):
    b = v.bars.select("ticker", "t", half_up(F.col("vw"), 4).alias("vw"), F.when(F.col("c") > F.col("o"), "up").alias("move"))
    return b.na.fill(0).na.fill("Unknown")


@query(
    "prj8_ohlc_documents",
    f"WITH {BARS} SELECT concat(ticker, '_', t) AS _id, ticker, t, o, h, l, c, v, CAST(1706572800 AS BIGINT) AS time_update FROM bars",
)
def prj8(v: Views):
    return candles.bar_documents(v.bars, F.lit(1706572800))


@query(
    "prj13_drop_and_cast",
    f"WITH {BARS} SELECT CAST(ticker AS VARCHAR) AS ticker, t, o, h, l, c, v, n FROM bars",
)
def prj13(v: Views):
    landed = v.bars.withColumn("timestamp", F.timestamp_millis("t"))
    return documents.drop_if_present(landed, "timestamp", "vw").withColumn("ticker", F.col("ticker").cast("string"))


# Filters ----------------------------------------------------------------------------------

@query(
    "flt4_find_bars",
    f"WITH {BARS} SELECT ticker, t, o, h, l, c, v FROM bars WHERE ticker = 'T3' AND t >= 1704672000000 AND t <= 1705276800000",
)
def flt4(v: Views):
    return documents.find_bars(v.bars, "T3", 1704672000000, 1705276800000).select("ticker", "t", *"ohlcv")


@query(
    "flt7_junk_tickers",
    f"WITH {BARS}, days AS (SELECT ticker, ingest_date AS d, max_by(c, t) AS c FROM bars GROUP BY ticker, ingest_date) "
    f"SELECT ticker, d, c FROM days WHERE ticker NOT IN (SELECT ticker FROM days WHERE c <= 1.0)",
)
def flt7(v: Views):
    return candles.drop_junk_tickers(candles.daily_bars(v.bars), 1.0).select("ticker", "d", "c")


_PCT = f"CASE WHEN o > 0 THEN {r('(c - o) / o * 100', 2)} ELSE 0 END"


@query(
    "flt10_price_alerts",
    f"WITH {BARS}, e AS (SELECT *, {_PCT} AS pct FROM bars) SELECT ticker, t, 'SIGNIFICANT_PRICE_CHANGE' AS alert_type, "
    f"abs(pct) AS price_change_pct, c AS close_price, concat('Alert: ', ticker, ' moved ', CAST(CAST(abs(pct) AS DECIMAL(18,2)) AS VARCHAR), '%') AS message "
    f"FROM e WHERE abs(pct) > 3",
)
def flt10(v: Views):
    return candles.price_alerts(candles.enrich_bars(v.bars))


@query(
    "set1_bars_with_alerts",
    f"WITH {BARS}, e AS (SELECT *, {_PCT} AS pct FROM bars) "
    f"SELECT ticker, t, 'bar' AS record_type, pct, NULL AS alert_type, NULL AS message FROM e UNION ALL "
    f"SELECT ticker, t, 'alert', pct, 'SIGNIFICANT_PRICE_CHANGE', concat('Alert: ', ticker, ' moved ', "
    f"CAST(CAST(abs(pct) AS DECIMAL(18,2)) AS VARCHAR), '%') FROM e WHERE abs(pct) > 3",
)
def set1(v: Views):
    out = candles.bars_with_alerts(candles.enrich_bars(v.bars))
    return out.select(
        "ticker", "t", "record_type", F.col("technical_indicators.price_change_pct").alias("pct"), "alert_type", "message"
    )


# Scalars of a bar -------------------------------------------------------------------------

@query(
    "scl5_range_and_change",
    f"WITH {BARS} SELECT ticker, t, {r('h - l', 2)} AS price_range, CASE WHEN c > 0 THEN {r('(h - l) / c * 100', 2)} ELSE 0 END AS price_range_pct, "
    f"{r('c - o', 2)} AS price_change, {_PCT} AS price_change_pct FROM bars",
)
def scl5(v: Views):
    e = prices.range_indicators(*[F.col(x) for x in "ohlc"])
    return v.bars.select("ticker", "t", *[x.alias(k) for k, x in e.items()])


@query(
    "scl6_volatility_flag",
    f"WITH {BARS} SELECT ticker, t, CASE WHEN c <> 0 AND (h - l) / c * 100 > 5 THEN 'high' ELSE 'normal' END AS volatility_indicator FROM bars",
)
def scl6(v: Views):
    return v.bars.select("ticker", "t", prices.volatility_flag(*[F.col(x) for x in "hlc"]).alias("volatility_indicator"))


@query(
    "scl7_trend",
    f"WITH {BARS} SELECT ticker, t, CASE WHEN c > o THEN 'bullish' WHEN c < o THEN 'bearish' ELSE 'neutral' END AS trend FROM bars",
)
def scl7(v: Views):
    return v.bars.select("ticker", "t", prices.trend(F.col("o"), F.col("c")).alias("trend"))


@query(
    "scl8_high_low_ratio",
    f"WITH {BARS} SELECT ticker, t, CASE WHEN l > 0 THEN {r('h / l', 4)} ELSE 0 END AS high_low_ratio FROM bars",
)
def scl8(v: Views):
    return v.bars.select("ticker", "t", prices.high_low_ratio(F.col("h"), F.col("l")).alias("high_low_ratio"))


@query("scl9_notional", f"WITH {BARS} SELECT ticker, t, {r('(h + l + c) / 3 * v', 2)} AS notional FROM bars")
def scl9(v: Views):
    return v.bars.select("ticker", "t", prices.notional(*[F.col(x) for x in "hlcv"]).alias("notional"))


@query(
    "scl28_alert_text",
    f"WITH {BARS} SELECT ticker, t, concat('Alert: ', ticker, ' moved ', CAST(CAST(abs({_PCT}) AS DECIMAL(18,2)) AS VARCHAR), '%') AS message FROM bars",
)
def scl28(v: Views):
    pct = prices.pct_of_positive(F.col("c") - F.col("o"), F.col("o"))
    return v.bars.select("ticker", "t", prices.alert_message(F.col("ticker"), pct).alias("message"))


@query(
    "scl29_rounding",
    f"WITH {BARS} SELECT ticker, t, {r('(h + l + c) / 3', 2)} AS two, {r('(h + l + c) / 3', 4)} AS four FROM bars",
)
def scl29(v: Views):
    x = prices.typical_price(*[F.col(c) for c in "hlc"])
    return v.bars.select("ticker", "t", half_up(x, 2).alias("two"), half_up(x, 4).alias("four"))


# Ranking ----------------------------------------------------------------------------------

_BOARD = f"WITH {BARS}, e AS (SELECT ticker, t, {_PCT} AS pct, v FROM bars), latest AS (SELECT ticker, max_by(pct, t) AS change_pct, max_by(v, t) AS volume FROM e GROUP BY ticker) "


@query(
    "top3_leaderboards",
    _BOARD + "SELECT * FROM (SELECT 'gainers' AS board, ticker, change_pct AS value FROM latest ORDER BY change_pct DESC, ticker DESC LIMIT 5) a "
    "UNION ALL SELECT * FROM (SELECT 'losers', ticker, change_pct FROM latest ORDER BY change_pct, ticker LIMIT 5) b "
    "UNION ALL SELECT * FROM (SELECT 'volume', ticker, volume FROM latest ORDER BY volume DESC, ticker DESC LIMIT 5) c",
)
def top3(v: Views):
    e = v.bars.select("ticker", "t", "v", prices.pct_of_positive(F.col("c") - F.col("o"), F.col("o")).alias("pct"))
    boards = [("gainers", "pct", False), ("losers", "pct", True), ("volume", "v", False)]
    return ranking.leaderboards(e, boards, "t", 5)


@query(
    "top4_page",
    f"WITH {BARS} SELECT CAST(3 AS BIGINT) AS page_id, CAST(ceil((SELECT count(*) FROM bars) / 500.0) AS BIGINT) AS page_count, ticker, t, c FROM bars ORDER BY t, ticker LIMIT 500 OFFSET 1000",
)
def top4(v: Views):
    return ranking.page(v.bars.select("ticker", "t", "c"), ["t", "ticker"], 3, candles.day_of(F.col("t")), 500)


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    "top4_deep_page",
    f"WITH place AS (SELECT CAST(count(*) * 3 // 4000 AS BIGINT) AS page_id, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS page_count FROM lineitem), ranked AS (SELECT {_LINE}, row_number() OVER (ORDER BY {_LINE}) AS pos FROM lineitem) SELECT page_id, page_count, {_LINE} FROM ranked, place WHERE pos > (page_id - 1) * 1000 AND pos <= page_id * 1000",
)
def top4_deep(v: Views):
    """A page three quarters of the way through the largest table."""
    lines = v.table("lineitem").select(*_LINE.split(", "))
    return ranking.page(lines, lines.columns, lines.count() * 3 // 4000, F.floor(F.col("l_orderkey") / 64))


@query("top4_stored_page", ORACLE["top4_deep_page"])
def top4_stored(v: Views):
    """The same page from a copy in page order, of which only the files that hold it are opened."""
    lines = v.table("lineitem").select(*_LINE.split(", "))
    path = work_dir(v.spark, "pages")
    page_directory.write_pages(lines, path, lines.columns, rows_per_part=20_000)
    return page_directory.read_page(v.spark, path, lines.columns, lines.count() * 3 // 4000)


@query("agg12_page_count", f"WITH {BARS} SELECT count(*) AS documents, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS page_count FROM bars")
def agg12(v: Views):
    n = F.count(F.lit(1))
    return v.bars.agg(n.alias("documents"), F.ceil(n / F.lit(1000)).alias("page_count"))


@query(
    "top7_first_per_timestamp",
    f"WITH {TICKS} SELECT ticker, t, price FROM (SELECT ticker, t - t % 60000 AS t, price, row_number() OVER (PARTITION BY ticker, t - t % 60000 ORDER BY event_id) AS rn FROM ticks) q WHERE rn = 1",
)
def top7(v: Views):
    minute = v.ticks.select("ticker", (F.col("t") - F.col("t") % 60_000).alias("t"), "price", "event_id")
    return candles.first_per_timestamp(minute, "event_id").drop("event_id")


@query(
    "str8_live_latest",
    f"WITH {TICKS} SELECT * FROM (SELECT ticker, max_by(price, ts) AS price, max(t) AS t FROM ticks GROUP BY ticker) q WHERE t > (SELECT max(t) FROM ticks) - 3600 * 1000",
)
def str8(v: Views):
    live = ranking.live_latest(
        v.ticks.withColumn("at", F.timestamp_millis("t")), "price", "at",
        v.ticks.agg(F.timestamp_millis(F.max("t"))).scalar(), 3600,
    )
    return live.select("ticker", "price", F.unix_millis("at").alias("t"))


# Joins over time --------------------------------------------------------------------------

@query(
    "joi8_next_bar",
    f"WITH {DAILY}, x AS (SELECT ticker, epoch_ms(CAST(d AS TIMESTAMP)) AS t, c, lead(d) OVER w AS nd, lead(c) OVER w AS nc FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d)) "
    f"SELECT ticker, t, {r('c', 4)} AS c, CASE WHEN epoch_ms(CAST(nd AS TIMESTAMP)) <= t + 604800000 THEN epoch_ms(CAST(nd AS TIMESTAMP)) END AS next_t, "
    f"CASE WHEN epoch_ms(CAST(nd AS TIMESTAMP)) <= t + 604800000 THEN {r('nc', 4)} END AS next_c FROM x",
)
def joi8(v: Views):
    bars = v.daily_t
    found = joins.next_bar(bars.select("ticker", "t", "c"), bars, fields=("t", "c"))
    return found.select("ticker", "t", half_up(F.col("c"), 4).alias("c"), "next_t", half_up(F.col("next_c"), 4).alias("next_c"))


_TARGETS = "targets AS (SELECT ticker, max(t) - 1 AS target_t FROM bars GROUP BY ticker, ingest_date)"


@query(
    "joi9_look_back",
    f"WITH {BARS}, {_TARGETS} SELECT a.ticker, target_t, count(*) AS bars, min(b.t) AS first_t, max(b.t) AS last_t, {r('avg(b.c)', 4)} AS mean_close "
    f"FROM targets a JOIN bars b ON a.ticker = b.ticker AND b.t BETWEEN a.target_t - 604800000 AND a.target_t GROUP BY a.ticker, target_t",
)
def joi9(v: Views):
    targets = v.lake_bars.groupBy("ticker", "ingest_date").agg((F.max("t") - 1).alias("target_t")).drop("ingest_date")
    found = joins.look_back(targets, v.bars.select("ticker", "t", "c"), 604_800_000, "c")
    return found.withColumn("mean_close", half_up(F.col("mean_c"), 4)).drop("mean_c")


@query(
    "win14_reference_price",
    f"WITH {BARS}, {_TARGETS} SELECT a.ticker, target_t, max_by(b.c, b.t) AS reference_close, max(b.t) AS reference_t FROM targets a "
    f"JOIN bars b ON a.ticker = b.ticker AND b.t BETWEEN a.target_t - 2592000000 AND a.target_t GROUP BY a.ticker, target_t",
)
def win14(v: Views):
    targets = v.lake_bars.groupBy("ticker", "ingest_date").agg((F.max("t") - 1).alias("target_t")).drop("ingest_date")
    return joins.last_close_at_or_before(targets, v.bars)


@query(
    "src1_date_range",
    f"WITH {BARS} SELECT ticker, t, o, h, l, c, v, n, ingest_date FROM bars WHERE ingest_date >= DATE '{BATCH_START}' AND ingest_date < DATE '{BATCH_END}'",
)
def src1(v: Views):
    from tapeloom.session import work_dir
    from tapeloom.sinks.lake import write_lake
    from tapeloom.sources.readers import lake_range

    path = work_dir(v.spark, "lake-ohlc")
    write_lake(v.lake_bars, path)
    return lake_range(v.spark, path, BATCH_START, BATCH_END).select("ticker", "t", *"ohlcv", "n", "ingest_date")
