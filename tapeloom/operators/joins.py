"""As-of and range joins, key lookups and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# Exchange name to market identifier code.
EXCHANGE_MIC = {
    "NASDAQ": "XNAS", "NYSE": "XNYS", "AMEX": "XASE", "BATS": "BATS", "Toronto": "XTSE",
    "Toronto Ventures": "XTSX", "London": "XLON", "XETRA": "XETR", "Berlin": "XBER",
    "Frankfurt": "XFRA", "Munich": "XMUN", "Stuttgart": "XSTU", "Paris": "XPAR",
    "Barcelona": "XBAR", "Madrid": "XMAD", "Lisbon": "XLIS", "Tokyo": "XTKS", "NSE": "XNSE",
    "BSE": "XBOM", "Shanghai": "XSHG", "Shenzhen": "XSHE", "Hong Kong": "XHKG",
    "Sao Paolo": "BVMF", "Mexico": "XMEX", "Johannesburg": "XJSE", "Global": "FOREX",
}


def exchange_mic(name: Column) -> Column:
    """Code of an exchange, NULL when unknown. The table is fixed, so it travels as a literal."""
    pairs = [F.lit(x) for pair in EXCHANGE_MIC.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def _nearest(
    points: DataFrame, t: str, events: DataFrame, reach: Column, span_ms: int, forward: bool, payload: Column
) -> DataFrame:
    """Points with ``_found``: the payload of the nearest event ahead of or behind them.

    Time is cut into slices of ``span_ms`` and each event is also placed in the slice from
    which a point could look at it, so (ticker, slice) holds all a point can need; within it
    one pass carries the nearest event to the points. No pairs are formed, and a hot ticker
    is split by time. Events at a point's own time qualify in both directions. What lies
    farther away than ``span_ms`` may or may not be found: callers drop it.
    """
    span = F.lit(span_ms)
    home = F.floor(reach / span)
    right = events.select(
        "ticker", F.explode(F.array(home, home - 1 if forward else home + 1)).alias("_slice"),
        reach.alias("_at"), F.lit(0).alias("_kind"), payload.alias("_event"),
    )
    left = points.select(
        "ticker", F.floor(F.col(t) / span).alias("_slice"), F.col(t).alias("_at"), F.lit(1).alias("_kind"),
        F.struct(*[F.col(c) for c in points.columns]).alias("_point"),
    )
    order = F.desc("_at") if forward else F.asc("_at")
    w = W.partitionBy("ticker", "_slice").orderBy(order, "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn("_found", F.last("_event", ignorenulls=True).over(w)).filter(F.col("_kind") == 1)


def next_bar(
    points: DataFrame, bars: DataFrame, t: str = "t", gap_ms: int = 1000, horizon_ms: int = 7 * DAY_MS,
    fields=("t", "o", "h", "l", "c", "v"), prefix: str = "next_",
) -> DataFrame:
    """For every point the first bar of its ticker in ``[t + gap, t + horizon]``, as ``next_*``.

    Points without such a bar keep NULLs.
    """
    payload = F.struct(*[F.col(f) for f in fields])
    # A bar qualifies for a point at p when bar.t - gap >= p.
    found = _nearest(points, t, bars, F.col("t") - gap_ms, horizon_ms, True, payload)
    within = F.col("_found.t") <= F.col("_at") + horizon_ms
    return found.select("_point.*", *[F.when(within, F.col("_found")[f]).alias(f"{prefix}{f}") for f in fields])


def last_bar(
    points: DataFrame, bars: DataFrame, t: str = "t", span_ms: int = 30 * DAY_MS,
    fields=("t", "o", "h", "l", "c", "v"), prefix: str = "last_",
) -> DataFrame:
    """For every point the newest bar of its ticker in ``[t - span, t]``, as ``last_*``."""
    payload = F.struct(*[F.col(f) for f in fields])
    found = _nearest(points, t, bars, F.col("t"), span_ms, False, payload)
    within = F.col("_found.t") >= F.col("_at") - span_ms
    return found.select("_point.*", *[F.when(within, F.col("_found")[f]).alias(f"{prefix}{f}") for f in fields])


def look_back(targets: DataFrame, bars: DataFrame, span_ms: int, value: str) -> DataFrame:
    """Per target the bars in ``[target_t - span, target_t]``: number, first and last time, mean of ``value``.

    No pairs are formed. Time is cut into slices of the span, so a look-back is the part of
    its own slice up to the target, a running aggregate, and the end of the slice before: a
    copy of each bar one span later lies in the target's slice, and what has not passed the
    target, a running aggregate from the back, is still inside. Targets without a bar are
    left out.
    """
    span = F.lit(span_ms)
    home = F.floor(F.col("t") / span)
    events = bars.select(
        "ticker", "t", F.col(value).cast("double").alias("_x"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("t").alias("at"), home.alias("slice")),
            F.struct(F.lit(1).alias("kind"), (F.col("t") + span).alias("at"), (home + 1).alias("slice")),
        )).alias("_p"),
    ).select("ticker", "t", "_x", "_p.*")
    points = targets.select(
        "ticker", F.lit(2).alias("kind"), F.col("target_t").alias("at"), F.floor(F.col("target_t") / span).alias("slice"),
        F.struct(*targets.columns).alias("_target"),
    )
    w = W.partitionBy("ticker", "slice")
    frames = {
        0: w.orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0),
        1: w.orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0),
    }
    parts = {"n": F.count, "lo": F.min, "hi": F.max}
    both = events.unionByName(points, allowMissingColumns=True)
    seen = both.select("*", *[
        f(F.when(F.col("kind") == k, F.col(c))).over(frame).alias(f"_{name}{k}")
        for k, frame in frames.items()
        for name, f, c in [*((p, f, "t") for p, f in parts.items()), ("s", F.sum, "_x"), ("nx", F.count, "_x")]
    ]).filter((F.col("kind") == 2) & (F.col("_n0") + F.col("_n1") > 0))

    def total(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}0"), F.lit(0)) + F.coalesce(F.col(f"_{name}1"), F.lit(0))

    return seen.select(
        "_target.*", total("n").alias("bars"), F.least("_lo0", "_lo1").alias("first_t"), F.greatest("_hi0", "_hi1").alias("last_t"),
        (total("s") / F.nullif(total("nx"), F.lit(0))).alias(f"mean_{value}"),
    )


def last_close_at_or_before(targets: DataFrame, bars: DataFrame, span_ms: int = 30 * DAY_MS) -> DataFrame:
    """Reference price of each target: the newest close of its look-back; targets without one are left out."""
    found = last_bar(targets, bars, "target_t", span_ms, ("t", "c"))
    return found.filter(F.col("last_t").isNotNull()).select(
        *targets.columns, F.col("last_c").alias("reference_close"), F.col("last_t").alias("reference_t")
    )


Check = tuple[str, DataFrame, str, DataFrame, str]


def _groups(checks: list[Check], side: int) -> list[tuple[DataFrame, dict[str, list[str]]]]:
    """The tables of one side of the checks, each once, with the names of the checks by column."""
    out: list[tuple[DataFrame, dict[str, list[str]]]] = []
    for check in checks:
        columns = next((c for t, c in out if t is check[side]), None)
        if columns is None:
            columns = {}
            out.append((check[side], columns))
        columns.setdefault(check[side + 1], []).append(check[0])
    return out


def _counted(table: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(foreign_key, key, rows) of a child: each column counted in its own type, all in one pass; its counts become text."""
    n = len(columns)
    only = {c: (1 << n) - 1 ^ 1 << (n - 1 - i) for i, c in enumerate(columns)}  # the grouping id of a column by itself
    if n == 1:
        found = table.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("_g"))
        only = dict.fromkeys(columns, 0)
    else:
        found = table.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
            F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_g"))
    key = F.coalesce(*[F.when(F.col("_g") == only[c], F.col(c).cast("string")) for c in columns])
    names = F.coalesce(*[F.when(F.col("_g") == only[c], F.array(*map(F.lit, names))) for c, names in columns.items()])
    return found.select(key.alias("key"), "rows", names.alias("_names")).filter("key IS NOT NULL").select(
        F.explode("_names").alias("foreign_key"), "key", "rows")


def _known(table: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(foreign_key, key) of a parent, read once for all checks that look into it."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("foreign_key"), F.col(c).cast("string").alias("key")) for c, names in columns.items() for name in names])
    return table.select(F.explode(entries).alias("_e")).select("_e.*").filter(F.col("key").isNotNull())


def orphan_report(checks: list[Check]) -> DataFrame:
    """One row per foreign key (name, child, its column, parent, its column): orphaned key values, orphaned rows.

    Children are counted per key first: a hot key crosses the network as one row per task.
    An outer join with a filter keeps that order; an anti join would be moved below the
    count. Checks on the same DataFrame share its scan.
    """
    counted = reduce(DataFrame.unionByName, [_counted(*x) for x in _groups(checks, 1)])
    known = reduce(DataFrame.unionByName, [_known(*x) for x in _groups(checks, 3)]).withColumn("_known", F.lit(True))
    orphaned = counted.join(known, ["foreign_key", "key"], "left").filter(F.col("_known").isNull())
    found = orphaned.groupBy("foreign_key").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("rows").alias("orphan_rows"))
    names = found.sparkSession.createDataFrame([(c[0],) for c in checks], "foreign_key string")
    return names.join(found, "foreign_key", "left").na.fill(0, ["orphan_keys", "orphan_rows"])


def in_latest_snapshot(df: DataFrame, snapshots: DataFrame, key: str = "ticker", at: str = "time_update") -> DataFrame:
    """Rows whose key is in the newest snapshot."""
    return df.join(latest_snapshot(snapshots, at).select(key), key, "left_semi")


def latest_snapshot(snapshots: DataFrame, at: str = "time_update") -> DataFrame:
    return snapshots.filter(F.col(at) == snapshots.agg(F.max(at)).scalar())
