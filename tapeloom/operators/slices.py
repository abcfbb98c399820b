"""Windows over one series that may hold a third of all rows.

``Window.partitionBy(ticker)`` puts a whole ticker into one task. The helpers here cut a
series into time slices, so that a hot ticker spreads over as many tasks as it has slices,
and give each slice exactly what it needs of its past:

* ``with_halo``       the last k rows before the slice      (row frames)
* ``prior_totals``    running totals before the slice       (unbounded frames)
* ``trailing_stats``  the trailing time window of every row (range frames)
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE, HALO = "_slice", "_halo"


def with_halo(df: DataFrame, key: str, order: Sequence[str], rows: int, slice_of: Column) -> DataFrame:
    """Add ``_slice`` and, to each slice, copies (``_halo`` true) of the ``rows`` rows before it.

    ``slice_of`` must not decrease along ``order``. A row frame of up to ``rows`` preceding
    rows over (key, _slice) then equals the same frame over the whole key, wherever
    ``_halo`` is false. Only the last rows of each slice are copied: the rank filter is
    applied before their shuffle, and the step that sees a whole key sees nothing else.
    """
    sliced = df.withColumn(SLICE, slice_of)
    latest_first = W.partitionBy(key, SLICE).orderBy(*[F.desc(c) for c in order])
    tails = sliced.withColumn("_back", F.row_number().over(latest_first)).filter(F.col("_back") <= rows).drop("_back")
    # A slice needs a row exactly if it begins within the next ``rows`` rows of the tails.
    ahead = W.partitionBy(key).orderBy(*order).rowsBetween(1, rows)
    later = F.array_except(F.collect_set(SLICE).over(ahead), F.array(SLICE))
    halo = tails.withColumn("_later", later).withColumn(SLICE, F.explode("_later")).drop("_later")
    return sliced.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def sliced_window(key: str, order: Sequence[str]):
    return W.partitionBy(key, SLICE).orderBy(*order)


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(SLICE, HALO)


def _merged_moments(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two sets together."""
    n = a[0] + b[0]
    whole = F.when(n > 0, n)
    gap = b[1] - a[1]
    return n, a[1] + F.coalesce(gap * b[0] / whole, F.lit(0.0)), a[2] + b[2] + F.coalesce(gap * gap * a[0] * b[0] / whole, F.lit(0.0))


def prior_totals(
    df: DataFrame, key: str, order: Sequence[str], value: str, slice_of: Column, prefix: str = "hist"
) -> DataFrame:
    """Count, mean, sum of squared deviations (m2), min and max of all earlier rows of the key.

    Totals per slice are partially aggregated; the running merge over slices sees one row
    per slice; only the running aggregate inside a slice sees rows. Deviations are taken
    from means, never as squares less squares, so a large mean does not swallow them.
    """
    v = F.col(value)
    zero = F.lit(0.0)
    sliced = df.withColumn(SLICE, slice_of)
    per_slice = sliced.groupBy(key, SLICE).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    whole, earlier = W.partitionBy(key), W.partitionBy(key).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    # Distances of the slices' means from the mean of the whole key.
    centre = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole)
    centred = per_slice.withColumn("centre", centre).withColumn("d", F.col("mean") - F.col("centre"))
    n, nd = F.sum("n").over(earlier), F.sum(F.col("n") * F.col("d")).over(earlier)
    squares = F.sum(F.col("m2") + F.col("n") * F.col("d") * F.col("d")).over(earlier)
    carried = centred.select(
        key, SLICE, F.coalesce(n, F.lit(0)).alias("_c_n"),
        F.coalesce(F.col("centre") + nd / n, zero).alias("_c_mean"),
        F.coalesce(F.greatest(squares - nd * nd / n, zero), zero).alias("_c_m2"),
        F.min("lo").over(earlier).alias("_c_lo"), F.max("hi").over(earlier).alias("_c_hi"),
    )
    inside = sliced_window(key, order).rowsBetween(W.unboundedPreceding, -1)
    rows = sliced.select(
        "*", F.count(v).over(inside).alias("_i_n"), F.coalesce(F.avg(v).over(inside), zero).alias("_i_mean"),
        F.coalesce(F.var_pop(v).over(inside) * F.count(v).over(inside), zero).alias("_i_m2"),
        F.min(v).over(inside).alias("_i_lo"), F.max(v).over(inside).alias("_i_hi"),
    )
    joined = rows.join(carried, [key, SLICE])
    before, own = (tuple(F.col(f"_{side}_{p}") for p in ("n", "mean", "m2")) for side in "ci")
    n, mean, m2 = _merged_moments(before, own)
    return joined.select(
        *df.columns, n.alias(f"{prefix}_n"), F.when(n > 0, mean).alias(f"{prefix}_mean"), m2.alias(f"{prefix}_m2"),
        F.least("_i_lo", "_c_lo").alias(f"{prefix}_lo"), F.greatest("_i_hi", "_c_hi").alias(f"{prefix}_hi"),
    )


def _covers(seconds: int, bucket: int) -> int:
    if seconds % bucket:
        raise ValueError(f"window of {seconds} s is no multiple of the {bucket} s bucket")
    return seconds // bucket


def trailing_stats(
    ticks: DataFrame,
    windows: Sequence[int],
    key: str = "ticker",
    ts: str = "ts",
    tie: str = "event_id",
    price: str = "price",
    volume: str = "volume",
    bucket: int = 60,
) -> DataFrame:
    """Statistics of ``(ts - W, ts]`` for every tick and every W seconds in ``windows``.

    Ticks are in the order of (``ts``, ``tie``): of those of the same time a window holds the ones up to its own.

    A sliding frame would revisit every tick of its window for every tick. Instead the axis
    is cut into buckets, and a window is the sum of three parts, each of linear cost:

    1. ticks of its own bucket up to itself: a running aggregate;
    2. whole buckets between: per-bucket totals, a frame of at most W / bucket rows;
    3. the end of the bucket it starts in: every tick is copied W seconds ahead, where it
       lands in the bucket of the ticks whose window it leaves, and a running aggregate from
       the back gives what is still inside.

    Work is spread over (key, bucket), so a hot key is split by time.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    size = bucket * 1_000_000
    start_of = lambda at: at - F.pmod(at, F.lit(size))
    base = ticks.withColumn("_us", us)
    p, v = F.col(price), F.col(volume).cast("double")

    copies = F.array(*[F.lit(w).cast("long") for w in (0, *windows)])
    placed = (
        base.withColumn("_w", F.explode(copies))
        .withColumn("_at", F.col("_us") + F.col("_w") * 1_000_000)
        .withColumn("_b", start_of(F.col("_at")))
    )
    group = W.partitionBy(key, "_b")
    upto = group.orderBy("_at", "_w", tie).rowsBetween(W.unboundedPreceding, 0)
    # From the back; own rows come first among equals, so a copy at exactly ts is left out.
    after = group.orderBy(F.desc("_at"), F.asc("_w"), F.desc(tie)).rowsBetween(W.unboundedPreceding, 0)

    def running(w: int, frame, first: Column, tag: str) -> list[Column]:
        mine = F.col("_w") == w
        return [
            F.count(F.when(mine, p)).over(frame).alias(f"n{tag}"),
            F.sum(F.when(mine, p)).over(frame).alias(f"s{tag}"),
            F.max(F.when(mine, p)).over(frame).alias(f"hi{tag}"),
            F.min(F.when(mine, p)).over(frame).alias(f"lo{tag}"),
            F.sum(F.when(mine, v)).over(frame).alias(f"v{tag}"),
            first.over(frame).alias(f"f{tag}"),
        ]

    own_first = F.first(F.when(F.col("_w") == 0, p), ignorenulls=True)
    columns = running(0, upto, own_first, "_own")
    for w in windows:
        oldest = F.last(F.when(F.col("_w") == w, p), ignorenulls=True)
        columns += running(w, after, oldest, f"_{w}")
    edges = placed.select("*", *columns).filter(F.col("_w") == 0)

    totals = (
        base.withColumn("_b", start_of(F.col("_us")))
        .groupBy(key, "_b")
        .agg(
            F.count(p).alias("n"), F.sum(p).alias("s"), F.max(p).alias("hi"), F.min(p).alias("lo"),
            F.sum(v).alias("v"), F.min_by(p, F.struct(F.col("_us"), F.col(tie))).alias("f"),
        )
    )
    between = []
    for w in windows:
        frame = W.partitionBy(key).orderBy("_b").rangeBetween(-(_covers(w, bucket) - 1) * size, -1)
        combine = {"n": F.sum, "s": F.sum, "hi": F.max, "lo": F.min, "v": F.sum, "f": F.first}
        between += [f(x).over(frame).alias(f"{x}_mid{w}") for x, f in combine.items()]
    middle = totals.select(key, "_b", *between)

    joined = edges.join(middle, [key, "_b"])

    def add(x: str, w: int) -> Column:
        terms = [F.coalesce(F.col(c), F.lit(0)) for c in (f"{x}_{w}", f"{x}_mid{w}", f"{x}_own")]
        return reduce(lambda a, b: a + b, terms)

    def stats(w: int) -> Column:
        n = add("n", w)
        first = F.coalesce(F.col(f"f_{w}"), F.col(f"f_mid{w}"), F.col("f_own"))
        return F.struct(
            F.lit(w).alias("window_s"),
            n.alias("data_points"),
            (add("s", w) / n).alias("avg_price"),
            F.greatest(f"hi_{w}", f"hi_mid{w}", "hi_own").alias("max_price"),
            F.least(f"lo_{w}", f"lo_mid{w}", "lo_own").alias("min_price"),
            first.alias("first_price"),
            p.alias("last_price"),
            add("v", w).alias("total_volume"),
        )

    return joined.select(
        *ticks.columns, F.explode(F.array(*[stats(w) for w in windows])).alias("_stats")
    ).select(*ticks.columns, "_stats.*")
