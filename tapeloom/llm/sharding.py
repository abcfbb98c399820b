"""Shards from a permutation of global row numbers.

Rows get the numbers 0 .. n-1, a Feistel network permutes 0 .. n-1, and the
permuted number gives shard and slot: p mod k and p div k. Shards so hold counts
at most one apart, slots are gapless, the shuffle depends on the seed alone, and
where a numbered row lies, or which number lies at a place (`at_place`), can be
computed without any table.

The network works on pairs of residues a x b with a = ceil(sqrt n), b = ceil(n / a):
fewer than a of its values lie outside 0 .. n-1. A number that lands there walks
on along its cycle until it is inside, which is again a permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import repeat_rows

ROUNDS = 6
#: Steps of a walk. A cycle has at most a-1 values outside, so this is enough for sure while a <= 64 (n <= 4096);
#: beyond, a step stays outside with a probability below 1/64, and a walk that isn't over raises an error.
WALK = 64
#: Rows that one task numbers, about.
CELL_ROWS = 1 << 18


def sides(n: int) -> tuple[int, int]:
    """The smallest a, b with a = ceil(sqrt n) and a * b >= n."""
    a = 1
    while a * a < n:
        a <<= 1
    low, high = a >> 1, a
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if middle * middle < n else (low, middle)
    a = max(1, low)
    return a, max(1, -(-n // a))


def passed(rows: DataFrame, x: str, n: int, seed: int) -> DataFrame:
    """`rows` with `x` sent once through the network, round by round as columns of one code-generated stage."""
    a, b = sides(n)
    left, right = "\u0001l", "\u0001r"
    rows = rows.withColumn(left, F.col(x) % a).withColumn(right, F.expr(f"`{x}` div {a}"))
    for i in range(ROUNDS):
        old, new, other, side = (left, f"{left}{i}", right, a) if i % 2 == 0 else (right, f"{right}{i}", left, b)
        mixed = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(other)), F.lit(side))
        rows = rows.withColumn(new, (F.col(old) + mixed) % side).drop(old)
        left, right = (new, right) if i % 2 == 0 else (left, new)
    return rows.withColumn(x, F.col(left) + F.col(right) * a).drop(left, right)


def step(x: Column, n: int, seed: int) -> Column:
    """The same pass as one expression over a struct, for the rare numbers that walk on."""
    a, b = sides(n)
    rounds = F.array(*map(F.lit, range(ROUNDS)))

    def turn(pair: Column, i: Column) -> Column:
        left, right = pair["l"], pair["r"]
        even = i % 2 == 0
        mixed = F.xxhash64(F.lit(seed), i, F.when(even, right).otherwise(left))
        return F.struct(
            F.when(even, (left + F.pmod(mixed, F.lit(a))) % a).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + F.pmod(mixed, F.lit(b))) % b).alias("r"))

    start = F.struct((x % a).cast("long").alias("l"), F.floor((x - x % a) / a).cast("long").alias("r"))
    return F.aggregate(rounds, start, turn, lambda pair: pair["l"] + pair["r"] * a)


def permuted(rows: DataFrame, number: str, n: int, seed: int = 11) -> DataFrame:
    """`rows` with `number`, a bijection onto 0 .. n-1, permuted."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), F.col(number),
        lambda x, _: F.when(x < n, x).otherwise(step(x, n, seed)))
    inside = F.when(F.col(number) < n, F.col(number)).otherwise(walked)
    return (
        passed(rows, number, n, seed)
        .withColumn(number, inside)
        .withColumn(number, F.when(F.col(number) < n, F.col(number)).otherwise(F.raise_error(F.lit("a walk isn't over"))))
    )


def step_back(x: Column, n: int, seed: int) -> Column:
    """The number that `step` sends to x: the rounds in reverse, each taking away what it added."""
    a, b = sides(n)
    rounds = F.array(*map(F.lit, reversed(range(ROUNDS))))

    def turn(pair: Column, i: Column) -> Column:
        left, right = pair["l"], pair["r"]
        even = i % 2 == 0
        mixed = F.xxhash64(F.lit(seed), i, F.when(even, right).otherwise(left))
        return F.struct(
            F.when(even, (left + a - F.pmod(mixed, F.lit(a))) % a).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + b - F.pmod(mixed, F.lit(b))) % b).alias("r"))

    start = F.struct((x % a).cast("long").alias("l"), F.floor((x - x % a) / a).cast("long").alias("r"))
    return F.aggregate(rounds, start, turn, lambda pair: pair["l"] + pair["r"] * a)


def at_place(shard: Column, slot: Column, count: int, n: int, seed: int = 11) -> Column:
    """The row number that lies at a shard and slot of n rows in `count` shards; null outside. Walks back along the cycle."""
    p = slot.cast("long") * count + shard
    back = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), step_back(p, n, seed), lambda x, _: F.when(x < n, x).otherwise(step_back(x, n, seed)))
    checked = F.when(back < n, back).otherwise(F.raise_error(F.lit("a walk isn't over")))
    return F.when((shard >= 0) & (shard < count) & (slot >= 0) & (p < n), checked)


def numbered(rows: DataFrame, number: str, total: int) -> DataFrame:
    """`rows`, taken as a bag of values, with the numbers 0 .. total-1 in a new column.

    The numbers depend on the values alone: equal rows are counted first, the counts
    are summed in the order of a hash within cells of the hash, and each value gets
    its run of numbers. A value that a third of the rows share is one row until then.
    """
    own = [F.col(f"`{c}`") for c in rows.columns]
    cells = 1
    while cells * CELL_ROWS < total:
        cells *= 2
    counted = (
        rows.groupBy(*own).agg(F.count(F.lit(1)).alias("\u0001n"))
        .withColumn("\u0001h", F.xxhash64(*own))
        .withColumn("\u0001cell", F.pmod("\u0001h", F.lit(cells)))
    )
    # One row per cell, total / CELL_ROWS of them, in the window without a partition.
    ahead = Window.orderBy("\u0001cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("\u0001cell").agg(F.sum("\u0001n").alias("\u0001rows")).select(
        "\u0001cell", F.coalesce(F.sum("\u0001rows").over(ahead), F.lit(0)).alias("\u0001start"))
    inside = Window.partitionBy("\u0001cell").orderBy("\u0001h", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("\u0001before", F.coalesce(F.sum("\u0001n").over(inside), F.lit(0))).join(starts, "\u0001cell")
    first = F.col("\u0001start") + F.col("\u0001before")
    return repeat_rows(placed, "\u0001n", "\u0001i").select(*own, (first + F.col("\u0001i")).alias(number))


def shards(rows: DataFrame, count: int, seed: int = 11) -> DataFrame:
    """`rows` with `shard` (0 .. count-1) and `slot`, under the law that counts are at most one apart.

    Rows may hold nulls and repeat: equal rows are interchangeable and get numbers of
    their own. Columns must be of types that can be grouped (no maps); those named
    shard or slot are replaced. An empty table gives an empty table. Text may be among
    the columns, very long ones whole, but a narrow key or checksum in its place spares moving it.
    """
    rows = rows.drop("shard", "slot")
    total = rows.count()
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    p = permuted(numbered(rows, "\u0001p", total), "\u0001p", total, seed)
    return p.withColumns({
        "shard": (F.col("\u0001p") % count).cast("int"), "slot": F.expr(f"`\u0001p` div {count}"),
    }).drop("\u0001p")
