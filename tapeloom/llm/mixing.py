"""Mixing sources to target weights by systematic sampling.

A source with target t and size s expects t/s copies of each of its documents.
Along a fixed order of the source the expected copies are summed, one random
offset is added, and a document is emitted once per integer that its step
crosses: never more than the next whole number of copies, and the source's
emitted words follow the target to about one document, because the order runs
through the sizes from large to small and is random only among similar sizes.

The prefix sum needs a rank within the source, not one task per source: rows are
counted per (source, size class, spread), ranked inside such a cell, and the
cells' counts are summed in order. The spread cells split a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import numbered, repeat_rows

WORD = "[^\\x20\\x09-\\x0D]+"
#: Cells that one size class of one source is spread over.
SPREAD = 64


def words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source: `source_size`, and the words it should give, `target`.

    `sizes` has a row per source (source, source_size): as many rows as there are
    sources, which is what the one-task window below may hold. Sources in code point
    order, null last, take the weights in turn and share `share` of all sizes; none
    passes `most` times its size, and what it can't take is shared again by weight.
    The outcome is min(cap, level x weight) with one level for all: sources are
    capped in the order of cap/weight for as long as the level of the rest passes it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                    / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        # The first source that stays below its cap sets the level of all after it.
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")))
        .select("source", "source_size", "target")
    )


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: str) -> Column:
    """Number of a size's class, growing with the size: eight classes per doubling, by integer arithmetic."""
    bits = f"length(bin({size}))"
    return F.expr(f"8 * {bits} + shiftright({size} * 8, {bits} - 1) - 8")


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, **shares) -> DataFrame:
    """`docs` without the text, with size, source_size, target, copies and taken.

    Nulls: a null text has size 0, a null source is a source of its own, last in
    order; a null key orders as the text ''. Documents of size 0 take 0 words
    whatever their copies; a very long text is one document like any other, its words
    counted inside the row and never cut. Equal rows are interchangeable and counted as one group,
    so repeated rows make no large group. An empty table gives an empty table.
    Reruns agree: order and offset come from hashes of key and source, not from the
    layout. Other columns are carried along; one with the name of a new column is
    replaced by it.
    """
    rest = [c for c in docs.columns if c not in (text, "source", "size", "source_size", "target", "copies", "taken")]
    sized = docs.select("source", words(F.col(text)).alias("size"), *[F.col(f"`{c}`") for c in rest])
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    grouped = (
        sized.groupBy(*[F.col(f"`{c}`") for c in sized.columns]).agg(F.count(F.lit(1)).alias("\u0001n"))
        .withColumn("\u0001h", hashed)
        .withColumn("\u0001class", size_class("size"))
        .withColumn("\u0001spread", F.pmod(F.conv(F.substring("\u0001h", 1, 8), 16, 10).cast("long"), F.lit(SPREAD)))
    )
    cell = ["source", "\u0001class", "\u0001spread"]
    cells = grouped.groupBy(*cell).agg(
        F.sum("\u0001n").alias("\u0001rows"), F.sum(F.col("\u0001n") * F.col("size")).alias("\u0001words"))
    ahead = Window.partitionBy("source").orderBy(F.col("\u0001class").desc(), "\u0001spread")
    starts = cells.withColumn(
        "\u0001start", F.coalesce(F.sum("\u0001rows").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(cells.groupBy("source").agg(F.sum("\u0001words").alias("source_size")), **shares)
    placed = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(
        *[starts[c].alias(f"\u0001at{i}") for i, c in enumerate(cell)], "\u0001start", "source_size", "target")
    inside = Window.partitionBy(*cell).orderBy(F.col("size").desc(), "\u0001h", *[F.col(f"`{c}`") for c in rest])
    ranked = grouped.withColumn(
        "\u0001before", F.coalesce(F.sum("\u0001n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"\u0001at{i}")) for i, c in enumerate(cell)]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        ranked.join(placed, on)
        .withColumn("\u0001rate", rate)
        .withColumn("\u0001offset", unit(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))))
    )
    rank = F.col("\u0001start") + F.col("\u0001before") + F.col("\u0001i")

    def crossed(upto: Column) -> Column:
        return F.floor(F.col("\u0001rate") * upto + F.col("\u0001offset"))

    # A rate of at most 2 crosses at most 2 integers; the bound keeps a rounding of the sum from adding one.
    return (
        repeat_rows(rows, "\u0001n", "\u0001i")
        .withColumn("copies", F.least(crossed(rank + 1) - crossed(rank), F.ceil("\u0001rate")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("source", *[F.col(f"`{c}`") for c in rest], "size", "source_size", "target", "copies", "taken")
    )


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", **shares) -> DataFrame:
    """The mixed documents: every row of `docs`, as often as its copies say, with the columns of `docs`.

    Copies are computed on narrow rows of a table written once with a number of each
    row. The text moves once more, in the join by that number, which no hot source or
    copied text can skew.
    """
    whole = numbered(docs)
    drawn = copies(whole.select("source", key, text, "\u0001row"), text=text, key=key, **shares)
    drawn = drawn.where("copies > 0").select("\u0001row", F.col("copies").alias("\u0001copies"))
    mixed = repeat_rows(whole.join(drawn, "\u0001row"), "\u0001copies", "\u0001i")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])
