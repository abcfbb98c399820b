"""Exact top-k by inner product through a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. Inner products
become distances on a sphere: with one more coordinate, sqrt(R2 - |v|2) for a
candidate and 0 for a query, the candidates all have the length R of the longest,
and a larger product is a smaller distance. A query has the distances to all
pivots at hand; the triangle inequality bounds its distance to a block of a
pivot's vectors, an annulus between two distances, from below.

Distances are cut into ranges; a cell is a pivot and a range, an annulus. There is a
bounded number of cells, whatever the table, so their table, with the least and largest
distance and the members of each, is at hand in every task, and a query looks up its
cells without a row for each of them. The nearest cells give a query a k-th distance, its
radius; then it visits every cell whose bound doesn't pass the radius, and no other.
What is written grows with what the radius reaches. Cells are stored in blocks of a
bounded number of vectors, so a cell that holds a third of all rows is many blocks. A
query is sent once to a group of neighbouring blocks, with a bit for each that it asks,
and each pair of group and query batch is work of its own; a block is copied only for
the batches that ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

#: Pivots and distance ranges: from the number of vectors, within these bounds.
FEWEST_PIVOTS, MOST_PIVOTS, MOST_RANGES = 64, 256, 128
#: Vectors the pivots are fitted on: those with the smallest hash. Every vector is indexed and searched.
SAMPLE = 2048
#: Vectors in a block.
BLOCK = 1024
#: Queries whose cells are looked up at once.
LOOKED_UP = 64
#: Blocks, neighbours in the index, that a query is sent to at once: bits of a long.
GROUP = 16
#: Queries that are sent to a group of blocks at once, and of them those multiplied with a block at once.
QUERY_BATCH, MULTIPLIED = 4096, 512
#: Pairs of group and query batch whose table is broadcast; they are counted first.
FEW_PAIRS = 1 << 16
NO_ID, NO_FLOOR = np.iinfo(np.int64).max, np.iinfo(np.int64).min
RESULT = "q long, query_id long, vec_id long, score long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of doubles; a shorter list is filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values
    return out


def raised(vectors: np.ndarray, reach2: float) -> np.ndarray:
    """Candidates with the coordinate that gives all of them the length of the longest."""
    rest = np.maximum(reach2 - np.einsum("ij,ij->i", vectors, vectors), 0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means from evenly spaced starts."""
    pivots = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)].copy()
    for _ in range(8):
        nearest = distances(points, pivots).argmin(axis=1)
        for p in np.unique(nearest):
            pivots[p] = points[nearest == p].mean(axis=0)
    return pivots


def products(queries: np.ndarray, vectors: np.ndarray, reach2: float) -> np.ndarray:
    """Inner products, exact: no sum on the way passes the longest length, and floats hold whole numbers up to 2^24 and 2^53."""
    kind = np.float32 if reach2 < 2**24 else np.float64 if reach2 < 2**53 else np.int64
    return queries.astype(kind) @ vectors.astype(kind).T


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return order[np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows))) < k]


def met(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, vectors: np.ndarray, rids: np.ndarray, reach2: float,
        k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) by position: what reaches a query's floor, its own row aside; without a floor the k best and their ties."""
    scores = products(queries, vectors, reach2)
    edge = floors.astype(scores.dtype)
    bare = np.flatnonzero(floors == NO_FLOOR)
    if len(bare) and len(rids) > k + 1:  # one more than k, as a query's own row may be among them
        edge[bare] = np.partition(scores[bare], len(rids) - k - 1, axis=1)[:, len(rids) - k - 1]
    reaches = scores >= edge[:, None]
    _, at, there = np.intersect1d(own, rids, assume_unique=True, return_indices=True)
    reaches[at, there] = False
    row, column = np.nonzero(reaches)
    return row, column, scores[row, column].astype(np.int64)


class Index:
    """Blocks of vectors (block, pivot, range, rid, id, v) on disk, and the cells a query chooses among."""

    def __init__(self, vectors: DataFrame, count: int, reach2: float, width: int, k: int):
        self.reach2, self.width, self.k = reach2, width, k
        sample = raised(matrix(
            vectors.orderBy(F.xxhash64("id", "v"), "rid").limit(SAMPLE).select("v").toArrow()["v"], width), reach2)
        self.pivots = pivots = fit_pivots(sample, min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(count**0.5 / 4))))
        ranges = min(MOST_RANGES, -(-count // (len(pivots) * BLOCK)))
        # Where ranges are cut decides how even they are, not what is found: bounds come from the members themselves.
        cuts = np.quantile(distances(sample, pivots).min(axis=1), np.arange(1, ranges) / ranges) if ranges > 1 else np.zeros(0)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(raised(matrix(batch.column("v"), width), reach2), pivots)
                nearest = far.argmin(axis=1)
                own = far[np.arange(len(far)), nearest]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(np.searchsorted(cuts, own).astype(np.int32)),
                     pa.array(own)],
                    names=[*batch.schema.names, "pivot", "range", "far"])

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, last = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                numbers = []
                for cell in zip(batch.column("pivot").to_pylist(), batch.column("range").to_pylist(), strict=True):
                    if cell != last or held == BLOCK:
                        block, held, last = block + 1, 0, cell
                    held += 1
                    numbers.append(block)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())],
                                                 names=[*batch.schema.names, "block"])

        fields = "rid long, id long, v array<long>, pivot int, range int, far double"
        # Written, as the ranges are found in a pass of their own, which then reads three numbers and no vectors.
        keyed = materialize(vectors.select("rid", "id", "v").mapInArrow(key, fields), "keyed")
        # Equal vectors have equal keys; the row number lets them lie in several parts.
        ordered = keyed.repartitionByRange("pivot", "far", "rid").sortWithinPartitions("pivot", "far", "rid")
        self.blocks = materialize(ordered.mapInArrow(number, f"{fields}, block long"), "index")
        sizes = self.blocks.groupBy("pivot", "range", "block").agg(
            F.count(F.lit(1)).alias("members"), F.min("far").alias("inner"), F.max("far").alias("outer"))
        # Of a cell's blocks the first that hold more than k vectors are enough for a radius.
        upto = Window.partitionBy("pivot", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        self.directory = materialize(sizes.withColumn("first", F.coalesce(F.sum("members").over(upto), F.lit(0)) <= k), "directory")
        # At most MOST_PIVOTS times MOST_RANGES rows.
        self.cells = self.directory.groupBy("pivot", "range").agg(
            F.min("inner").alias("inner"), F.max("outer").alias("outer"), F.sum("members").alias("members")
        ).orderBy("pivot", "range").toPandas()

    def reached(self, queries: DataFrame, first: bool) -> DataFrame:
        """(q, block, floor): the blocks that a query's radius reaches; `first`: those near it that hold more than k vectors.

        `queries` are (q, v, floor, radius); without a radius all blocks are reached.
        """
        pivots, width, k = self.pivots, self.width, self.k
        pivot, ring = self.cells["pivot"].to_numpy(), self.cells["range"].to_numpy()
        inner, outer, members = (self.cells[x].to_numpy() for x in ("inner", "outer", "members"))
        slack = 1e-6 * (1 + self.reach2) ** 0.5  # covers the rounding of distances

        def choose(bound: np.ndarray, apart: np.ndarray, radius: float | None) -> np.ndarray:
            if first:
                order = np.lexsort((apart, bound))
                return order[: np.searchsorted(np.cumsum(members[order]), k, side="right") + 1]
            return np.arange(len(bound)) if radius is None else np.flatnonzero(bound <= radius + slack)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, LOOKED_UP):
                    batch = whole.slice(start, LOOKED_UP)
                    points = matrix(batch.column("v"), width)
                    far = distances(np.hstack([points, np.zeros((len(points), 1))]), pivots)[:, pivot]
                    bound = np.maximum(np.maximum(far - outer, inner - far), 0)
                    apart = np.abs(far - (inner + outer) / 2)
                    chosen = [choose(*x) for x in zip(bound, apart, batch.column("radius").to_pylist(), strict=True)]
                    row = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
                    cell = np.concatenate(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("q").take(pa.array(row)), batch.column("floor").take(pa.array(row)),
                         pa.array(pivot[cell]), pa.array(ring[cell])], names=["q", "floor", "pivot", "range"])

        cells = queries.select("q", "v", "floor", "radius").mapInArrow(look_up, "q long, floor long, pivot int, range int")
        blocks = self.directory.where("first") if first else self.directory
        return cells.join(blocks.select("pivot", "range", "block"), ["pivot", "range"]).select("q", "block", "floor")

    def visit(self, pairs: DataFrame, queries: DataFrame, batches: int, k: int) -> DataFrame:
        """The k best of each group of blocks for each query in `pairs` (q, block, floor), none below its floor."""
        reach2, width = self.reach2, self.width

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in ("q", "query_id", "vec_id", "score")})
            vectors, points = matrix(held["v"], width), matrix(asked["v"], width)
            slot, rids, ids = held["slot"].to_numpy(), held["rid"].to_numpy(), held["id"].fill_null(NO_ID).to_numpy()
            q, slots, floors = asked["q"].to_numpy(), asked["slots"].to_numpy(), asked["floor"].fill_null(NO_FLOOR).to_numpy()
            found = []
            for block in np.unique(slot):
                members, asking = np.flatnonzero(slot == block), np.flatnonzero(slots >> block & 1)
                for start in range(0, len(asking), MULTIPLIED):
                    some = asking[start : start + MULTIPLIED]
                    row, column, score = met(points[some], q[some], floors[some], vectors[members], rids[members], reach2, k)
                    row, vec_id = some[row], ids[members[column]]
                    if len(row) > k * len(some):
                        few = best(row, vec_id, score, k)
                        row, vec_id, score = row[few], vec_id[few], score[few]
                    found.append((row, vec_id, score))
            row, vec_id, score = (np.concatenate(x) for x in zip(*found, strict=True))
            few = best(row, vec_id, score, k)
            row, vec_id, score = row[few], vec_id[few], score[few]
            return pa.table({"q": pa.array(q[row]), "query_id": asked["query_id"].take(pa.array(row)),
                             "vec_id": pa.array(vec_id, mask=vec_id == NO_ID), "score": pa.array(score)})

        part = F.pmod(F.xxhash64("q"), F.lit(batches)).alias("part")
        group, slot = F.shiftright("block", GROUP.bit_length() - 1).alias("group"), F.col("block").bitwiseAND(GROUP - 1).cast("int")
        dealt = materialize(pairs.groupBy(group, part, "q", "floor").agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot)).alias("slots")), "asked")
        # A row takes about a byte in the file and many in memory, equal vectors likewise, so no broadcast is chosen by a file's size.
        asked = dealt.hint("merge").join(queries, "q").select("group", "part", "q", "query_id", "v", "floor", "slots")
        wanted = materialize(dealt.groupBy(F.col("group").alias("wanted"), F.col("part").alias("of")).agg(
            F.bit_or("slots").alias("slots")), "wanted")
        wanted = wanted.hint("broadcast" if wanted.count() <= FEW_PAIRS else "merge")
        blocks = self.blocks.select(group, slot.alias("slot"), "rid", "id", "v")
        held = blocks.join(wanted, F.col("group") == F.col("wanted")).where(
            F.call_function("getbit", "slots", "slot") == 1).select("group", F.col("of").alias("part"), "slot", "rid", "id", "v")
        return asked.groupBy("group", "part").cogroup(held.groupBy("group", "part")).applyInArrow(meet, RESULT)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10,
          scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `query` chooses, the k other rows of the highest inner product.

    Components become floor(scale * x). Vectors that are null, or hold null or
    non-finite components, take no part, neither asking nor asked; shorter vectors count
    as filled up with zeros. Ties go to the smaller key, null last; repeated rows are
    candidates of their own and never lose their doubles. Fewer than k candidates give
    all of them; an empty table gives an empty result; other columns are not read.
    Scores are exact below 2^63.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    usable = F.col(vector).isNotNull() & ~F.exists(
        F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    vectors = materialize(rows.select(
        F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), whole.alias("v"),
        F.coalesce(query, F.lit(False)).alias("asks"), usable.alias("usable")).where("usable").drop("usable"), "vectors")
    length2 = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    stats = vectors.agg(F.count(F.lit(1)).alias("count"), F.max(length2).alias("reach2"), F.max(F.size("v")).alias("width"),
                        F.count_if("asks").alias("queries")).first()
    if not stats["queries"]:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                              F.lit(0).cast("long").alias("score")).limit(0)
    index = Index(vectors, stats["count"], stats["reach2"], stats["width"], k)
    queries = vectors.where("asks").select(F.col("rid").alias("q"), F.col("id").alias("query_id"), "v")
    batches = -(-stats["queries"] // QUERY_BATCH)

    unknown = queries.withColumns({"floor": F.lit(None).cast("long"), "radius": F.lit(None).cast("double")})
    first = ranked(index.visit(index.reached(unknown, first=True), queries, batches, k), k)
    floors = first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    length2 = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    known = queries.join(floors.select("q", "floor"), "q", "left").withColumn("radius", F.when(
        F.col("floor").isNotNull(), F.sqrt(F.greatest(
            length2 + F.lit(stats["reach2"]) - 2 * F.col("floor").cast("double"), F.lit(0.0)))))
    found = ranked(index.visit(index.reached(known, first=False), queries, batches, k), k)
    return found.select("query_id", "rank", "vec_id", "score")
