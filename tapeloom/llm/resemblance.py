"""Near copies by the Jaccard similarity of whole texts' word shingles, exact.

Texts link when the sets of their runs of five words have a similarity of at least
0.8. SimHash fingerprints of these runs come first: rows whose fingerprints link through
the pivot distance tables of `simhash`, at four bits or fewer, are compared as whole sets,
and those that are similar are one class from then on. No radius of fingerprints bounds
the similarity, so what four bits do not link comes from prefixes: of sets that similar,
each has one of the other's among its first fifth of shingles and one more, whatever the
order of shingles, if it is the same for all. The order puts shingles last that a sample
found to be common, which spares pairs and never loses one. A key's members are linked in
two turns: with one of them first, then what is not yet connected, pair by pair, each pair
at the first key it shares; a large key in pieces that bound what a task holds and
compares. Sizes and parity bitmaps discard pairs that can't be similar, a pair's longer
bitmaps most of the others; whole sets decide on the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from tapeloom.llm import simhash
from tapeloom.llm.common import map_texts, numbered
from tapeloom.llm.simhash import components
from tapeloom.session import materialize

WIDTH = 5
#: Documents sampled for the order, and shingles that it may put last.
SAMPLED, COMMON = 1 << 14, 1 << 17
#: Words of 64 bits in a parity bitmap.
BITMAP = 8
#: Bytes of text whose shingles are held at once: they are several times the text.
SLICE_BYTES = 1 << 20
#: Rows of a key, and of a block of a larger key, that a task compares.
LARGE = 1 << 13
#: Of a row's shared keys the smallest, by which a pair is told at the first key it shares and not at each.
LOWEST = 16
#: Rows that may be broadcast, as numbers: some 64 bytes each in the driver, which builds the table it sends.
BROADCAST_ROWS = 1 << 18


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct word shingles of a text, as sorted 64-bit hashes; a shorter text is one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's shingles in the order of all, so many that a similar set shares one."""
    many = len(hashes) - (4 * len(hashes) + 4) // 5 + 1
    if not len(common):
        return hashes[:many]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    first = hashes[~last][:many]
    if len(first) == many:
        return first
    late = hashes[last][np.argsort(rank[at[last]])]
    return np.r_[first, late[: many - len(first)]]


def bitmap(hashes: np.ndarray, size: int = 64 * BITMAP) -> bytes:
    """The parity of the shingles per bit: two sets differ in at least as many shingles as their bitmaps in bits."""
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def common_shingles(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample, sorted, and their place in the order: at most COMMON, so the driver may hold them."""
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, total // SAMPLED))) == 0).select("text")
    sets = map_texts(some, "text", [StructField("hash", ArrayType(LongType()))], lambda: lambda texts: [
        pa.array([shingles(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], most=SLICE_BYTES)
    counted = sets.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counted.orderBy(F.col("n").desc(), "hash").limit(COMMON).select("hash").toArrow()
    hashes = found["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], -order  # the most frequent is the last of all


def prefixes(rows: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(row, hash) of every shingle in a prefix."""
    firsts = map_texts(rows.select("row", "text"), "text", [StructField("hash", ArrayType(LongType()))], lambda: lambda texts: [
        pa.array([prefix(shingles(t), common, rank).view(np.int64) for t in texts], pa.list_(pa.int64()))], most=SLICE_BYTES)
    return firsts.select("row", F.explode("hash").alias("hash"))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hash, row) sorted by hash those whose hash has another; no key is held."""
    before = None  # (hash, row, whether it has been given out)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, r = (batch.column(i).to_numpy() for i in range(2))
        done = False
        if before is not None:
            h, r, done = np.r_[before[0], h], np.r_[before[1], r], before[2]
        same = h[1:] == h[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        given = bool(keep[-1])
        out = keep.copy()
        out[0] &= not done
        if len(h) == 1:
            given = done
        before = (h[-1], r[-1], given)
        yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(r[out])], names=["hash", "row"])


def similar_sizes(a, b):
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def candidates(every: bool) -> Callable:
    """From rows (hash, piece, side, row, root, n, bits, low) sorted by hash, piece and row: pairs (a, b) that may be similar.

    Of each (hash, piece) those with its first row, or all of different roots; if it has two sides, those across.
    A pair of different roots meets at every key it shares, and is left out where both rows have a smaller one
    in common among their `low`: its first key always tells it.
    """
    def pairs(key, side, row, root, n, bits, low) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if every:  # partners of a similar size follow one another
            order = np.argsort(n, kind="stable")
            side, row, root, n, bits, low = side[order], row[order], root[order], n[order], bits[order], low[order]
            upto, across = np.searchsorted(4 * n, 5 * n, side="right"), side.min() != side.max()
        for i in range(len(row) - 1 if every else 1):
            end = upto[i] if every else len(row)
            fits = root[i + 1 : end] != root[i]
            fits &= (side[i + 1 : end] != side[i]) | (not across) if every else similar_sizes(n[i + 1 :], n[i])
            at = np.flatnonzero(fits) + i + 1
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            at = at[9 * differ <= n[at] + n[i]]
            if every and len(at):
                smaller = low[i][low[i] < key]
                at = at[~(low[at][:, :, None] == smaller).any(axis=(1, 2))]
            if len(at):
                yield np.minimum(row[at], row[i]), np.maximum(row[at], row[i])

    def out(found) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def lowest(column) -> np.ndarray:
        """A line of LOWEST keys a row; what a row has fewer is filled with a number that no key is larger than."""
        many = np.diff(column.offsets.to_numpy())
        lines = np.full((len(many), LOWEST), np.iinfo(np.int64).max)
        lines[np.arange(LOWEST) < many[:, None]] = column.flatten().to_numpy()
        return lines

    def changes(table) -> np.ndarray:
        h, piece = (table.column(i).to_numpy() for i in range(2))
        return np.flatnonzero((h[1:] != h[:-1]) | (piece[1:] != piece[:-1])) + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(table) -> Iterator[pa.RecordBatch]:
            side, row, root, n = (table[i].to_numpy() for i in range(2, 6))
            raw = b"".join(table[6].to_pylist())
            bits = np.frombuffer(raw, np.uint64).reshape(-1, BITMAP)
            key, low = table[0].to_numpy(), lowest(table[7].combine_chunks())
            edge = np.r_[0, changes(table), len(row)]
            found, size = [], 0
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s < 2 or (root[s:e] == root[s]).all():
                    continue
                for x in pairs(key[s], side[s:e], row[s:e], root[s:e], n[s:e], bits[s:e], low[s:e]):
                    found.append(x)
                    size += len(x[0])
                    if size > 1 << 16:
                        yield out(found)
                        found, size = [], 0
            if found:
                yield out(found)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            first = tuple(batch.column(i)[0].as_py() for i in range(2))
            cuts = changes(batch)
            cut = int(cuts[-1]) if len(cuts) else 0
            if held and (cut or tuple(held[-1].column(i)[-1].as_py() for i in range(2)) != first):
                held.append(batch.slice(0, cut))
                yield from of(pa.Table.from_batches(held))
                held = [batch.slice(cut)]
            elif cut:
                yield from of(pa.Table.from_batches([batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from of(pa.Table.from_batches(held))

    return search


def joined_to_few(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join with a written table of a row per large key; broadcast only if its rows are counted and few."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def with_first(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs (a, b) of a large key's first row with its others: no task holds the key."""
    there = joined_to_few(rows, large, "hash").select("hash", "row", "n")
    first = materialize(there.groupBy("hash").agg(F.min(F.struct("row", "n")).alias("first")), "firsts")
    sizes = (F.least("n", "first.n") * 5 >= F.greatest("n", "first.n") * 4) & (F.col("row") != F.col("first.row"))
    return joined_to_few(there, first, "hash").where(sizes).select(F.col("first.row").alias("a"), F.col("row").alias("b"))


def in_pieces(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The `rows` of large keys, dealt so that a pair of different roots meets in a piece of bounded size.

    Rows of the root that the key's first row has need no comparison with each other. They and the others are cut into
    blocks of about LARGE rows by their hash; a piece is two blocks, of which one holds others, or one of others alone. A
    key of one root yields nothing, so what is copied grows with the others, not with the group.
    """
    there = joined_to_few(rows, large, "hash")
    roots = there.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("many"), F.min("row").alias("row"))
    keys = roots.groupBy("hash").agg(F.sum("many").alias("all"), F.min(F.struct("row", "root", "many")).alias("first"))
    blocks = [F.ceil(x / LARGE).cast("long") for x in (F.col("all") - F.col("first.many"), F.col("first.many"))]
    keys = keys.where(F.col("all") > F.col("first.many")).select(
        "hash", F.col("first.root").alias("main"), blocks[0].alias("others"), blocks[1].alias("mains"))
    dealt = F.xxhash64("row", "hash")
    main = F.col("root") == F.col("main")
    block = F.when(main, F.col("others") + F.pmod(dealt, F.col("mains"))).otherwise(F.pmod(dealt, F.col("others")))
    last = F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    met = joined_to_few(there, materialize(keys, "large"), "hash").withColumn("side", block).withColumn(
        "met", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    piece = F.shiftleft(F.least("side", "met"), 31).bitwiseOR(F.greatest("side", "met"))
    return met.select("hash", piece.alias("piece"), "side", *[c for c in rows.columns if c != "hash"])


def fine(hashes: np.ndarray) -> bytes:
    """A parity bitmap of two to four bits a shingle."""
    return bitmap(hashes, max(64, 2 << len(hashes).bit_length()))


def may_be_alike(x: bytes, y: bytes) -> bool:
    """Whether sets of these (n, fine bitmap) may be similar; the longer bitmap is folded to the shorter."""
    (m, u), (n, v) = ((int.from_bytes(z[:8], "little"), np.frombuffer(z, np.uint64, offset=8)) for z in (x, y))
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return 9 * int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) <= m + n


def alike(x: bytes, y: bytes) -> bool:
    """Whether sets have a similarity of 0.8."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return 9 * len(np.intersect1d(u, v, assume_unique=True)) >= 4 * (len(u) + len(v))


def kept(pairs: DataFrame, told: DataFrame, test: Callable) -> DataFrame:
    """The `pairs` (a, b) whose values in `told` (row, value) pass the test."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(told.select(F.col("row").alias("a"), F.col("value").alias("x")), "a").join(
        told.select(F.col("row").alias("b"), F.col("value").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "pairs")


def picked(rows: DataFrame, some: DataFrame) -> DataFrame:
    """(row, text) of the rows in `some` (row), a written table; few are broadcast, so that no text moves."""
    few = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    return rows.select("row", "text").join(few, "row", "left_semi")


def near_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of `rows` (row, text) whose SimHash fingerprints of five-word shingles link, enough to connect all that do.

    Of a fingerprint the smallest row stands for the others, which pair with it; fingerprints pair as `simhash.links` finds them.
    """
    marked = materialize(simhash.fingerprints(rows.select("row", "text"), "text", WIDTH), "fingerprints")
    first = materialize(marked.groupBy("fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("many")), "firsts")
    repeated = first.where("many > 1").select("fp", "first")
    same = joined_to_few(marked, repeated, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    x, y = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_row")) for c in "ab")
    near = simhash.links(first.select("fp")).join(x, "a").join(y, "b")
    return same.unionByName(near.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b")).distinct())


def links(rows: DataFrame) -> DataFrame:
    """(a, b): linked rows of `rows` (row, text), a written table; enough to connect whatever is connected."""
    keys = prefixes(rows, *common_shingles(rows, rows.count())).select("hash", "row").repartition("hash").sortWithinPartitions("hash")
    keys = materialize(keys.mapInArrow(shared, "hash long, row long"), "keys")
    fields = [StructField("n", LongType()), StructField("bits", BinaryType()), StructField("value", BinaryType())]

    def described(texts):
        told = []
        for text in texts:  # one set at a time
            hashes = shingles(text)
            told.append((len(hashes), bitmap(hashes), len(hashes).to_bytes(8, "little") + fine(hashes)))
        n, bits, value = zip(*told, strict=True) if told else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(value, pa.binary())]

    def whole(texts):
        return [pa.array([shingles(t).tobytes() for t in texts], pa.binary())]

    some = picked(rows, materialize(keys.select("row").distinct(), "rows"))
    nodes = materialize(map_texts(some, "text", fields, lambda: described, most=SLICE_BYTES), "nodes")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs, nodes, may_be_alike)
        members = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "rows")
        sets = map_texts(picked(rows, members), "text", [StructField("value", BinaryType())], lambda: whole, most=SLICE_BYTES)
        return kept(pairs, materialize(sets, "sets"), alike)

    def classes(edges: DataFrame) -> DataFrame:
        named = components(edges)
        return nodes.select("row").join(named, F.col("row") == F.col("node"), "left").select(
            "row", F.coalesce("root", "row").alias("root"))

    found = similar(near_fingerprints(rows))
    roots = classes(found)
    counted = keys.groupBy("hash").agg(F.count(F.lit(1)).alias("many"))
    large = materialize(counted.where(F.col("many") > LARGE).select("hash"), "large")
    some_large = not large.isEmpty()
    for every in (False, True):
        told = roots.join(nodes.select("row", "n", "bits"), "row")
        met = keys
        if every:  # a key of one root has nothing to compare
            ends = keys.join(roots, "row").groupBy("hash").agg(F.min("root").alias("least"), F.max("root").alias("most"))
            met = joined_to_few(keys, materialize(ends.where("least < most").select("hash"), "mixed"), "hash", "left_semi")
            told = told.join(keys.groupBy("row").agg(F.slice(F.array_sort(F.collect_list("hash")), 1, LOWEST).alias("low")), "row")
        else:
            told = told.withColumn("low", F.array().cast("array<long>"))
        keyed = met.join(told, "row").select("hash", "row", "root", "n", "bits", "low")
        rest = joined_to_few(keyed, large, "hash", "left_anti") if some_large else keyed
        zero = F.lit(0).cast("long")
        dealt = rest.select("hash", zero.alias("piece"), zero.alias("side"), "row", "root", "n", "bits", "low")
        if some_large and every:
            dealt = dealt.unionByName(in_pieces(keyed, large))
        dealt = dealt.repartition("hash", "piece").sortWithinPartitions("hash", "piece", "row")
        near = dealt.mapInArrow(candidates(every), "a long, b long")
        if some_large and not every:
            near = near.unionByName(with_first(keyed, large))
        found = found.unionByName(similar(near.distinct()))
        if not every:
            roots = classes(found)
    return found


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, in its columns, of which each group of linked texts keeps one: that with the smallest key, null last.

    Null and empty texts, and texts of blanks alone, link. Texts of fewer than five words are one shingle.
    Of repeated rows one stays; of equal keys the row read first. A very long text is one set of shingles,
    handled alone. Other columns pass through whatever their names or nulls; an empty table gives an empty table.
    """
    whole = numbered(docs)
    rows = whole.select(F.col("\u0001row").alias("row"), F.col(f"`{text}`").alias("text"))
    place = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col("\u0001row").alias("row"))
    named = whole.select("\u0001row", place.alias("place")).join(components(links(rows)), F.col("\u0001row") == F.col("node"))
    named = materialize(named.select("\u0001row", "place", "root"), "roots")
    first = named.groupBy("root").agg(F.min("place").alias("first"))
    out = named.join(first, "root").where(F.col("first.row") != F.col("\u0001row")).select("\u0001row")
    return whole.join(out, "\u0001row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
