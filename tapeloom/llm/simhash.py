"""SimHash near-duplicates, linked through pivot distance tables.

Fingerprints are 64 bits, texts link when theirs differ in at most four. Each
fingerprint gets a row of a distance table: its Hamming distances to many
reference fingerprints. By the triangle inequality two rows of linked
fingerprints differ by at most four in every coordinate, so a pair with a larger
difference anywhere is discarded, and what survives is verified bit by bit.

Distances to references lie close to 32 whatever the text, so they discard pairs
but can't deal them out. Dealing is by blocks of bits: with six blocks, four
differing bits leave two untouched, so linked fingerprints meet under one of 15
keys. A key that holds many is split by the blocks of its remaining bits, until
it is small or its bits bound it. Inside a key a search from one fingerprint to
the next yields a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tapeloom.llm.common import map_texts, numbered
from tapeloom.session import materialize

MOST = 4
BLOCKS = 6
#: Fingerprints under one key beyond which the key is split.
LARGE = 1 << 13
PIVOTS = 32
WORD_COUNT = 4


def fingerprint(text: bytes, width: int = WORD_COUNT) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number."""
    words = text.lower().split()  # for bytes: letters A-Z, and blanks 09-0D and 20
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > width:
        starts, ends = starts[: 1 - width] if width > 1 else starts, ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in parts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WORD_COUNT) -> DataFrame:
    """`docs` with `fp` (long) in the place of the text."""
    return map_texts(docs, text, [StructField("fp", LongType())], lambda: lambda texts: [
        pa.array([fingerprint(t, width) for t in texts], pa.int64())])


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    """`bits` in `parts` runs of nearly equal length."""
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def first_keys() -> list[list[int]]:
    """The bits of each of the first keys: any two blocks of six."""
    blocks = split_bits(list(range(64)), BLOCKS)
    return [a + b for a, b in combinations(blocks, 2)]


def dealt(nodes: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(fp, mask, part) for every mask: part holds the bits the members of a key agree on."""
    keys = F.explode(F.array(*[F.lit(mask(m)).cast("long") for m in masks]))
    return nodes.select("fp", keys.alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def finer(rows: DataFrame) -> DataFrame:
    """(fp, mask) of large keys dealt again: five blocks of the bits not yet in the key, one of which four differences spare."""
    masks = [r["mask"] for r in rows.select("mask").distinct().collect()]  # so many per level, whatever the rows
    pairs = []
    for m in masks:
        held = [b for b in range(64) if (m >> b) & 1]
        free = [b for b in range(64) if not (m >> b) & 1]
        pairs += [(m, mask(held + part)) for part in split_bits(free, MOST + 1) if part]
    next_masks = rows.sparkSession.createDataFrame(pairs, "mask long, next long")
    return (
        rows.join(F.broadcast(next_masks), "mask").select("fp", F.col("next").alias("mask")).distinct()
        .withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    )


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1).astype(np.int8)


def reference_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(count)], np.uint64)


def forest(fps: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links among the members of one key."""
    table = distance_table(fps, pivots)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = table[order], fps[order]
    first = table[:, 0].astype(np.int64)
    left = np.ones(len(fps), bool)  # not yet reached
    edges = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            a, b = np.searchsorted(first, [first[x] - MOST, first[x] + MOST + 1])
            near = np.flatnonzero(left[a:b]) + a
            for column in range(1, table.shape[1], 8):
                if len(near) < 64:
                    break
                gap = np.abs(table[near, column : column + 8] - table[x, column : column + 8]).max(axis=1)
                near = near[gap <= MOST]
            near = near[np.bitwise_count(sorted_fps[near] ^ sorted_fps[x]) <= MOST]
            left[near] = False
            queue.extend(near.tolist())
            edges.extend((int(order[x]), int(order[y])) for y in near.tolist())
    return edges


def near_pairs(fps: np.ndarray, pivots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the position pairs link: discarded by the distance table, then verified."""
    x, y = fps[a], fps[b]
    keep = np.ones(len(a), bool)
    for p in pivots:
        gap = np.bitwise_count(x[keep] ^ p).astype(np.int8) - np.bitwise_count(y[keep] ^ p).astype(np.int8)
        keep[keep] = np.abs(gap) <= MOST
        if keep.sum() < len(a) // 16:
            break
    keep[keep] = np.bitwise_count(x[keep] ^ y[keep]) <= MOST
    return keep


def links_of_keys(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints, a spanning forest of each key; keys of two to four all at once."""
    sizes = ends - starts
    a, b = [], []
    small = sizes <= 4
    for i, j in combinations(range(4), 2):
        at = starts[small & (sizes > j)]
        keep = near_pairs(fps, pivots, at + i, at + j)
        a.append(at[keep] + i)
        b.append(at[keep] + j)
    for start, end in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        edges = np.array(forest(fps[start:end], pivots), np.int64).reshape(-1, 2) + start
        a.append(edges[:, 0])
        b.append(edges[:, 1])
    return np.concatenate(a), np.concatenate(b)


FOUND = "a long, b long, mask long"


def search_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (mask, part, fp) sorted by key: links (a, b, null), and the rows (fp, null, mask) of large keys."""
    pivots = reference_fingerprints()
    held = np.empty((3, 0), np.int64)
    given_up = None  # the large key whose rows are passing through

    def out(a, b, masks) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(masks, pa.int64())],
                                          names=["a", "b", "mask"])

    def none(n: int) -> pa.Array:
        return pa.nulls(n, pa.int64())

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        edge = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, rows.shape[1]]
        large = ends - starts > LARGE
        for start, end in zip(starts[large], ends[large], strict=True):
            yield out(rows[2, start:end], none(end - start), rows[0, start:end])
        some = (ends - starts > 1) & ~large
        a, b = links_of_keys(rows[2].view(np.uint64), starts[some], ends[some], pivots)
        if len(a):
            yield out(rows[2, a], rows[2, b], none(len(a)))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
        if given_up is not None:
            same = (rows[0] == given_up[0]) & (rows[1] == given_up[1])
            if same.any():
                yield out(rows[2, same], none(int(same.sum())), rows[0, same])
            if same.all():
                continue
            rows, given_up = rows[:, ~same], None
        held = np.concatenate([held, rows], axis=1)
        open_from = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
        cut = open_from[-1] + 1 if len(open_from) else 0
        yield from found(held[:, :cut])
        held = held[:, cut:]
        if held.shape[1] > LARGE:
            yield out(held[2], none(held.shape[1]), held[0])
            given_up, held = (held[0, 0], held[1, 0]), np.empty((3, 0), np.int64)
    yield from found(held)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): linked fingerprints of `nodes` (distinct fp), enough to connect whatever is connected."""
    keyed, all_links = dealt(nodes, first_keys()), None
    while True:
        sorted_keys = keyed.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part")
        found = materialize(sorted_keys.mapInArrow(search_keys, FOUND), "links")
        edges = found.where(F.col("b").isNotNull()).select("a", "b")
        all_links = edges if all_links is None else all_links.unionByName(edges)
        rest = found.where(F.col("b").isNull()).select(F.col("a").alias("fp"), "mask")
        if rest.isEmpty():
            return all_links.distinct()
        # Every level adds bits to a key; with 13 or fewer left a key can't hold more than LARGE.
        keyed = finer(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node it is connected with.

    Large and small stars in turn: each node's neighbours are hung on the smallest of
    them, until nothing changes. Each turn is written out, so a lost executor costs
    one turn; hubs are joined, never collected.
    """
    def smaller(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smaller(both).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "stars")
        least = smaller(large)
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(marked: DataFrame, first: Column) -> DataFrame:
    """(fp, first): for every fingerprint in `marked`, the smallest `first` among the rows it is connected with."""
    nodes = materialize(marked.groupBy("fp").agg(F.min(first).alias("own")), "nodes")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    return named.join(named.groupBy("root").agg(F.min("own").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WORD_COUNT) -> DataFrame:
    """`docs` with fingerprint and component_id in the place of the text.

    Null and empty texts, and texts of blanks alone, have fingerprint zero and link as
    any other. component_id is the smallest key reachable over links; null keys are
    passed over, and a group of none but null keys has a null one. Repeated rows are in
    one group. Columns named fingerprint or component_id are replaced; others are kept.
    An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c not in ("fingerprint", "component_id", "fp")]
    marked = materialize(fingerprints(docs.select(*[F.col(f"`{c}`") for c in rest]), text, width), "fingerprints")
    named = classes(marked.select("fp", F.col(key).alias("key")), F.col("key"))
    kept = [F.col(f"`{c}`") for c in rest if c != text]
    return marked.join(named, "fp").select(
        *kept, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WORD_COUNT) -> DataFrame:
    """The rows of `docs`, in its columns, of which each group keeps one: that with the smallest key, null last.

    Rows are numbered once and written with their number; of equal keys in a group the first number stays.
    """
    whole = numbered(docs)
    rows = whole.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col("\u0001row").alias("row"))
    place = F.struct(F.col("key").isNull(), "key", "row")
    marked = materialize(fingerprints(rows, "text", width), "fingerprints")
    named = classes(marked, place)
    out = marked.join(named, "fp").where(F.col("first.row") != F.col("row")).select(F.col("row").alias("\u0001row"))
    return whole.join(out, "\u0001row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
