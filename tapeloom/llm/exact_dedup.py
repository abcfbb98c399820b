"""Exact duplicates through counting quotient filters and a comparison of bytes.

Every task turns the 64-bit fingerprints of its texts into counting quotient
filters: a fingerprint is split into a quotient, whose high bits name the
filter's block, and a remainder; a block holds its remainders sorted, with a
count each, so it is lossless. Blocks of the same number merge by their sorted
remainders, and what counts more than one after the merge may have a copy. Only
texts with such a fingerprint are grouped, by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import repeat_rows
from tapeloom.session import materialize

#: Fingerprints that one merged block holds, about; blocks are so many that no task's memory grows with the input.
BLOCK_ROWS = 1 << 18
#: Fingerprints a task gathers before it writes its filter out.
FILTER_ROWS = 1 << 20
#: Repeated fingerprints that may be broadcast: 16 bytes each, 16 MB in all. More are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
FILTER = "block int, remainders binary, counts binary"


def block_bits(rows: int) -> int:
    """Bits of the quotient that number the blocks."""
    return max(0, (max(rows, 1) // BLOCK_ROWS).bit_length())


def filter_of(fingerprints: np.ndarray, bits: int) -> pa.RecordBatch:
    """The blocks of the counting quotient filter of some fingerprints (unsigned)."""
    values, counts = np.unique(fingerprints, return_counts=True)
    blocks = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    remainders = values & np.uint64(2 ** (64 - bits) - 1)
    numbers, starts = np.unique(blocks, return_index=True)
    ends = [*starts[1:], len(values)]
    return pa.RecordBatch.from_arrays([
        pa.array(numbers.astype(np.int32)),
        pa.array([remainders[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    ], names=["block", "remainders", "counts"])


def merged(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Remainders and counts of several filters' blocks of one number."""
    remainders = np.concatenate([np.frombuffer(r, np.uint64) for r, _ in parts])
    counts = np.concatenate([np.frombuffer(c, np.int64) for _, c in parts])
    order = np.argsort(remainders, kind="stable")  # runs are sorted already: a merge
    remainders, counts = remainders[order], counts[order]
    starts = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]])
    return remainders[starts], np.add.reduceat(counts, starts)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp) of those that occur more than once in `fingerprints` (fp long); `rows` sizes the blocks."""
    bits = block_bits(rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= FILTER_ROWS:
                yield filter_of(np.concatenate(held), bits)
                held, size = [], 0
        if size:
            yield filter_of(np.concatenate(held), bits)

    def merge(group: pa.Table) -> pa.Table:
        remainders, counts = merged(list(zip(group["remainders"].to_pylist(), group["counts"].to_pylist(), strict=True)))
        high = np.uint64(group["block"][0].as_py()) << np.uint64(64 - bits) if bits else np.uint64(0)
        return pa.table({"fp": (remainders[counts > 1] | high).view(np.int64)})

    return fingerprints.mapInArrow(build, FILTER).groupBy("block").applyInArrow(merge, "fp long")


def suspects(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """`rows` (with text, fp) whose fingerprint has no second, and those to compare by bytes."""
    repeated = materialize(repeated_fingerprints(rows.select("fp"), total), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, "fp", "left_anti"), rows.join(repeated, "fp", "left_semi")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is the empty one. Of equal
    texts the row with the largest key stays; null keys are below all others, and of
    rows equal in key and text one stays. A very long text is hashed and compared
    whole, as one value. An empty table gives an empty table, other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    _, same = suspects(rows, docs.count())
    # Bytes decide: the text itself is the key, and copies meet as one row per task.
    same = same.groupBy("fp", "text").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = same.select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    narrow = rows.select("key", "fp", F.sha2("text", 256).alias("text_sha256"))
    counted = narrow.groupBy("key", "fp", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    joined = repeat_rows(counted.join(same, ["fp", "text_sha256"], "left"), "n", "i")
    single = F.col("group_size").isNull()
    return joined.select(
        F.col("key").alias(key),
        F.when(single, F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("i") == 0))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all columns: of equal texts the largest key, by the rules of `groups`.

    Of rows equal in key and text the one whose other columns are largest stays; these
    must be of types that can be ordered. Texts without a double are not moved.
    """
    others = [c for c in docs.columns if c not in (text, key)]
    rest = [F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)],
            F.col(text).isNull().alias("none")]
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.struct(*rest).alias("rest"))
    unique, same = suspects(rows.withColumn("fp", F.xxhash64("text")), docs.count())
    stay = same.groupBy("fp", "text").agg(F.max("rest").alias("rest"))
    names = {key: "rest.k"} | {c: f"rest.c{i}" for i, c in enumerate(others)}
    whole = F.when(~F.col("rest.none"), F.col("text"))
    return unique.select("text", "rest").unionByName(stay.select("text", "rest")).select(
        *[(whole if c == text else F.col(names[c])).alias(c) for c in docs.columns])
