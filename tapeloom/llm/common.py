"""Helpers shared by the operators: texts in Arrow batches, repeated rows, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tapeloom.session import materialize

#: Bytes of the longest text a model is fitted on.
LONGEST_SAMPLED = 1 << 16
#: Bytes of text handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 8 << 20


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the binary column holds about `most` bytes a piece."""
    sizes = batch.column(column)
    start = held = 0
    for i, size in enumerate(pc.binary_length(sizes).to_pylist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    rows: DataFrame, text: str, fields: list[StructField], make: Callable, beside: str | None = None, most: int = SLICE_BYTES
) -> DataFrame:
    """`rows` without `text`, and with the columns `fields` computed from whole texts in Arrow batches.

    `make()` is called once per task and returns a function from a list of bytes
    to one Arrow array per field; with `beside`, from that list and the values of that
    column. `most` bounds the bytes of text it gets at once. Columns keep their place, so names may clash.
    """
    keep = [f for f in rows.schema.fields if f.name != text]
    schema = StructType([*keep, *fields])
    carried = rows.select(*[F.col(f"`{f.name}`") for f in keep], utf8(F.col(f"`{text}`")).alias("\u0001text"))
    at, names = len(keep), [f.name for f in schema.fields]
    told = [i for i, f in enumerate(keep) if f.name == beside][:1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at, most):
                arrays = work(part.column(at).to_pylist(), *[part.column(i).to_pylist() for i in told])
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *arrays], names=names)

    return carried.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with "\u0001row", a number of each row, written once: a second scan may cut the table elsewhere and number it anew."""
    return materialize(docs.withColumn("\u0001row", F.monotonically_increasing_id()), "numbered")


def repeat_rows(rows: DataFrame, count: str, index: str) -> DataFrame:
    """Each row `count` times, numbered from 0 in `index`; two short sequences, so no array grows with a hot group."""
    step = 4096
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), (F.col(count) - 1).cast("long"), F.lit(step).cast("long")))
    last = F.least(F.col("\u0001chunk") + (step - 1), F.col(count).cast("long") - 1)
    return (
        rows.where(F.col(count) > 0)
        .withColumn("\u0001chunk", chunk)
        .withColumn(index, F.explode(F.sequence(F.col("\u0001chunk"), last)))
        .drop("\u0001chunk")
    )


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as the text ''."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limits: dict[int, int]) -> DataFrame:
    """(text, y) of the labelled documents, at most `limits[y]` of each class, those with the smallest hash of the id.

    Ids labelled in both ways are left out, as are null ids and labels, and texts over
    LONGEST_SAMPLED bytes; of several texts of an id the smallest is taken. So rows and
    bytes of what a model is fitted on are bounded; what is scored never is. Only ids
    travel to the sort, and the chosen ones are broadcast: at most the sum of the limits.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("\u0001y"))
        .where(F.col("y") == F.col("\u0001y")).select("doc_id", "y")
    )
    parts = [
        ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in limits.items()
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    texts = docs.select("doc_id", utf8("text").alias("text")).where(F.octet_length("text") <= LONGEST_SAMPLED)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("y").cast("int").alias("y")).agg(
        F.min("text").alias("text"))
