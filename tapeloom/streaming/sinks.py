"""Running streams and writing their batches so that a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tapeloom.operators import merge
from tapeloom.session import ROCKSDB
from tapeloom.sinks import lake as lake_sink
from tapeloom.sources import paths

BatchFn = Callable[[DataFrame, int], None]

CHECKPOINT_SECONDS = 60


def start(
    df: DataFrame, batch: BatchFn, checkpoint: str, mode: str = "append", every_seconds: int | None = CHECKPOINT_SECONDS
) -> StreamingQuery:
    """A stream whose progress is committed after its batch is written.

    ``every_seconds=None`` processes what is there, in as many batches as the source's
    limits ask for, and stops.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch)
    if every_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{every_seconds} seconds").start()


def drain(df: DataFrame, batch: BatchFn, checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = start(df, batch, checkpoint, mode, None)
    query.awaitTermination()
    return query


def to_console(df: DataFrame, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("console").trigger(availableNow=True).start()


def batch_folder(path: str) -> BatchFn:
    """Each batch in a folder of its own, which a repetition replaces."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Deltas of a keyed table are folded into its base when they are so many, or so large beside it.
FOLD_DELTAS, FOLD_SHARE = 32, 0.5
Combine = Callable[[DataFrame, DataFrame], DataFrame]


def _parts(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The batches up to which there is a complete base, and the complete deltas, both rising."""
    names = paths.children(spark, path) if paths.exists(spark, path) else []
    found = {
        kind: sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and paths.exists(spark, f"{path}/{n}/_SUCCESS"))
        for kind in ("base", "delta")
    }
    return found["base"], found["delta"]


def _part(path: str, kind: str, batch_id: int) -> str:
    return f"{path}/{kind}-{batch_id}"


def merged_on_read(spark: SparkSession, path: str, combine: Combine) -> DataFrame:
    """A keyed table as it is now: ``combine(base, deltas)``, each with the column batch_id."""
    bases, deltas = _parts(spark, path)
    upto = bases[-1] if bases else -1
    new = [_part(path, "delta", b) for b in deltas if b > upto]
    if not bases and not new:
        raise FileNotFoundError(f"{path} holds no complete batch")
    base = spark.read.parquet(_part(path, "base", upto)) if bases else None
    fresh = spark.read.parquet(*new) if new else base.limit(0)
    return combine(fresh.limit(0) if base is None else base, fresh)


def fold(spark: SparkSession, path: str, combine: Combine) -> None:
    """Write a new base of all deltas so far; readers turn to it once it is complete.

    A fold that stops anywhere leaves the table as it was or a complete new base. What the fold
    before this one took in is deleted, not what this one does, so a reader that opened the table
    before finds its files.
    """
    bases, deltas = _parts(spark, path)
    merged_on_read(spark, path, combine).write.mode("overwrite").parquet(_part(path, "base", deltas[-1]))
    upto = bases[-1] if bases else -1
    for b in bases[:-1]:
        paths.delete(spark, _part(path, "base", b))
    for b in deltas:
        if b <= upto:
            paths.delete(spark, _part(path, "delta", b))


def keyed_table(path: str, combine: Combine, prepare: Callable[[DataFrame, int], DataFrame] = lambda df, _: df) -> BatchFn:
    """A keyed table merged on read: a batch writes its own rows and nothing else.

    Each batch is a delta of its own, which its repetition replaces; a repeated batch that the
    base holds already is passed over by readers. When the deltas are many, or more than a share of
    the base in bytes, they are folded into a new base. Only names and sizes of files reach the driver.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        prepared = prepare(df, batch_id).withColumn("batch_id", F.lit(batch_id).cast("long"))
        prepared.write.mode("overwrite").parquet(_part(path, "delta", batch_id))
        bases, deltas = _parts(spark, path)
        new = [b for b in deltas if not bases or b > bases[-1]]
        held = paths.size(spark, _part(path, "base", bases[-1])) if bases else 0
        if len(new) >= FOLD_DELTAS or (bases and sum(paths.size(spark, _part(path, "delta", b)) for b in new) > FOLD_SHARE * held):
            fold(spark, path, combine)

    return write


def _newest(keys: Sequence[str]) -> Combine:
    def combine(base: DataFrame, deltas: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(F.desc("batch_id"))
        return base.unionByName(deltas).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).drop("_rn")

    return combine


def latest_table(path: str, keys: Sequence[str]) -> BatchFn:
    """Update mode: of every key the version of the newest batch; see `keyed_table`."""
    return keyed_table(path, _newest(keys))


def latest_of(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of a ``latest_table``."""
    return merged_on_read(spark, path, _newest(keys)).drop("batch_id")


def snapshot(path: str) -> BatchFn:
    """The table is the newest batch (complete mode)."""

    def write(df: DataFrame, batch_id: int) -> None:
        lake_sink.replace_table(df, path)

    return write


def lake(path: str, partitions: Sequence[str] = ("ingest_date",), dead_path: str | None = None) -> BatchFn:
    """Rows by day; rows without one go to ``dead_path``.

    Files of a batch carry its number as innermost partition, so repeating it is harmless. Rows are not
    shuffled here: `lake_sink.publish_days` brings those of a day together.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            dated, dead = lake_sink.dead_letters(df, partitions[0])
            lake_sink.write_lake(
                dated.withColumn("batch_id", F.lit(batch_id)), path, (*partitions, "batch_id"), mode="overwrite", spread=False
            )
            if dead_path:
                dead.write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}")
        finally:
            df.unpersist()

    return write


def dispatch(
    routes: Mapping[str, Callable[[DataFrame], DataFrame]], column: str, path: str, dead_path: str | None = None
) -> BatchFn:
    """Per topic its own processing, ``DataFrame → DataFrame``, into its own folder; others go to ``dead_path``."""

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            for topic, process in routes.items():
                part = df.filter(F.col(column) == topic).transform(process)
                part.write.mode("overwrite").parquet(f"{path}/{topic}/batch_id={batch_id}")
            if dead_path:
                other = df.filter(F.col(column).isNull() | ~F.col(column).isin(list(routes)))
                other.write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}")
        finally:
            df.unpersist()

    return write


def _upserted(key: str, order: Sequence[str]) -> Combine:
    def combine(base: DataFrame, deltas: DataFrame) -> DataFrame:
        rank = [F.col("batch_id"), *[F.col(c) for c in order]]
        merged = merge.set_fields(base.drop("batch_id"), deltas, key, rank)
        return merged.withColumn("batch_id", F.lit(-1).cast("long"))  # deltas are always newer

    return combine


def upsert_table(path: str, key: str, order: Sequence[str]) -> BatchFn:
    """Field-wise upsert of partial documents into one table; those without a key are inserted once."""
    return keyed_table(path, _upserted(key, order), lambda df, batch_id: merge.with_keys(df, key, str(batch_id)))


def upserted_rows(spark: SparkSession, path: str, key: str, order: Sequence[str]) -> DataFrame:
    """The documents of an ``upsert_table``."""
    return merged_on_read(spark, path, _upserted(key, order)).drop("batch_id")
