"""Partitioned tables whose readers see one snapshot: the old one or the new one, never a part of each.

Every write puts its files into folders of its own, ``data/<partition>=<value>/_commit=<id>``,
which nobody reads yet. A snapshot is a numbered list of live folders; a commit writes the
next list beside the others and gives it its number by one rename, which fails if another
writer was faster and is then tried again on that writer's list. Files are never changed,
so a reader that opened the table keeps its rows until ``expire`` removes what no kept
snapshot names. A writer that stops on the way leaves folders without a list: no rows.

The driver handles one line per live folder, as any reader's listing of the table does.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeloom.sinks.lake import ROWS_PER_FILE, TARGET_FILE_BYTES, into_files, spread_by
from tapeloom.sources import paths

LIVE_DDL = "folder string, files bigint, bytes bigint"
#: Folder → (files, bytes).
Live = dict[str, tuple[int, int]]


def history(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots there are, oldest first."""
    lists = f"{path}/snapshots"
    return sorted(int(x) for x in paths.children(spark, lists) if x.isdigit()) if paths.exists(spark, lists) else []


def live_folders(spark: SparkSession, path: str, snapshot: int) -> Live:
    rows = spark.read.schema(LIVE_DDL).json(f"{path}/snapshots/{snapshot:09d}").collect()
    return {x["folder"]: (x["files"], x["bytes"]) for x in rows}


def newest(spark: SparkSession, path: str) -> tuple[int, Live]:
    numbers = history(spark, path)
    return (numbers[-1], live_folders(spark, path, numbers[-1])) if numbers else (0, {})


def read(spark: SparkSession, path: str, snapshot: int | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of a snapshot, the newest unless one is named; a table without rows needs ``schema``."""
    _, live = newest(spark, path) if snapshot is None else (snapshot, live_folders(spark, path, snapshot))
    if not live and schema is not None:
        return spark.createDataFrame([], schema)
    return _rows(spark, path, live)


def _rows(spark: SparkSession, path: str, folders, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{path}/data")
    rows = (reader.schema(schema) if schema else reader).parquet(*[f"{path}/data/{x}" for x in sorted(folders)])
    void = [f.name for f in rows.schema.fields if f.dataType.typeName() == "void"]  # a partition column of nulls alone
    return rows.drop("_commit").withColumns({x: F.col(x).cast("string") for x in void})


def commit(spark: SparkSession, path: str, change: Callable[[Live], Live], tries: int = 20) -> int:
    """Make ``change`` of the newest list the next snapshot, on whatever list is then the newest."""
    for _ in range(tries):
        number, live = newest(spark, path)
        after = change(live)
        if after == live and number:
            return number
        staged = f"{path}/snapshots/staged-{uuid.uuid4().hex}"
        lines = spark.createDataFrame([(k, *v) for k, v in sorted(after.items())], LIVE_DDL)
        lines.coalesce(1).write.json(staged)
        if paths.rename_new(spark, staged, f"{path}/snapshots/{number + 1:09d}"):
            return number + 1
        paths.delete(spark, staged)
    raise RuntimeError(f"{tries} other writers were faster on {path}")


def _store(rows: DataFrame, path: str, partition: str, rows_per_file: int = ROWS_PER_FILE) -> Live:
    """Write rows into folders of a new commit; tells its folders."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn("_commit", F.lit(name)).write.mode("append").partitionBy(partition, "_commit").option(
        "maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    stored: Live = {}
    for file, size, _ in paths.found(spark, f"{path}/data/{partition}=*/_commit={name}/*.parquet"):
        folder = "/".join(file.split("/")[-3:-1])
        files, total = stored.get(folder, (0, 0))
        stored[folder] = files + 1, total + size
    return stored


def _partition(folder: str) -> str:
    return folder.split("/")[0]


def append(df: DataFrame, path: str, partition: str = "ingest_date") -> int:
    """Add rows; the number of the snapshot that has them."""
    fresh = _store(spread_by(df, partition), path, partition)
    return commit(df.sparkSession, path, lambda live: live | fresh)


def overwrite(df: DataFrame, path: str, partition: str = "ingest_date") -> int:
    """Replace the partitions that ``df`` has, all at once, even if ``df`` reads the table."""
    fresh = _store(spread_by(df, partition), path, partition)
    replaced = {_partition(x) for x in fresh}
    return commit(df.sparkSession, path, lambda live: {k: v for k, v in live.items() if _partition(k) not in replaced} | fresh)


def compact(
    spark: SparkSession, path: str, partition: str = "ingest_date", min_files: int = 5, target_bytes: int = TARGET_FILE_BYTES
) -> int:
    """Bring partitions of at least ``min_files`` files into files of about ``target_bytes``; the number of partitions.

    Which they are the list tells, without looking at the files. Appends that come
    meanwhile stay beside the compacted folder; a partition that was replaced meanwhile
    keeps its new rows.
    """
    _, live = newest(spark, path)
    sources: dict[str, list[str]] = {}
    for folder in live:
        sources.setdefault(_partition(folder), []).append(folder)
    todo = {}
    for name, folders in sources.items():
        files, size = (sum(live[x][i] for x in folders) for i in (0, 1))
        needed = max(1, -(-size // target_bytes))
        if files >= min_files and needed < files:
            todo[name] = needed
    if not todo:
        return 0
    # The type of the partition column is that of all its values, not of those at work here.
    whole = _rows(spark, path, live).schema
    rows = _rows(spark, path, [x for name in todo for x in sources[name]], whole)
    by_value = {name.split("=", 1)[1]: n for name, n in todo.items()}
    fresh = _store(into_files(rows, F.col(partition).cast("string"), by_value), path, partition)

    def swap(now: Live) -> Live:
        after = dict(now)
        for name in todo:
            if all(x in now for x in sources[name]):
                for x in sources[name]:
                    del after[x]
                after |= {k: v for k, v in fresh.items() if _partition(k) == name}
        return after

    commit(spark, path, swap)
    return len(todo)


def expire(spark: SparkSession, path: str, keep: int = 2, orphans_after_s: float = 86_400) -> int:
    """Forget all but the newest ``keep`` snapshots and remove the folders only they had; the number of folders.

    Folders in no snapshot at all may belong to a write on its way and are removed only
    after ``orphans_after_s`` seconds.
    """
    numbers = history(spark, path)
    kept, old = numbers[-keep:], numbers[:-keep]
    named = set().union(*[live_folders(spark, path, x) for x in kept])
    forgotten = set().union(*[live_folders(spark, path, x) for x in old]) - named
    stale = (time.time() - orphans_after_s) * 1000
    gone = 0
    for folder, _, changed in paths.found(spark, f"{path}/data/*=*/_commit=*"):
        name = "/".join(folder.split("/")[-2:])
        if name in forgotten or (name not in named and changed < stale):
            paths.delete(spark, f"{path}/data/{name}")
            gone += 1
    for x in old:
        paths.delete(spark, f"{path}/snapshots/{x:09d}")
    return gone
