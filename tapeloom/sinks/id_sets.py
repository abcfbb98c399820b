"""Ids stored so far, asked by batches of ids: what a batch reads doesn't grow with what is stored.

The newest ids lie in a folder per batch. ``FAN`` such folders become a part of level 1 and
``FAN`` parts of a level one of the next, so parts stay few and an id is rewritten once a
level. A part deals its ids by their hash into cells of about ``CELL_IDS``, as many as it
needs, and has Bloom filters beside each cell: bitmaps of 4 KB for about ``BLOCK_IDS`` ids
each. A batch opens the filters of the cells its own ids fall into, and the ids themselves
only where a filter says maybe. What filters say is never an answer: ids are compared.

A part counts once its filters are complete, and its sources are deleted after that, so a
merge that stops anywhere loses nothing; ids that are then there twice are one row after the
next merge that meets both. One merge runs at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sinks.lake import spread_by
from tapeloom.sources import paths

IDS_DDL = "message_id string, batch string"
FILTERS_DDL = "block int, bits binary, part string, cell int"
CELLS_DDL = "message_id string, batch string, part string, cell int"
FAN = 16
CELL_IDS, BLOCK_IDS = 1 << 16, 1 << 11
#: Bits of the bitmap that Spark's aggregate builds, and how many of them an id sets.
FILTER_BITS, PROBES = 1 << 15, 5

#: A folder of ids: (part, cell).
Cell = tuple[str, int]


def _hash():
    return F.xxhash64("message_id")


def _cell(bits: int):
    return _hash().bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _block():
    return F.shiftrightunsigned(_hash(), 48).bitwiseAND(F.lit(CELL_IDS // BLOCK_IDS - 1)).cast("int")


def _probes():
    return [F.pmod(F.xxhash64("message_id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(PROBES)]


def _is_set(bits, probe):
    byte = F.substring(bits, (F.floor(probe / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (probe % 8).cast("int")) == 1


def parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete parts, ``<level>-<bits of its cell numbers>-<unique>``."""
    root = f"{path}_filters"
    names = paths.children(spark, root) if paths.exists(spark, root) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("part=") and paths.exists(spark, f"{root}/{n}/_SUCCESS"))


def _level(part: str) -> int:
    return int(part.split("-")[0])


def _open(spark: SparkSession, root: str, cells: list[Cell], ddl: str) -> DataFrame:
    folders = [f"{root}/part={part}/cell={cell}" for part, cell in cells]
    return spark.read.schema(ddl).option("basePath", root).parquet(*folders) if folders else spark.createDataFrame([], ddl)


def _pairs(df: DataFrame) -> list[Cell]:
    return sorted((x["part"], x["cell"]) for x in df.select("part", "cell").distinct().collect())


def _dealt(ids: DataFrame, names: list[str]) -> DataFrame:
    """Each id once per part, with its cell there."""
    there = [F.struct(F.lit(n).alias("part"), _cell(int(n.split("-")[1])).alias("cell")) for n in names]
    return ids.select("message_id", F.explode(F.array(*there)).alias("at")).select("message_id", "at.part", "at.cell")


def touched(ids: DataFrame, path: str, names: list[str]) -> list[Cell]:
    """The cells that ``ids`` fall into and that hold any; the driver sees a name per folder, as a listing does."""
    spark = ids.sparkSession
    held = {(n, int(x.split("=")[1])) for n in names for x in paths.children(spark, f"{path}_filters/part={n}") if x.startswith("cell=")}
    return [x for x in _pairs(_dealt(ids, names)) if x in held] if held else []


def maybe(ids: DataFrame, path: str, names: list[str], cells: list[Cell]) -> list[Cell]:
    """Of ``cells`` those whose filters don't rule out all of ``ids``."""
    filters = _open(ids.sparkSession, f"{path}_filters", cells, FILTERS_DDL)
    asked = _dealt(ids, names).withColumns({"block": _block(), **{f"p{i}": p for i, p in enumerate(_probes())}})
    hit = reduce(lambda a, b: a & b, [_is_set(F.col("bits"), F.col(f"p{i}")) for i in range(PROBES)])
    return _pairs(asked.join(filters, ["part", "cell", "block"]).filter(hit))


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """The ids not yet in a part: those of fewer than ``FAN`` batches and what a stopped merge left."""
    return spark.read.schema(IDS_DDL).parquet(path) if paths.exists(spark, path) else spark.createDataFrame([], IDS_DDL)


def candidates(ids: DataFrame, path: str) -> DataFrame:
    """Stored rows (message_id, batch) that hold every one of ``ids`` that is stored, and few others."""
    spark, names = ids.sparkSession, parts(ids.sparkSession, path)
    new = waiting(spark, path)
    cells = touched(ids, path, names) if names else []
    likely = maybe(ids, path, names, cells) if cells else []
    return new.unionByName(_open(spark, f"{path}_cells", likely, CELLS_DDL).select("message_id", "batch")) if likely else new


def _write_part(ids: DataFrame, path: str, level: int) -> str:
    spark = ids.sparkSession
    bits = max(0, -(-ids.count() // CELL_IDS) - 1).bit_length()
    name = f"{level}-{bits}-{uuid.uuid4().hex}"
    cells = f"{path}_cells/part={name}"
    dealt = ids.distinct().withColumn("cell", _cell(bits))
    spread_by(dealt, "cell").write.partitionBy("cell").parquet(cells)
    written = spark.read.schema("message_id string, cell int").parquet(cells)
    probes = written.select("cell", _block().alias("block"), F.explode(F.array(*_probes())).alias("probe"))
    filters = probes.groupBy("cell", "block").agg(F.bitmap_construct_agg("probe").alias("bits"))
    spread_by(filters, "cell").write.partitionBy("cell").parquet(f"{path}_filters/part={name}")
    return name


def merge_full_levels(spark: SparkSession, path: str) -> int:
    """Merge levels of ``FAN`` members, lowest first; the number of parts written."""
    written = 0
    batches = [x for x in paths.children(spark, path) if x.startswith("batch=")] if paths.exists(spark, path) else []
    if len(batches) >= FAN:
        _write_part(spark.read.schema(IDS_DDL).option("basePath", path).parquet(*[f"{path}/{x}" for x in batches]), path, 1)
        for x in batches:
            paths.delete(spark, f"{path}/{x}")
        written += 1
    level = 1
    while True:
        names = parts(spark, path)
        same = [x for x in names if _level(x) == level]
        if len(same) >= FAN:
            root = f"{path}_cells"
            rows = spark.read.schema(CELLS_DDL).option("basePath", root).parquet(*[f"{root}/part={x}" for x in same])
            _write_part(rows.select("message_id", "batch"), path, level + 1)
            for x in same:  # the filters first: without them a part doesn't count
                paths.delete(spark, f"{path}_filters/part={x}")
                paths.delete(spark, f"{root}/part={x}")
            written += 1
        if not any(_level(x) > level for x in parts(spark, path)):
            return written
        level += 1
