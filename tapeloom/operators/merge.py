"""Merges for tables without MERGE: each returns the new content as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ranking import last_per_key


def new_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Source rows whose key the target lacks, one per key; NULL keys are left out."""
    valid = source.na.drop(subset=list(keys))
    unique = last_per_key(valid, keys, order) if order else valid.dropDuplicates(list(keys))
    return unique.join(target.select(*keys), list(keys), "left_anti")


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """Target plus the source rows that are new to it."""
    return target.unionByName(new_rows(source, target, keys, order), allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Matched rows take the source's values, except the ``keep`` columns; new rows are added."""
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in target.columns], F.lit(True).alias("_in_t"))
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_in_s"))
    on = [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys]
    joined = t.join(s, on, "full_outer")

    def pick(c: str) -> Column:
        old, new = F.col(f"_t_{c}"), F.col(f"_s_{c}") if c in source.columns else F.lit(None)
        if c in keep:
            return F.when(F.col("_in_t"), old).otherwise(new).alias(c)
        if c not in source.columns:
            return old.alias(c)
        return F.when(F.col("_in_s"), new).otherwise(old).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def set_fields(target: DataFrame, updates: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Field-wise upsert of partial documents: what an update leaves out keeps its value.

    Several updates to one document apply in ``order``; per field the latest value given
    wins. That is one aggregation with map-side combine, not a list of updates per key.
    """
    fields = [c for c in updates.columns if c != key]
    rank = F.struct(*order)
    latest = updates.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields if c in target.columns]
    )
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in target.columns])
    joined = t.join(latest, F.col(f"_t_{key}") == F.col(key), "full_outer")
    return joined.select(
        *[
            (F.coalesce(F.col(c), F.col(f"_t_{c}")) if c in latest.columns else F.col(f"_t_{c}")).alias(c)
            for c in target.columns
        ]
    )


def with_keys(docs: DataFrame, key: str, batch: str) -> DataFrame:
    """Documents without a key get one from the batch's name, their content and their number among equals.

    Equal documents are counted, not ranked, and a repeated batch gives the same keys.
    """
    rest = [c for c in docs.columns if c != key]
    loose = docs.filter(F.col(key).isNull()).groupBy(*rest).agg(F.count(F.lit(1)).alias("_n"))
    numbered = loose.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    named = F.concat_ws("-", F.lit("auto"), F.lit(batch), content, F.col("_i").cast("string"))
    return docs.filter(F.col(key).isNotNull()).unionByName(numbered.withColumn(key, named).drop("_n", "_i"))


def apply_documents(target: DataFrame, docs: DataFrame, key: str, order: Sequence[Column], batch: str = "0") -> DataFrame:
    """As ``set_fields``; documents without a key are inserts of the batch, once however often it is applied."""
    return set_fields(target, with_keys(docs, key, batch), key, order)


def clamp(df: DataFrame, column: str, ceiling) -> DataFrame:
    """Values above the ceiling are set to it; ``was_clamped`` tells which."""
    over = F.coalesce(F.col(column) > F.lit(ceiling), F.lit(False))
    marked = df.withColumn("was_clamped", over)
    return marked.withColumn(column, F.when(F.col("was_clamped"), F.lit(ceiling)).otherwise(F.col(column)))
