"""A corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing, each stage on all its predecessor kept.

Every stage is written as Parquet below the shared folder and read again, so a lost
executor costs one stage's part at most. The stages up to mixing return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import exact_dedup, mixing, packing, resemblance, toxicity
from tapeloom.llm.common import held_out, table
from tapeloom.session import materialize


def few_at_once(spark: SparkSession) -> None:
    """Texts go to the workers in Arrow batches of few rows: a batch is held several times on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. The lexicon is learnt as in the query: one fold of the labels is never seen.

    Null and empty texts match nothing; repeated rows are told alike; see `toxicity.accepted`.
    """
    few_at_once(spark)
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return toxicity.accepted(docs, lexicon)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, null last; a null text equals the empty one. Of repeated rows one stays."""
    few_at_once(spark)
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 of their five-word shingles the document with the smallest id, null last.

    SimHash fingerprints link through pivot distance tables, as in the query, and whole sets decide; what four bits do
    not link is found by prefixes. Texts without words link; of repeated rows one stays; see `resemblance.one_of_each`.
    """
    few_at_once(spark)
    return resemblance.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target proportions of their sources, some twice, some not at all.

    A null source is one like any other; texts without words are as good as any, and change no proportion.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, and the windows they fill; a null or empty text is the end sign alone."""
    few_at_once(spark)
    docs = docs.select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, ids=False)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The lexicon is learnt and the texts are tokenised: SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, beginning with the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
