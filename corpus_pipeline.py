"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and gives what it reads back to the
next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from ledgerflow.llm.common import only_kept, stored, table

MAX_PASSES = 2.0        # passes over the most repeated source
PACKING_CACHE = 100_000     # pieces a worker keeps: the stages share the executors' memory


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more (operator 4)."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts (operator 9)."""
    return only_kept(docs, exact_dedup.exact_dedup(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (operator 2), also of
    groups whose documents have null or repeated ids."""
    return only_kept(docs, near_dedup.one_of_each(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources (operator 1): the least repeated source is read once,
    so every document stays; small sources are read up to MAX_PASSES times.
    The files, in order of their numbers, hold the rows in the mixed order."""
    mixed = mixing.mix(docs, repetition=MAX_PASSES, order=True)
    return (mixed.repartitionByRange("mix_order").sortWithinPartitions("mix_order")
            .select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, in the order of the mixed files, into sequences
    (operator 6): one row a piece."""
    return packing.pack(docs, cache_entries=PACKING_CACHE, file_order=True)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# Learned scores, shingle links and token ids have no SQL; tests/llm holds the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
