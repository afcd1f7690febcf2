"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import ensure_checkpoint_dir

BATCH_ROWS = 1000           # rows of an Arrow batch in jobs that run here


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with (in any letter case), for
    working columns."""
    prefix = "_lf_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let Arrow batches hold at most ``rows`` rows while a job runs: texts and
    ids are long rows, and a worker holds a few batches at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back. Arrow
    batches of the job hold ``batch_rows`` rows.

    This cuts the lineage: a lost executor costs the tasks that read the
    files, never the work behind them.
    """
    path = shared_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession, batch_rows):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame, text_col: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[text_col], F.lit(""))


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``max_rows``.

    Above the bound the join is left to a shuffle.
    """
    return F.broadcast(df) if rows <= max_rows else df


MAX_LISTED = 300_000        # rows of a broadcast list of dropped ids: about 30 MB


def only_kept(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              max_listed: int = MAX_LISTED) -> DataFrame:
    """The rows of ``docs`` that ``verdict`` (doc_id, row_hash, kept) keeps.

    Rows are found by id and xxhash64 of the text. Of rows equal in both, one
    stays if any was kept. The list of dropped rows is narrow; it is broadcast
    while it counts at most ``max_listed`` rows, and shuffled beyond that.
    """
    verdict = stored(verdict.select("doc_id", "row_hash", "kept"), "verdict")
    marks = (verdict.groupBy("doc_id", "row_hash")
             .agg(F.bool_or("kept").alias("twin"), F.count(F.lit(1)).alias("n"))
             .filter("not twin or n > 1"))
    rows, twins = marks.agg(F.count(F.lit(1)), F.count_if("twin")).first()
    p = own_prefix(docs)
    own = [f"{p}id", f"{p}hash", f"{p}twin"]
    marks = small(marks.select(*[F.col(c).alias(o) for c, o in zip(("doc_id", "row_hash", "twin"), own)]),
                  rows, max_listed)
    key = docs.withColumn(f"{p}text_hash", F.xxhash64(docs[text_col]))
    found = key.join(marks, key[id_col].eqNullSafe(marks[own[0]])
                     & (key[f"{p}text_hash"] == marks[own[1]]), "left")
    kept = found.filter(F.col(own[2]).isNull()).select(*docs.columns)
    if not twins:
        return kept
    again = found.filter(F.col(own[2])).dropDuplicates([id_col, f"{p}text_hash"])
    return kept.unionByName(again.select(*docs.columns))
