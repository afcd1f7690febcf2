"""Sources and sinks S2-S10: bronze discovery and load, schema listing,
writers, JSON rows, CSV export and transcripts."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.windows import prefix_sums
from ledgerflow.sources.tables import CODEC, scan_view

log = logging.getLogger(__name__)


# -- filesystem helpers (Hadoop FileSystem: local, HDFS, object stores) ---------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _is_path(s: str) -> bool:
    return "/" in s or ":" in s


def list_sources(spark: SparkSession, db_or_dir: str) -> DataFrame:
    """S2 tables of a catalog database, or ``<name>.parquet`` entries of a
    directory; an error when there are none."""
    if _is_path(db_or_dir):
        fs, p = _fs(spark, db_or_dir)
        names = sorted(st.getPath().getName()[: -len(".parquet")] for st in fs.listStatus(p)
                       if st.getPath().getName().endswith(".parquet"))
    else:
        names = sorted(t.name for t in spark.catalog.listTables(db_or_dir))
    if not names:
        raise ValueError(f"no source tables in {db_or_dir}")
    return spark.createDataFrame([(n,) for n in names], "table string")


def scan_bronze(spark: SparkSession, root: str, tables, mapping: dict[str, str],
                skip_unreadable: bool = False) -> dict[str, DataFrame | None]:
    """S3 each source table with business column names (V1/V2).

    A table that cannot be read raises. With ``skip_unreadable`` it is logged
    and given as None; ``load_vault`` then leaves every vault table that it
    feeds as it was.

    Sources are not cached: each hub / link / satellite reads only its
    columns from parquet (column pruning), which at scale is cheaper than
    materialising whole wide tables in executor memory."""
    from ledgerflow.operators.vault import rename_by_map
    out: dict[str, DataFrame | None] = {}
    for t in tables:
        try:
            df = scan_view(spark, root, t) if _is_path(root) else spark.table(f"{root}.{t}")
            out[t] = rename_by_map(df, mapping)
        except Exception as e:
            if not skip_unreadable:
                raise
            log.warning("could not read %s: %s", t, e)
            out[t] = None
    return out


def collect_schema(sources: dict[str, DataFrame]) -> DataFrame:
    """S4 (table, column, position, type) for every source (metadata only)."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString())
            for t, df in sources.items() if df is not None
            for i, f in enumerate(df.schema.fields)]
    spark = next(df for df in sources.values() if df is not None).sparkSession
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def schema_map(sources: dict[str, DataFrame]) -> dict[str, list[str]]:
    return {t.upper(): list(df.columns) for t, df in sources.items() if df is not None}


def write_table(df: DataFrame, path: str, mode: str = "overwrite", options: dict[str, str] | None = None) -> int:
    """S5 write parquet (schema written even when empty) and return the row
    count, observed during the write itself (one job, not three)."""
    obs = Observation()
    (df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("compression", CODEC)
     .options(**(options or {})).parquet(path))
    rows = obs.get.get("rows", 0) if obs.get else 0
    log.info("wrote %s rows to %s", rows, path)
    return int(rows)


PART_CHARS = 1 << 20            # code points of a document part, about


def assemble_transcript(blocks: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """S10 the Markdown document of each conversation in numbered parts
    (session_id, part, document): its blocks of ``export_transcript`` in order,
    one line feed between them, and one line feed between parts.

    A block belongs to part (code points before it) / ``part_chars``, so a part
    holds at most ``part_chars`` and one block, and the conversation may have any
    length. The code points before a block are segmented prefix sums
    (``prefix_sums``: a hot conversation is cut by ranges, and the job that
    writes them runs when this is called); nothing larger than a part is ever
    gathered. Conversations up to ``part_chars`` are one part, number 0."""
    own = blocks.select("session_id", "line_no", "text")
    before = prefix_sums(own, ["session_id"], [F.col("line_no").asc_nulls_first()],
                         value=F.char_length("text").cast("bigint") + 1)
    parts = before.withColumn("part", F.floor(F.col("_before") / F.lit(part_chars)))
    return (parts.groupBy("session_id", "part")
            .agg(F.array_sort(F.collect_list(F.struct("_before", "text"))).alias("_b"))
            .select("session_id", "part",
                    F.array_join(F.transform("_b", lambda b: b["text"]), "\n").alias("document")))


def reset_target(spark: SparkSession, root: str, keep: list[str],
                 groups=("hubs", "links", "satellites")) -> list[str]:
    """S6 remove previously written tables that are no longer in the model
    (tables still in the model are replaced by the overwrite itself)."""
    removed = []
    for g in groups:
        fs, p = _fs(spark, f"{root.rstrip('/')}/{g}")
        if not fs.exists(p):
            continue
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name not in keep:
                fs.delete(st.getPath(), True)
                removed.append(f"{g}/{name}")
    return removed


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """S8 CSV with a header. ``single_file`` only for bounded report frames."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """S9 one JSON object per row: numbers in full, dates and timestamps as ISO
    text, nulls written."""
    return df.select(F.to_json(F.struct(*df.columns),
                              {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
                               "dateFormat": "yyyy-MM-dd",
                               "ignoreNullFields": "false"}).alias("json"))


TRANSCRIPT_HEADER = "# Conversation\n"


def export_transcript(messages: DataFrame, session: str = "session_id",
                      order: str = "turn_index", summaries: DataFrame | None = None) -> DataFrame:
    """S10 Markdown transcript per conversation as ordered blocks
    (session_id, line_no, text): the header (-2), the summary of conversations
    that ``summaries`` (session_id, summary) names (-1), then one block per
    message in turn order. Concatenating a session's blocks by line_no with
    newlines gives the document; no conversation is gathered into one row."""
    label = F.when(F.col("role") == "user", F.lit("**User**")).otherwise(F.lit("**Assistant**"))
    body = messages.select(
        F.col(session).alias("session_id"),
        F.col(order).cast("bigint").alias("line_no"),
        F.concat(label, F.lit("\n\n"), F.coalesce(F.col("content"), F.lit("")),
                 F.lit("\n\n---\n")).alias("text"))
    head = messages.select(F.col(session).alias("session_id")).distinct().select(
        "session_id", F.lit(-2).cast("bigint").alias("line_no"), F.lit(TRANSCRIPT_HEADER).alias("text"))
    out = head.unionByName(body)
    if summaries is None:
        return out
    told = summaries.filter("summary != ''").select(
        "session_id", F.lit(-1).cast("bigint").alias("line_no"),
        F.concat(F.lit("**Summary**\n\n"), F.col("summary"), F.lit("\n\n---\n")).alias("text"))
    # a summary without messages still makes a document
    alone = told.join(head, "session_id", "left_anti").withColumn("line_no", F.lit(-2).cast("bigint")).withColumn(
        "text", F.lit(TRANSCRIPT_HEADER))
    return out.unionByName(told).unionByName(alone)


def write_transcripts(blocks: DataFrame, path: str) -> None:
    """Write the blocks of all sessions in order as Parquet (session_id,
    line_no, text): range-partitioned on (session, line) and sorted, so that a
    session lies in one file or a few neighbouring ones, found by row-group
    statistics, and millions of sessions do not make millions of folders. A
    very long conversation is split over several tasks in order."""
    (blocks.repartitionByRange("session_id", "line_no").sortWithinPartitions("session_id", "line_no")
     .write.mode("overwrite").parquet(path))


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint directory for written tables."""
    from ledgerflow.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), *parts)
