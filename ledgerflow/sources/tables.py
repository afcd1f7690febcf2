"""S1 scan_view: read one named table from a directory of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")

# Parquet codec of every table that the library keeps. Hash keys are hex text:
# Zstandard takes about 36 bytes for one, Snappy all 66.
CODEC = "zstd"
# Writer options of tables of hash keys: texts are stored without their lengths,
# 33.5 bytes a key instead of 35.3 (32 are the least).
HASH_PAGES = {"parquet.writer.version": "v2"}

# Rows up to which a small side of a join is broadcast (some tens of MB).
SMALL_ROWS = 1 << 20


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted at
    once, up to that number), else as it is. For sides of a few columns that
    meet a far larger table: a size estimate of a filtered scan is that of the
    whole table and would have the large side shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def scan_view(spark: SparkSession, root: str, name: str,
              schema: StructType | None = None) -> DataFrame:
    """S1: lazy parquet scan; projection and filters are pushed into the scan
    by Catalyst. With ``schema`` the footer-inferred schema is replaced by the
    declared one (only the declared columns are read). The files are listed
    anew on each call."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(root, name))


class Tables:
    """Lazily scanned raw tables of one directory: ``Tables(spark, d).lineitem``.
    An instance scans each table once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._scans: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in RAW_TABLES:
            raise AttributeError(name)
        if name not in self._scans:
            self._scans[name] = scan_view(self.spark, self.root, name)
        return self._scans[name]
