"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that every job relies on. Cluster-specific sizing
# (shuffle partitions, executor memory) is left to the submitter; AQE
# re-plans shuffle partition counts, join strategies and skewed
# partitions from runtime statistics.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for a large cluster (~1000 executors, ~100 TB of parquet). Shuffles
# start wide and AQE coalesces them to ~256 MB partitions, so a partition
# fits an executor core's memory share; hot keys in joins are split by AQE's
# skew handling; scans split files into 256 MB tasks; a join side is
# broadcast only when AQE measures it under 64 MB; runtime bloom filters
# prune the big side of selective joins before the shuffle.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerflow", profile: str | None = None) -> SparkSession:
    """Return the active session, or build one (local runs and tests).
    ``profile="cluster"`` applies ``CLUSTER_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if profile == "cluster":
        for k, v in CLUSTER_CONF.items():
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must name a shared folder and is used as is.
    Only a local master without it gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerflow-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_REMOVING: dict[str, list] = {}         # session: [callers inside, the setting before them]
_REMOVING_LOCK = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, the shuffle files of a query or write go when it ends, not when
    the driver happens to collect what refers to them: a job of many steps takes
    the disk of its largest ones. A DataFrame that is run a second time makes
    its shuffles anew. May be nested and entered by several threads."""
    own = spark._jsparkSession.sessionUUID()
    with _REMOVING_LOCK:
        state = _REMOVING.setdefault(own, [0, spark.conf.get(_REMOVE, None)])
        state[0] += 1
        spark.conf.set(_REMOVE, "true")
    try:
        yield
    finally:
        with _REMOVING_LOCK:
            state[0] -= 1
            if not state[0]:
                del _REMOVING[own]
                if state[1] is None:
                    spark.conf.unset(_REMOVE)
                else:
                    spark.conf.set(_REMOVE, state[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    back: a stable input for several passes, without the lineage behind it.
    Runs the job at once; the folder stays until the user clears it."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "written", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
