"""A written state table that a batch rewrites only where it has keys.

The merges M1, M3, M4 and M5 (``operators.state``) are functions of a state and
a batch of changes. ``StateTable`` keeps the state as Parquet in ``buckets``
hash buckets of the key. A merge reads and rewrites the buckets that the batch
touches, in a folder of its own, and then publishes a commit: a small file
that names the folder of every bucket. Until that file is there, readers see
the state before; a batch that fails leaves nothing but an unnamed folder.

    <root>/commits/00000007.json      {"buckets": {"12": "<folder>", ...}, ...}
    <root>/data/<folder>/_state_bucket=12/part-*.parquet
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerflow.session import written

BUCKET = "_state_bucket"


class CommitConflict(RuntimeError):
    """Another writer published the next commit first; merge again."""


class StateTable:
    """A state table below ``root``, a folder that all executors share.

    ``buckets`` bounds a commit file and what the driver holds; choose it so
    that a bucket (state size / buckets) is a fair task. Keys are unique in the
    state, so buckets are even, whatever keys the changes repeat. A null key
    is in one bucket like any other value; whether it matches is the merge's
    matter."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, keys: list[str],
               buckets: int = 1024) -> StateTable:
        """An empty table; an error if one is there."""
        if not set(keys) <= set(schema.names) or not keys or BUCKET in schema.names or buckets < 1:
            raise ValueError(f"keys {keys} and {buckets} buckets do not fit the columns {schema.names}")
        table = cls(spark, root)
        table._publish(0, {"keys": list(keys), "count": buckets, "schema": schema.jsonValue(), "buckets": {},
                           "batch": None})
        return table

    # -- commits --------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def version(self) -> int:
        """Number of the newest commit."""
        numbers = [int(n[:-5]) for n in self._folders("commits") if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            raise FileNotFoundError(f"no state table at {self.root}")
        return max(numbers)

    def commit(self, version: int | None = None) -> dict:
        """What a commit (the newest) names."""
        version = self.version() if version is None else version
        stream = self._fs().open(self._path("commits", f"{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, commit: dict) -> None:
        """The file appears whole under its name, by a rename that refuses to
        replace one. (A local file system only checks before it renames: there,
        one writer at a time.)"""
        jvm, fs = self.spark._jvm, self._fs()
        temp = self._path("commits", f".{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            temp.toUri(), self.spark._jsc.hadoopConfiguration())
        target = self._path("commits", f"{version:08d}.json")
        try:
            context.rename(temp, target, never)
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(target):
                raise CommitConflict(f"commit {version} of {self.root} is there already") from e
            raise

    # -- reading --------------------------------------------------------------
    def _scan(self, commit: dict, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(commit["buckets"].items())
                 if only is None or b in only]
        schema = StructType.fromJson(commit["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The state as of the newest commit (or an older one not yet vacuumed)."""
        return self._scan(self.commit(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The state rows of the listed keys, from those keys' buckets only.
        Runs a job that finds the buckets."""
        commit = self.commit()
        keys = written(keys.select(*commit["keys"]).distinct(), "state-keys")
        return self._scan(commit, self._touched(keys, commit)).join(keys, commit["keys"], "left_semi")

    # -- merging --------------------------------------------------------------
    @staticmethod
    def _bucket(commit: dict) -> Column:
        """The bucket by the keys in the state's own types, so that 1 and 1L meet."""
        kinds = {f.name: f.dataType for f in StructType.fromJson(commit["schema"])}
        return F.pmod(F.xxhash64(*[F.col(k).cast(kinds[k]) for k in commit["keys"]]), F.lit(commit["count"])).cast("int")

    def _touched(self, rows: DataFrame, commit: dict) -> set[str]:
        """At most ``buckets`` numbers."""
        return {str(r[0]) for r in rows.select(self._bucket(commit)).distinct().collect()}

    def merge(self, changes: DataFrame, fold, batch: int | None = None) -> int:
        """Replace the touched buckets by ``fold(state, changes)`` and return
        the version that holds it. ``fold`` gets all rows of the buckets in
        which the changes have keys and returns all that they hold from now on;
        it must keep rows without changes, as the merges of ``operators.state``
        do. ``changes`` must have the key columns and is written once, so that
        buckets and rows come from the same data.

        With ``batch`` (a rising number, such as a stream's batch id) a batch
        that is already in the state is left out, so one may be repeated after
        a failure. An empty batch commits nothing. Runs jobs at once."""
        version = self.version()
        commit = self.commit(version)
        if batch is not None and commit["batch"] is not None and batch <= commit["batch"]:
            return version
        changes = written(changes, "state-changes")
        touched = self._touched(changes, commit)
        if not touched:
            return version
        names = StructType.fromJson(commit["schema"]).names
        kinds = {f.name: f.dataType for f in StructType.fromJson(commit["schema"])}
        after = fold(self._scan(commit, touched), changes).select(*[F.col(c).cast(kinds[c]).alias(c) for c in names])
        folder = uuid.uuid4().hex
        (after.withColumn(BUCKET, self._bucket(commit)).repartition(F.col(BUCKET))
         .write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}"))
        new = {n.split("=", 1)[1] for n in self._folders("data", folder) if n.startswith(f"{BUCKET}=")}
        if not new <= touched:
            raise ValueError("the merge gave rows of keys that the batch does not touch")
        kept = {b: f for b, f in commit["buckets"].items() if b not in touched}
        self._publish(version + 1, commit | {
            "buckets": kept | dict.fromkeys(new, folder), "batch": commit["batch"] if batch is None else batch})
        return version + 1

    def vacuum(self) -> list[str]:
        """Remove the folders that the newest commit does not name, and older
        commits. Call it when no query reads an older state and no merge runs."""
        version = self.version()
        named = set(self.commit(version)["buckets"].values())
        gone = [f for f in self._folders("data") if f not in named]
        for folder in gone:
            self._fs().delete(self._path("data", folder), True)
        for name in self._folders("commits"):
            if name != f"{version:08d}.json":
                self._fs().delete(self._path("commits", name), False)
        return gone
