"""Token-id files of bit-plane shuffled, zstandard-compressed blocks.

The ids of all documents, in ascending doc_id order, form one stream per
shard. A shard is cut into chunks of a fixed number of ids. A chunk's ids are
transposed into planes (all lowest bytes, then all next bytes, ...; or single
bits), each plane is compressed by itself, and the planes follow one another
in the chunk's payload. The chunk index tells where the shard's ids start in
the chunk, how long each plane is and which documents begin where.

Files lie in any folder that Spark can write: ``chunks`` (payload and index
of each chunk, one row a chunk, stored without further compression) and
``shards`` (ids of each shard). Reading prunes to the columns and chunks that
a reader asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import BATCH_ROWS, arrow_batches, small
from ledgerflow.llm.tokens import END_ID, default_tokenizer, encoder, slices

CHUNK_IDS = 1 << 16
PLANES = "byte"                   # or "bit"
LEVEL = 3
HEAD = 64                         # characters that order rows of equal id
MAX_SHARDS = 500_000              # rows of the broadcast shard offsets: about 20 MB

CHUNK_SCHEMA = ("shard int, chunk int, first long, n_ids int, planes string, lengths array<int>, crc32 long, "
                "docs array<struct<doc_id:bigint,rank:bigint,at:int,length:int,begins:boolean,ends:boolean,"
                "n_tokens:bigint>>, payload binary")
_DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("rank", pa.int64()), ("at", pa.int32()), ("length", pa.int32()),
                           ("begins", pa.bool_()), ("ends", pa.bool_()), ("n_tokens", pa.int64())]))


def shuffled(ids: bytes, planes: str = PLANES, level: int = LEVEL) -> list[bytes]:
    """The compressed planes of little-endian unsigned 32-bit ids, lowest first."""
    table = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    rows = table.T if planes == "byte" else np.packbits(
        np.unpackbits(table, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def unshuffled(payload: bytes, lengths: list[int], n: int, planes: str = PLANES) -> bytes:
    """The ids of a chunk's payload."""
    rows, at = [], 0
    for k in lengths:
        rows.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at:at + k]), np.uint8))
        at += k
    table = np.stack(rows)
    if planes == "bit":
        bits = np.unpackbits(table, axis=1, count=n, bitorder="little")
        table = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(table.T).tobytes()


class _Shard:
    """Gathers documents of one shard and gives out its chunks."""

    def __init__(self, shard: int, chunk_ids: int, planes: str):
        self.shard, self.size, self.planes = shard, chunk_ids, planes
        self.ids, self.docs = bytearray(), []
        self.chunk, self.first, self.rank = 0, 0, 0

    def add(self, doc_id, ids: bytes) -> Iterator[dict]:
        n, at = len(ids) // 4, 0
        while at < n:
            here = len(self.ids) // 4
            length = min(self.size - here, n - at)
            self.ids += ids[4 * at:4 * (at + length)]
            self.docs.append({"doc_id": doc_id, "rank": self.rank, "at": here, "length": length,
                              "begins": at == 0, "ends": at + length == n, "n_tokens": n})
            at += length
            if len(self.ids) == 4 * self.size:
                yield self.flush()
        self.rank += 1

    def flush(self) -> dict:
        ids = bytes(self.ids)
        parts = shuffled(ids, self.planes)
        row = {"shard": self.shard, "chunk": self.chunk, "first": self.first, "n_ids": len(ids) // 4,
               "planes": self.planes, "lengths": [len(p) for p in parts], "crc32": zlib.crc32(ids),
               "docs": self.docs, "payload": b"".join(parts)}
        self.ids, self.docs = bytearray(), []
        self.chunk, self.first = self.chunk + 1, self.first + len(ids) // 4
        return row


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "chunk": pa.int32(), "first": pa.int64(), "n_ids": pa.int32(),
             "planes": pa.string(), "lengths": pa.list_(pa.int32()), "crc32": pa.int64(), "docs": _DOC,
             "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id",
          text_col: str = "text", chunk_ids: int = CHUNK_IDS, planes: str = PLANES,
          shards: int | None = None) -> None:
    """Write the ids of all texts in ascending doc_id order to ``path``.

    Texts are dealt to shards by ranges of doc_id and encoded where they
    land. Null ids come first; rows of equal id are ordered by their first HEAD
    characters, then by the hash of the text, so that an id of many rows, and
    copies under one id, spread over shards. A null text is an empty one: its
    only id is the end id. An empty table gives an empty store.
    """
    file, spark = tokenizer or default_tokenizer(), docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # a repeated (or null) id is dealt on by the beginning and hash of the text, and copies by their place
    head, place = F.substring("text", 1, HEAD), F.struct(F.spark_partition_id(), F.monotonically_increasing_id())
    keyed = (rows.withColumn("head", head).withColumn("hash", F.xxhash64("text"))
             .withColumn("place", F.xxhash64(place)))
    order = [F.col("doc_id").asc_nulls_first(), "head", "hash", "place"]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(file), _Shard(TaskContext.get().partitionId(), chunk_ids, planes)
        for batch in batches:
            for at, k in slices(batch.column("text")):
                part = batch.slice(at, k)
                ids = enc.encode_array(part.column("text"), END_ID).to_pylist()
                for doc, own in zip(part.column("doc_id").to_pylist(), ids):
                    for row in shard.add(doc, own):
                        yield _batch([row])
        if shard.docs:
            yield _batch([shard.flush()])

    with arrow_batches(spark, BATCH_ROWS):
        (dealt.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "uncompressed")
         .option("parquet.block.size", 8 << 20).parquet(f"{path}/chunks"))
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{path}/shards")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids and ids_crc32 of every document in the store.

    Every chunk is decoded and checked. Only documents cut by a chunk border
    are shuffled, to join their pieces; they come from a scan of their own.
    """
    totals = spark.read.schema("shard int, n_ids long").parquet(f"{path}/shards")
    n_shards = totals.count()
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)      # one row a shard
    first = totals.select("shard", F.coalesce(F.sum("n_ids").over(upto), F.lit(0).cast("long")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unshuffled(row["payload"], row["lengths"], row["n_ids"], row["planes"])
                if zlib.crc32(ids) != row["crc32"]:
                    raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
                out = [(d["doc_id"], row["shard"], d["rank"], row["chunk"], row["before"] + row["first"] + d["at"],
                        d["n_tokens"], ids[4 * d["at"]:4 * (d["at"] + d["length"])])
                       for d in row["docs"] if (d["begins"] and d["ends"]) == whole]
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                        ["doc_id", "shard", "rank", "chunk", "start", "n_tokens", "ids"])

    def pieces(whole: bool) -> DataFrame:
        return chunks(spark, path).join(small(first, n_shards, MAX_SHARDS), "shard").mapInArrow(
            partial(run, whole=whole),
            "doc_id long, shard int, rank long, chunk int, start long, n_tokens long, ids binary")

    whole = pieces(True).select("doc_id", "start", "n_tokens", "ids")
    cut = (pieces(False).groupBy("shard", "rank", "doc_id", "n_tokens")
           .agg(F.array_sort(F.collect_list(F.struct("chunk", "start", "ids"))).alias("p"))
           .select("doc_id", F.col("p")[0]["start"].alias("start"), "n_tokens",
                   F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids")))
    return whole.unionByName(cut).withColumn("ids_crc32", F.crc32("ids"))
