"""Packing by concatenate and cut.

Pass 1 encodes every document once and writes its ids, together with the
partition that wrote them and the position there, to the shared folder. The
partitions' token totals, one row each, are summed up to the partitions'
global offsets. Pass 2 adds the offset to each document's position, cuts the
global stream of ids at multiples of the window, and emits one boundary
record per piece of a document. No document is shuffled; only the very last
window is padded. With ``file_order`` the parts are the pieces of files that
tasks read, in the order of the files' numbers, instead of the partitions:
Spark deals files to partitions by size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import small, stored
from ledgerflow.llm.tokens import CACHE_ENTRIES, END_ID, default_tokenizer, encoder, slices

WINDOW = 1024
MAX_PARTITIONS = 500_000         # rows of the broadcast offsets: about 20 MB


def _file_part(docs: DataFrame) -> Column:
    """Text that orders rows by the number of their file, then by its name and
    the start of the piece that is read together."""
    file = docs.metadataColumn("_metadata")
    number = F.regexp_extract(file["file_name"], r"^part-(\d+)", 1)
    return F.concat_ws(" ", F.lpad(number, 12, "0"), file["file_name"],
                       F.lpad(file["file_block_start"].cast("string"), 20, "0"))


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str,
            cache_entries: int = CACHE_ENTRIES, file_order: bool = False) -> DataFrame:
    """doc_id, part, before (ids of the part before it), n (ids), ids (with the end id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, own = encoder(tokenizer, cache_entries), str(TaskContext.get().partitionId()).zfill(12)
        before: dict[str, int] = {}
        for batch in batches:
            for at, n in slices(batch.column("text")):
                rows = batch.slice(at, n)
                ids = enc.encode_array(rows.column("text"), END_ID)
                counts = pc.divide(pc.binary_length(ids), 4)
                parts = rows.column("part").to_pylist() if file_order else [own] * n
                starts = []
                for p, k in zip(parts, counts.to_pylist()):
                    starts.append(before.get(p, 0))
                    before[p] = starts[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(parts, pa.string()), pa.array(starts, pa.int64()),
                     counts, ids.cast(pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    cols = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")]
    if file_order:
        cols.append(_file_part(docs).alias("part"))
    return docs.select(*cols).mapInArrow(
        run, "doc_id long, part string, before long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", cache_entries: int = CACHE_ENTRIES, file_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset. ``cache_entries`` bounds what a worker keeps of pieces
    encoded before (200 bytes each). With ``file_order`` (rows read from files)
    the stream follows the numbers of the files and the rows in them.

    start counts the document's ids before the piece, offset the sequence's.
    A null text is an empty one: its only id is the end id. Rows with a null
    or repeated doc_id are packed each. An empty table gives an empty result.
    """
    rows = stored(encoded(docs, tokenizer or default_tokenizer(), id_col, text_col, cache_entries, file_order),
                  "pack-ids", compression="zstd")
    totals = stored(rows.groupBy("part").agg(F.sum("n").alias("n")),
                    "pack-totals")
    n_parts = totals.count()
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row a part
    offsets = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long")).alias("first"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, pos, ids in zip(part.column("doc_id").to_pylist(), part.column("position").to_pylist(),
                                         part.column("ids").to_pylist()):
                    n, start = len(ids) // 4, 0
                    while start < n:
                        seq, offset = divmod(pos + start, window)
                        length = min(window - offset, n - start)
                        piece = ids[4 * start:4 * (start + length)]
                        out.append((doc, start, length, piece, zlib.crc32(piece), n, seq, offset))
                        start += length
                cols = list(zip(*out))
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], PIECE)

    placed = rows.drop("n").join(small(offsets, n_parts, MAX_PARTITIONS), "part")
    return placed.select("doc_id", (F.col("first") + F.col("before")).alias("position"), "ids").mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")


PIECE = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens, ids: the padded sequences as ids in little-endian
    unsigned 32-bit bytes. A group holds one window at most."""
    def whole(key, pdf):
        import pandas as pd

        ids = b"".join(pdf.sort_values("offset")["ids"])
        n = len(ids) // 4
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [n],
                             "ids": [ids + np.full(window - n, pad_id, "<u4").tobytes()]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(
        whole, "sequence_id long, n_tokens long, ids binary")
