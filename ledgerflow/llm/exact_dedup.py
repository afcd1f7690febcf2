"""Exact deduplication by two-pass Bloom filtering.

Pass 1 hashes every normalised text and counts, per filter position, how
many texts land on it (map-side partial sums, eight bytes a position). The
positions hit at least twice form the filter: a text whose positions are
not all in it is certainly unique. The filter has POSITIONS_A_TEXT positions
for each document, so that the share of unique texts it lets through stays the
same at any size. Pass 2 probes it: its bitmaps are broadcast up to
MAX_BROADCAST positions, and beyond that joined by bitmap number, so that
narrow rows go to the part of the filter they need. Unique texts pass straight
through; only possibly repeated ones are shuffled on their digest. A fuller
filter lets more unique texts through to that shuffle and changes no result.

Texts themselves are never shuffled: one scan writes a row of about 60
bytes a document (id, length, digest), and all later steps read that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored, text_or_empty

WHITESPACE = " \t\n\x0b\x0c\r"           # [\x20\x09-\x0D]
BITMAP_BITS = 32768                        # positions in one bitmap of bitmap_construct_agg
POSITIONS_A_TEXT = 32
MIN_BITS = 1 << 20
MAX_BROADCAST = 1 << 27                    # positions of a broadcast filter: 16 MB for each hash
N_HASHES = 2


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), WHITESPACE, text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, code points, digest, row number.

    The row number only breaks ties between rows with equal id and text.
    """
    text = text_or_empty(docs, text_col)
    return docs.select(
        docs[id_col].alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("digest"),
        F.xxhash64(docs[text_col]).alias("row_hash"),
        F.monotonically_increasing_id().alias("row"))


def positions(digest: Column, bits: int, n_hashes: int) -> list[Column]:
    """The filter positions of a digest."""
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits).cast("long")) for i in range(n_hashes)]


def repeated_filter(prints: DataFrame, bits: int, n_hashes: int = N_HASHES) -> DataFrame:
    """Bitmaps (hash number, bucket, bits) of the positions hit at least twice."""
    pos = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.alias("p"))
                              for i, p in enumerate(positions(F.col("digest"), bits, n_hashes))]))
    hit = (prints.select(pos.alias("x")).groupBy("x.i", "x.p").agg(F.count(F.lit(1)).alias("n"))
           .filter("n > 1"))
    return (hit.withColumn("bucket", F.floor(F.col("p") / BITMAP_BITS))
            .withColumn("bit", F.col("p") % BITMAP_BITS)
            .groupBy("i", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def maybe_repeated(prints: DataFrame, filt: DataFrame, bits: int, n_hashes: int = N_HASHES,
                   max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``prints`` with a boolean ``maybe``: all positions are in the filter. A
    bitmap leaves the row as soon as it has been read."""
    out, found = prints, []
    for i, p in enumerate(positions(F.col("digest"), bits, n_hashes)):
        own = (filt.filter(F.col("i") == i)
               .select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}")))
        own = F.broadcast(own) if bits <= max_broadcast else own      # at most bits / 8 bytes
        out = (out.withColumn(f"p{i}", p)
               .withColumn(f"bucket{i}", F.floor(F.col(f"p{i}") / BITMAP_BITS))
               .join(own, f"bucket{i}", "left"))
        byte = F.substring(F.col(f"bits{i}"), ((F.col(f"p{i}") % BITMAP_BITS) / 8).cast("int") + 1,
                           F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        found.append(f"found{i}")
        hit = F.coalesce(F.getbit(value, (F.col(f"p{i}") % 8).cast("int")) == 1, F.lit(False))
        out = out.withColumn(found[-1], hit).select(*prints.columns, *found)
    return out.select(*prints.columns, reduce(lambda a, b: a & b, map(F.col, found)).alias("maybe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits: int | None = None, n_hashes: int = N_HASHES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Decide for every row which row of its group of equal texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input
    row, and row_hash (xxhash64 of the text as it is), by which
    ``common.only_kept`` finds the row again. The row with the most code points stays, then the smallest id, then
    the first row read. A null text is an empty text, and empty texts equal
    each other; a null id ranks behind every other. An empty table gives an
    empty result. Other columns are ignored, whatever their names. ``bits``
    (positions of the filter) follows from the number of documents if not given.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "exact-prints")
    if bits is None:
        bits = max(MIN_BITS, 1 << (POSITIONS_A_TEXT * prints.count() - 1).bit_length())
    marked = maybe_repeated(prints, repeated_filter(prints, bits, n_hashes), bits, n_hashes, max_broadcast)
    alone = marked.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest", "row_hash")
    again = marked.filter("maybe")
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    # one row a digest, aggregated map side first; written, so that the join
    # shuffles both sides itself and a hot digest's rows can be split by the
    # engine's skew handling (or the table is broadcast while it is small)
    groups = stored(again.groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
                    .filter("group_size > 1"), "exact-groups")
    alone_too = F.col("best").isNull()             # let through by the filter alone
    judged = again.join(groups, "digest", "left").select(
        "doc_id", F.when(alone_too, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone_too | (F.col("row") == F.col("best.row"))).alias("kept"), "digest", "row_hash")
    return alone.unionByName(judged).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"), "row_hash")
