"""MinHash near-deduplication with HyperMinHash registers.

A document's set is its distinct five-word shingles. Each of ``REGISTERS``
buckets permutes the shingle hashes and stores, of the smallest, the count of
leading zeros (6 bits) and the ``MANTISSA`` bits that follow: 16 bits in place
of 64. Every bucket sees every shingle under its own permutation, so that
short texts leave no bucket empty.

1. One scan writes a narrow sketch row per document (set size, digest of the
   set, registers). Documents with equal sets form a class; only class
   representatives go on.
2. Four neighbouring registers make a band key. Equal keys make candidates.
   With 20 bands a pair at similarity 0.85 is missed with probability 4e-7.
3. Buckets of up to ``SMALL`` classes give their pairs. A pair goes on if the
   collision-corrected estimate from all registers lies within
   ``DEVIATIONS`` standard deviations of the threshold, and the full shingle sets are compared.
4. Larger buckets never emit pairs. Their classes are gathered into clusters
   (connected by shared large buckets), split into blocks of bounded total
   set size, and every pair of blocks is searched inside one task with an
   inverted index. A task emits only a spanning forest of confirmed links.
   A class whose own rare shingles already exclude the threshold is skipped.
5. Components come from alternating large-star and small-star steps on the
   links, each round written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import small as small_table, stored

WORDS = 5                       # words in a shingle
THRESHOLD = (85, 100)           # link when 100 * intersection >= 85 * union
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
SMALL = 64                      # classes in a bucket whose pairs are emitted
MAX_WANTED = 300_000            # rows of a broadcast list of classes whose sets are fetched
BLOCK_SHINGLES = 1 << 18        # total set size of a block in a large cluster (2 MB)
DEVIATIONS = 4.5

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.split() and
    bytes.lower() do precisely that. Fewer than five words make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b"\0" + b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        out = (out ^ h[i:len(words) - WORDS + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16): leading zeros, then mantissa bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        part = hashes[i:i + 1024, None] * _MULTIPLY + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    bits = (least | np.uint64(1)).astype(np.float64).view(np.int64)
    zeros = 63 - np.clip((bits >> 52) - 1023, 0, 63)
    return ((zeros << MANTISSA) | ((bits >> (52 - MANTISSA)) & ((1 << MANTISSA) - 1))).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, cids, bands = [], [], []
            for text in part.column("text"):
                s = shingles(text.as_py())
                sizes.append(len(s))
                cids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_hash"), pa.array(sizes, pa.int64()),
                 pa.array(cids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "row_hash", "n_shingles", "cid", "bands"])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_hash, n_shingles, cid (digest of the set), bands (registers in fours)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"),
                       F.xxhash64(docs[text_col]).alias("row_hash"))
    return rows.mapInArrow(
        _sketch, "doc_id long, row_hash long, n_shingles long, cid binary, bands array<long>")


def estimate(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Jaccard estimate from the shares of equal registers, corrected for the
    chance that different minima fall on one register: the mean cell is
    2^-MANTISSA / (2 ln 2) of its position, and two independent minima of sets
    of n and m shingles meet there with density n m / (n + m)^2.
    """
    def lanes(x):
        one = [F.when(F.shiftright(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
               for i in range(ROWS)]
        return sum(one[1:], one[0])
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: lanes(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    by_chance = n * m / ((n + m) * (n + m)) * (2.0 ** -MANTISSA / (2 * np.log(2)))
    return (equal / REGISTERS - by_chance) / (1 - by_chance)


def _near_sizes(n: Column, m: Column) -> Column:
    num, den = THRESHOLD
    return (F.least(n, m) * den >= F.greatest(n, m) * num)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t.as_py()).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(sets, pa.binary())],
                                             ["cid", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    num, den = THRESHOLD
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part, mask = batch.slice(at, 1024), []
            for a, b in zip(part.column("sa"), part.column("sb")):
                x = np.frombuffer(a.as_py(), np.uint64)
                y = np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                mask.append(den * both >= num * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of all links among these sets, by an inverted index.

    The first pass links everything to the largest partial component; then
    only sets outside it are searched, which covers every pair that could
    join two components.
    """
    num, den = THRESHOLD
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(df)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    # at most the shared shingles can be common; their share bounds the similarity
    shared = np.bincount(owner, weights=df[inverse] > 1, minlength=len(sets))
    hopeful = den * shared >= num * sizes
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links: list[tuple[int, int]] = []

    def search(i: int) -> None:
        ids = inverse[ends[i]:ends[i + 1]]
        both = np.bincount(np.concatenate([posting[start[k]:start[k + 1]] for k in ids]),
                           minlength=len(sets))
        hit = np.nonzero(den * both >= num * (sizes[i] + sizes - both))[0]
        for j in hit.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))

    todo = np.nonzero(hopeful)[0].tolist()
    first = todo[:max(1, len(todo) // 50)]
    for i in first:
        search(i)
    done = set(first)
    if todo:
        giant = Counter(find(i) for i in todo).most_common(1)[0][0]
    for i in todo:
        if i not in done and find(i) != find(giant):
            search(i)
    return links


def _blocks(pdf):
    import pandas as pd

    pdf = pdf.drop_duplicates("cid").sort_values("cid")
    cids = pdf["cid"].tolist()
    links = block_links([np.frombuffer(x, np.uint64) for x in pdf["shingles"]])
    return pd.DataFrame({"a": [cids[i] for i, _ in links], "b": [cids[j] for _, j in links]})


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for all
    nodes that have a link to another. Alternating large-star and small-star
    steps; every round is written to the shared folder.
    """
    def stars(edges: DataFrame, small_star: bool) -> DataFrame:
        if small_star:
            own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            own = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
                edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = own.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        both = own.join(least, "u")
        if small_star:
            new = both.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            new = both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return new.filter("a != b").distinct()

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"),
                               F.expr("try_sum(xxhash64(a, b) % 1000003)")).first())

    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), name)
    seen = state(edges)
    while seen[0]:
        edges = stored(stars(stars(edges, False), True), name)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def class_links(sk: DataFrame, docs: DataFrame, id_col: str, text_col: str,
                small: int = SMALL, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect every component."""
    spark = sk.sparkSession
    reps = stored(sk.filter("cid is not null").groupBy("cid", "n_shingles")
                  .agg(F.first("bands").alias("bands"),
                       F.min(F.struct("doc_id", "row_hash")).alias("rep")), "near-classes")
    keys = reps.select("cid", F.posexplode("bands").alias("band", "key")).select(
        "cid", F.xxhash64("band", "key").alias("bucket"))
    buckets = stored(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("hub"))
                     .filter("n > 1"), "near-buckets")
    members = stored(keys.join(buckets, "bucket"), "near-members")
    few, many = members.filter(F.col("n") <= small), members.filter(F.col("n") > small)

    large = not buckets.filter(F.col("n") > small).isEmpty()
    clusters = None
    if large:
        clusters = components(many.select(F.col("cid").alias("a"), F.col("hub").alias("b")), "near-clusters")
        clusters = stored(clusters.select(F.col("node").alias("cid"), F.col("root").alias("cluster")),
                          "near-cluster")

    info = reps.select("cid", "n_shingles", "bands")
    x, y = few.select("bucket", F.col("cid").alias("a")), few.select("bucket", F.col("cid").alias("b"))
    pairs = x.join(y, "bucket").filter("a < b").select("a", "b").distinct()
    if clusters is not None:
        pairs = (pairs.join(clusters.select(F.col("cid").alias("a"), F.col("cluster").alias("ca")), "a", "left")
                 .join(clusters.select(F.col("cid").alias("b"), F.col("cluster").alias("cb")), "b", "left")
                 .filter("ca is null or cb is null or ca != cb").select("a", "b"))
    num, den = THRESHOLD
    t = num / den
    least = t - DEVIATIONS * float(np.sqrt(t * (1 - t) / REGISTERS))
    pairs = (pairs.join(info.toDF("a", "n", "xa"), "a").join(info.toDF("b", "m", "xb"), "b")
             .filter(_near_sizes(F.col("n"), F.col("m")))
             .filter(estimate(F.col("xa"), F.col("xb"), F.col("n"), F.col("m")) >= least)
             .select("a", "b"))
    pairs = stored(pairs, "near-pairs")

    # full sets of the classes that have a candidate, from the texts
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    if clusters is not None:
        wanted = wanted.unionByName(clusters.select("cid"))
    chosen = reps.join(wanted.distinct(), "cid", "left_semi").select(
        "cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_hash").alias("rep_hash"))
    chosen = stored(chosen, "near-wanted")
    chosen = small_table(chosen, chosen.count(), MAX_WANTED)
    texts = docs.select(docs[id_col].cast("long").alias("rep_id"), F.xxhash64(docs[text_col]).alias("rep_hash"),
                        docs[text_col].alias("text"))
    own = (texts.join(chosen, texts["rep_id"].eqNullSafe(chosen["rep_id"])
                      & (texts["rep_hash"] == chosen["rep_hash"]))
           .groupBy("cid").agg(F.min("text").alias("text"))        # rows that repeat id and text: one a class
           .select("cid", "text").mapInArrow(_sets, "cid binary, shingles binary"))
    own = stored(own, "near-sets")

    links = (pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
             .mapInArrow(_confirm, "a binary, b binary"))
    if clusters is not None:
        sized = clusters.join(reps.select("cid", "n_shingles"), "cid")
        cuts = sized.groupBy("cluster").agg(
            F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        rows = (sized.join(cuts, "cluster").withColumn("block", block)
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select("cid", "cluster", F.least("block", "other").alias("i"),
                        F.greatest("block", "other").alias("j")))
        links = links.unionByName(rows.join(own, "cid").groupBy("cluster", "i", "j")
                                  .applyInPandas(_blocks, "a binary, b binary"))
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               small: int = SMALL, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row_hash for every row.

    component_id is the smallest doc_id reachable over links, the row's own
    included; kept says that they are equal. A null or wordless text has no
    shingle, links with nothing and is kept. Rows with equal sets (also rows
    repeated as they are) share a component; of rows that repeat the smallest
    id all are marked kept, and ``common.only_kept`` leaves one of them. A
    null id gets the smallest id of its component, or null, and is kept only
    in the latter case. An empty table gives an empty result.
    """
    out, found = _classes(docs, id_col, text_col, small, block_shingles)
    out = out.join(found.drop("root"), "cid", "left")
    comp_id = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"),
                      F.col("doc_id").eqNullSafe(comp_id).alias("kept"), "row_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                small: int = SMALL, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, row_hash and kept for every row: of each component the row with
    the smallest id stays, then (null or repeated ids) the smallest hash of the
    text; rows without words all stay."""
    sk, found = _classes(docs, id_col, text_col, small, block_shingles)
    rooted = sk.join(found.select("cid", "root"), "cid", "left")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash")
    best = (rooted.filter("root is not null").groupBy("root").agg(F.min(rank).alias("best")))
    judged = rooted.filter("root is not null").join(best, "root").select(
        "doc_id", "row_hash", (rank == F.col("best")).alias("kept"))
    return judged.unionByName(rooted.filter("root is null").select("doc_id", "row_hash", F.lit(True).alias("kept")))


def _classes(docs: DataFrame, id_col: str, text_col: str, small: int,
             block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (cid, component_id, root) of all classes."""
    sk = stored(sketches(docs, id_col, text_col), "near-sketch")
    links = stored(class_links(sk, docs, id_col, text_col, small, block_shingles), "near-links")
    comp = components(links, "near-components")
    # smallest id by class, then by component: one row a class, never a row a copy
    classes = sk.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    rooted = (classes.join(comp, classes["cid"] == comp["node"], "left")
              .select("cid", "least", F.coalesce("root", "cid").alias("root")))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return sk, stored(rooted.join(linked, "root").select("cid", "component_id", "root"), "near-found")
