"""Prefix trie of conversations by a splitter skeleton.

A conversation's path is the chain of 16-byte digests of its turns (role and
text). Paths are dealt to shards by range: splitters, taken from a bounded
sample of (path, conv_id), part copies of one path too. A node that is no
prefix of a splitter's path has all its conversations in one shard. So the
trie of the splitters' paths, the skeleton, is broadcast; each shard reads its
sorted paths once with a stack of open nodes, and finishes every other node by
itself. Of skeleton nodes a shard gives partial aggregates, which a reduction
by node adds up; what they hand to their own skeleton parents is added in a
last step over the skeleton alone, whose size is bounded by ``MAX_SKELETON``.

A node's children wait for its smallest conversation; beyond ``PENDING`` of
them, and below skeleton nodes, they are written without it and joined to
their parents later. The conversations that end at a skeleton node are hashed
in order as blocks of ids go by, never gathered.

A conversation is one row (16 bytes a turn, no texts); its turns are gathered
by conv_id. The number of conversations of one path has no bound.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import small, stored

KEY = 16
SAMPLE_PER_SHARD = 32
SAMPLE_BYTES = 32 << 20         # of sampled paths on the driver, about
MAX_SKELETON = 250_000          # turns of all splitters' paths: nodes of the skeleton
PENDING = 2_000                 # children of an open node that wait for it
ENDS = 8_192                    # ids of a block
MAX_OWNERS = 300_000            # rows of broadcast parents: about 20 MB
LOCAL, ORPHAN, PARTIAL, END_BLOCK = range(4)

NODE = ("kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, size long, ends string, shard int, block int")
_KINDS = (pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.int32(), pa.int32())
_NAMES = [c.split()[0] for c in NODE.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(path: bytes) -> bytes:
    """The name of the node that a path leads to."""
    return hashlib.blake2b(path, digest_size=KEY).digest()


def paths(conversations: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path, sizes): digests and code points of each conversation's turns."""
    c = conversations
    role, text = F.coalesce(c[role_col], F.lit("")), F.coalesce(c[text_col], F.lit(""))
    turns = c.select(c[id_col].cast("long").alias("conv_id"), F.struct(
        c[turn_col].isNotNull().alias("numbered"), c[turn_col].alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.char_length(text).cast("long").alias("size")).alias("t")).filter("conv_id is not null")
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    if ids is not None:
        every = ids.select(ids[id_col].cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
        out = every.join(out, "conv_id", "left").withColumn("t", F.coalesce("t", F.array()))
    return out.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["key"]), "")).alias("path"),
                      F.transform("t", lambda x: x["size"]).alias("sizes"))


def splitters(table: DataFrame, shards: int, max_skeleton: int = MAX_SKELETON) -> list[tuple[bytes, int]]:
    """At most shards - 1 (path, conv_id), ascending, whose paths have at most
    ``max_skeleton`` turns together. Fewer splitters mean larger shards only."""
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    if not n:
        return []
    share = min(1.0, SAMPLE_PER_SHARD * shards / n, SAMPLE_BYTES / max(size, 1))
    chosen = table.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = sorted((bytes(r.path), r.conv_id) for r in chosen.select("path", "conv_id").collect())
    out = sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []
    while out and sum(len(p) // KEY for p in {p for p, _ in out}) > max_skeleton:
        out = out[1::2]
    return out


def skeleton(split: list[tuple[bytes, int]]) -> dict:
    """Nested tables: a node's skeleton children by the digest of their turn."""
    root: dict = {}
    for path, _ in split:
        at = root
        for k in range(0, len(path), KEY):
            at = at.setdefault(path[k:k + KEY], {})
    return root


class _Node:
    __slots__ = ("depth", "tree", "size", "least", "n", "children", "leaves", "saved", "sha", "ends", "block",
                 "waiting", "owner")

    def __init__(self, depth: int, tree: dict | None, size: int):
        self.depth, self.tree, self.size = depth, tree, size
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ends, self.block = None, [], 0
        self.waiting, self.owner = [], False


class _Shard:
    """Reads sorted (shard, path, conv_id, sizes) and gathers finished rows."""

    def __init__(self, tree: dict, pending: int):
        self.tree, self.pending = tree, pending
        self.stack: list[_Node] = []
        self.path, self.shard = b"", 0
        self.out: list[tuple] = []

    def add(self, shard: int, path: bytes, conv_id: int, sizes: list[int]) -> None:
        if self.stack and shard != self.shard:
            self.close()
        self.shard = shard
        if not self.stack:
            self.stack, self.path = [_Node(0, self.tree, 0)], b""
        if path != self.path:
            k, most = 0, min(len(path), len(self.path))
            while k < most and path[k:k + KEY] == self.path[k:k + KEY]:
                k += KEY
            while len(self.stack) - 1 > k // KEY:
                self.pop()
            self.path = path
            for at in range(k, len(path), KEY):
                tree = self.stack[-1].tree
                self.stack.append(_Node(at // KEY + 1, None if tree is None else tree.get(path[at:at + KEY]),
                                        sizes[at // KEY]))
        node = self.stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.tree is None:
            if node.sha is None:
                node.sha = hashlib.sha256(str(conv_id).encode())
            else:
                node.sha.update(f",{conv_id}".encode())
        else:
            node.ends.append(str(conv_id))
            if len(node.ends) == ENDS:
                self.give_ends(node)

    def key(self, depth: int) -> bytes:
        return digest(self.path[:KEY * depth])

    def give_ends(self, node: _Node) -> None:
        self.out.append((END_BLOCK, self.key(node.depth), *[None] * 9, ",".join(node.ends), self.shard, node.block))
        node.ends, node.block = [], node.block + 1

    def orphans(self, node: _Node) -> None:
        """The waiting children, to be joined to their parent by its name."""
        key = self.key(node.depth)
        self.out += [(ORPHAN, own, key, *row[:2], None, *row[2:], None, None) for own, *row in node.waiting]
        node.waiting = []

    def pop(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if node.tree is not None:
            if node.waiting:
                self.orphans(node)
            if node.ends:
                self.give_ends(node)
            self.out.append((PARTIAL, self.key(node.depth), self.key(node.depth - 1) if node.depth else None,
                             node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, node.size,
                             None, None, None))
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        sha = (node.sha or hashlib.sha256()).hexdigest()
        if node.owner:
            self.orphans(node)
        else:
            self.out += [(LOCAL, own, None, *row[:2], node.least, *row[2:], None, None)
                         for own, *row in node.waiting]
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        parent.waiting.append((self.key(node.depth) if node.owner else None, node.least, node.depth, node.n,
                               node.children, leaves, saved, node.size, sha))
        if len(parent.waiting) >= self.pending:
            parent.owner = True
            self.orphans(parent)

    def close(self) -> None:
        while self.stack:
            self.pop()

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*self.out))
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)


def sharded(table: DataFrame, split: list[tuple[bytes, int]], shards: int, pending: int) -> DataFrame:
    """Local nodes, orphans, partial skeleton nodes and blocks of ends (NODE)."""
    shared = table.sparkSession.sparkContext.broadcast(split)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [bisect_right(own, pair) for pair in
                     zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())],
                                             ["conv_id", "path", "sizes", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Shard(skeleton(shared.value), pending)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "sizes"))):
                reader.add(*row)
                if len(reader.out) >= 10_000:
                    yield reader.rows()
        reader.close()
        if reader.out:
            yield reader.rows()

    dealt = table.mapInArrow(deal, "conv_id long, path binary, sizes array<long>, shard int")
    return stored(dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
                  .mapInArrow(run, NODE), "trie-nodes")


def reduced(found: DataFrame, shards: int) -> DataFrame:
    """The skeleton's nodes, each with its key."""
    own = found.filter(F.col("kind") == PARTIAL).groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min("size").alias("size"))

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What skeleton children hand to their parents, deepest first."""
        rows = {r["key"]: r for b in batches for r in b.to_pylist()}
        for r in sorted(rows.values(), key=lambda r: -r["depth"]):
            r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
            parent = rows.get(r["parent_key"])
            r["parent_conv_id"] = parent["conv_id"] if parent else None
            if parent:
                parent["n_children"] += 1
                parent["n_leaves"] += r["n_leaves"]
                parent["saved_tokens"] += r["saved_tokens"]
        if rows:
            names = ["key", *RESULT[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows.values()], pa.binary() if c == "key" else pa.int64()) for c in names],
                names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of each key's blocks, as they go by in order."""
        last, sha, out = None, None, []
        for batch in batches:
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key != last:
                    if sha is not None:
                        out.append((last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(ends.encode())
                else:
                    sha.update(f",{ends}".encode())
        if sha is not None:
            out.append((last, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))],
                                             ["key", "ends_sha256"])

    whole = own.repartition(1).mapInArrow(       # MAX_SKELETON rows at most
        upwards, "key binary, " + ", ".join(f"{c} long" for c in RESULT[:-1]))
    ends = (found.filter(F.col("kind") == END_BLOCK).select("key", "shard", "block", "ends")
            .repartition(shards, "key").sortWithinPartitions("key", "shard", "block")
            .select("key", "ends").mapInArrow(hashed, "key binary, ends_sha256 string"))
    none = F.lit(hashlib.sha256().hexdigest())
    return stored(whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)),
                  "trie-skeleton")


def trie(conversations: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn",
         role_col: str = "role", text_col: str = "text", shards: int | None = None,
         max_skeleton: int = MAX_SKELETON, pending: int = PENDING) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (code points that a cache of
    prefixes saves in the subtree), ends_sha256. Runs its jobs at once.

    Turns are ordered by turn (null first); turns of equal number by the digest
    of role and text, so repeated rows are turns of their own. A null role or
    text is an empty one. Rows without a conv_id belong to no conversation.
    ``ids`` (a table with the id column) may name conversations without turns:
    they are members of the root. No conversation gives no node. Other columns
    are ignored.
    """
    n = shards or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = stored(paths(conversations, ids, id_col, turn_col, role_col, text_col), "trie-paths")
    found = sharded(table, splitters(table, n, max_skeleton), n, pending)
    top = reduced(found, n)
    owners = top.select("key", "conv_id").unionByName(
        found.filter(F.col("kind").isin(LOCAL, ORPHAN) & F.col("key").isNotNull()).select("key", "conv_id"))
    owners = owners.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    orphans = found.filter(F.col("kind") == ORPHAN).join(small(owners, owners.count(), MAX_OWNERS), "parent_key")
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           F.col("ends").alias("ends_sha256")]
    return (found.filter(F.col("kind") == LOCAL).select(*own)
            .unionByName(orphans.withColumn("parent_conv_id", F.col("above")).select(*own))
            .unionByName(top.select(*RESULT)))
