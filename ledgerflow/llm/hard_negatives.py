"""Hard negatives by a secondary-sort shuffle.

Vectors are scaled to whole numbers and written as blocks of rows. The
anchors, a stated query set, are dealt into waves of bounded bytes; a wave is
broadcast and scored against all blocks, one block of a task at a time. Pair
scores are keyed (anchor, descending score, kind, id), shuffled by anchor and
sorted within the partitions by the whole key. A streaming iterator then reads
an anchor's pairs from the best down and keeps no more than its open windows.

Two passes over the blocks feed it. The first passes on pairs of equal label
and yields the positives. The second knows the positives' scores and passes on
the pairs of other labels that lie in a positive's window; the iterator opens
a window at each positive and gives its next negatives ranks. Within a task a
pair that as many better pairs of the same task already beat, for its anchor
and window, is not passed on: it could not come out. So the shuffle carries a
few rows for each anchor, window and task, however many rows are copies, and
no rank depends on what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100             # a negative's score, in percent of the positive's
BLOCK_ROWS = 2048
TILE_ANCHORS = 512              # scores held at once: a tile of anchors by a block
WAVE_BYTES = 16 << 20           # of anchors broadcast at once
MAX_WAVE = 32_768               # anchors broadcast at once
PENDING = 1 << 20               # pairs that a task holds before it drops beaten ones
LARGEST = (1 << 63) - 1

BLOCK = ("block long, width int, ids binary, named binary, labels binary, chosen binary, vectors binary")
ANCHOR = "anchor long, anchor_id long, label long, vector binary"
PAIR = "anchor long, anchor_id long, score long, kind int, id long, named boolean"


def _lists(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have a usable vector, and the scaled vectors of these."""
    column = batch.column("vector")
    ok = np.zeros(batch.num_rows, bool)
    found = []
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    finite = np.isfinite(values)
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(values * scale), -1e300, 1e300)
    for k in range(batch.num_rows):
        own = slice(offsets[k], offsets[k + 1])
        if present[k] and finite[own].all():
            ok[k] = True
            found.append(values[own])
    return ok, found


def blocks(rows: DataFrame, scale: int, block_rows: int) -> DataFrame:
    """Blocks of (id, label, chosen, vector): rows sorted by id, whole-number
    vectors padded with zeros to the block's longest. A block's number and a
    row's place in it name the row from here on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ok, found = _lists(batch, scale)
            part = batch.filter(pa.array(ok))
            named = part.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = part.column("id").fill_null(LARGEST).to_numpy()
            labels, chosen = part.column("label").to_numpy(), part.column("chosen").to_numpy(zero_copy_only=False)
            order = np.lexsort((~named, ids))
            for at in range(0, len(order), block_rows):
                own = order[at:at + block_rows]
                width = max(len(found[k]) for k in own)
                vectors = np.zeros((len(own), width))
                for i, k in enumerate(own):
                    vectors[i, :len(found[k])] = found[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([width], pa.int32()),
                     *(pa.array([x.tobytes()]) for x in (ids[own], named[own], labels[own], chosen[own], vectors))],
                    ["block", "width", "ids", "named", "labels", "chosen", "vectors"])
                number += block_rows

    return stored(rows.mapInArrow(run, BLOCK), "negatives-blocks")


@dataclass
class Block:
    first: int
    ids: np.ndarray
    named: np.ndarray
    labels: np.ndarray
    chosen: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                yield Block(r["block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["named"], bool),
                            np.frombuffer(r["labels"], np.int64), np.frombuffer(r["chosen"], bool),
                            np.frombuffer(r["vectors"]).reshape(len(r["ids"]) // 8, r["width"]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number rows, as long; beyond the
    long range they stay at its ends."""
    width = min(a.shape[1], b.shape[1])             # what one side lacks counts as zero
    a, b = a[:, :width], b[:, :width]
    bound = width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    exact = whole[0] @ whole[1].T if width else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -LARGEST - 1, LARGEST).astype(np.int64)


@dataclass
class Wave:
    """Anchors that are scored together, with the windows known so far."""

    names: np.ndarray           # block number + place: the row itself
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lows: np.ndarray            # lowest and highest negative score of each positive;
    highs: np.ndarray           # low above high where there is none


def _first(rank_of: np.ndarray, per: int) -> np.ndarray:
    """Whether each entry of a sorted array is among the first ``per`` of its value."""
    starts = np.flatnonzero(np.r_[True, rank_of[1:] != rank_of[:-1]]) if len(rank_of) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(rank_of)])
    return np.arange(len(rank_of)) - np.repeat(starts, sizes) < per


class Best:
    """Pairs of one task that may still come out: (anchor place, score, id, named)."""

    def __init__(self, wave: Wave, positive: bool, per: int):
        self.wave, self.positive, self.per = wave, positive, per
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = self.kept = 0

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        self.held.append((at, score, ids, named))
        self.size += len(at)
        if self.size > max(PENDING, 2 * self.kept):
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        at, score, ids, named = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((~named, ids, ~score, at))            # ~score: descending, without overflow
        at, score, ids, named = at[order], score[order], ids[order], named[order]
        if self.positive:
            keep = _first(at, self.per)
        else:
            keep = np.zeros(len(at), bool)
            for j in range(self.wave.lows.shape[1]):
                inside = np.flatnonzero((score >= self.wave.lows[at, j]) & (score <= self.wave.highs[at, j]))
                keep[inside[_first(at[inside], self.per)]] = True
        out = tuple(c[keep] for c in (at, score, ids, named))
        self.held, self.size, self.kept = [out], int(keep.sum()), int(keep.sum())
        return out


def scored(table: DataFrame, wave: Wave, positive: bool, per: int) -> DataFrame:
    """Pairs of the wave's anchors with all rows of equal (or, in a window, of
    another) label, without those that a task knows to be beaten."""
    shared = table.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own, positive, per)
        if not positive:
            low = own.lows.min(axis=1)
            high = np.where(own.lows <= own.highs, own.highs, -LARGEST - 1).max(axis=1)
        for block in Block.each(batches):
            names = block.first + np.arange(len(block.ids))
            for a in range(0, len(own.names), TILE_ANCHORS):
                b = min(a + TILE_ANCHORS, len(own.names))
                score = products(own.vectors[a:b], block.vectors)
                same = own.labels[a:b, None] == block.labels[None, :]
                if positive:
                    wanted = same & (own.names[a:b, None] != names[None, :])
                else:
                    wanted = ~same & (score >= low[a:b, None]) & (score <= high[a:b, None])
                i, k = np.nonzero(wanted)
                best.add(i + a, score[i, k], block.ids[k], block.named[k])
        at, score, ids, named = best.prune()
        for s in range(0, len(at), 50_000):
            e = slice(s, s + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.names[at[e]]), pa.array(own.ids[at[e]]), pa.array(score[e]),
                 pa.array(np.full(len(at[e]), int(not positive), np.int32)), pa.array(ids[e]), pa.array(named[e])],
                ["anchor", "anchor_id", "score", "kind", "id", "named"])

    # a block is about 1 MB: few of them in a batch
    return stored(table.mapInArrow(run, PAIR), "negatives-pairs", batch_rows=16)


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """Rows dealt by anchor and sorted by the whole key. Of equal scores a
    positive comes first, so that its window is open for them; then smaller
    ids, rows without an id last."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "anchor").sortWithinPartitions(
        "anchor", F.col("score").desc(), "kind", F.col("named").desc(), "id")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def first_positives(pairs: DataFrame, positives: int) -> DataFrame:
    """The first pairs of each anchor, from the sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, out = None, 0, []
        for row in _stream(batches):
            if row[0] != last:
                last, n = row[0], 0
            if n < positives:
                out.append(row)
                n += 1
            if len(out) == 10_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return secondary_sort(pairs).mapInArrow(run, PAIR)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["anchor", "anchor_id", "score", "kind", "id", "named"])


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
          "positive_rank int")


def windows(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Each positive of the sorted stream opens a window; each negative goes to
    the open windows that it lies in and that are not full. A window is closed
    when the scores have fallen below it or it is full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        last, opened, out = None, 0, []
        waiting: list[list] = []                     # positive id, its score, negatives so far, its rank
        for anchor, anchor_id, score, kind, row_id, named in _stream(batches):
            if anchor != last:
                last, opened, waiting = anchor, 0, []
            row_id = row_id if named else None
            if kind == 0:
                opened += 1
                waiting.append([row_id, score, 0, opened])
                continue
            waiting = [w for w in waiting if low * w[1] <= 100 * score and w[2] < negatives]
            for w in waiting:
                if 100 * score <= high * w[1]:
                    w[2] += 1
                    out.append((anchor_id, w[0], w[2], row_id, w[1], score, w[3]))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return secondary_sort(pairs).mapInArrow(run, RESULT)


def anchor_rows(table: DataFrame) -> DataFrame:
    """The chosen rows of all blocks, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in Block.each(batches):
            k = np.flatnonzero(b.chosen & b.named)
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.first + k), pa.array(b.ids[k]), pa.array(b.labels[k]),
                     pa.array([b.vectors[i].tobytes() for i in k], pa.binary())],
                    ["anchor", "anchor_id", "label", "vector"])

    return stored(table.mapInArrow(run, ANCHOR), "negatives-anchors", batch_rows=16)


def load_wave(rows: list, positives: dict[int, list[int]], low: int, high: int, most: int) -> Wave:
    """One wave's anchors as arrays; windows of whole scores from the positives'."""
    vectors = [np.frombuffer(r.vector) for r in rows]
    matrix = np.zeros((len(rows), max((len(v) for v in vectors), default=0)))
    for k, v in enumerate(vectors):
        matrix[k, :len(v)] = v
    lows = np.full((len(rows), most), LARGEST, np.int64)
    highs = np.full((len(rows), most), -LARGEST - 1, np.int64)
    for k, r in enumerate(rows):
        for j, s in enumerate(positives.get(r.anchor, ())):
            a, b = -((-low * s) // 100), high * s // 100
            lows[k, j], highs[k, j] = max(a, -LARGEST - 1), min(b, LARGEST)
    return Wave(np.array([r.anchor for r in rows], np.int64), np.array([r.anchor_id for r in rows], np.int64),
                np.array([r.label for r in rows], np.int64), matrix, lows, highs)


def mine(embeddings: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, wave_bytes: int = WAVE_BYTES, max_wave: int = MAX_WAVE,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score and positive_rank. Runs its jobs at once.

    ``anchors`` is a condition on the rows. A component x counts as
    floor(scale * x). An anchor's positives are its first ``positives`` other
    rows of its label by descending score, then id; a positive's negatives the
    first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part. A row without an id is no anchor, but may be a positive or a
    negative, after all equal scores. Rows of equal id are rows of their own;
    an anchor is not its own positive, but its copy is. Vectors of unequal
    length are padded with zeros. Scores beyond the long range stay at its
    ends. An empty table, or one without anchors, gives an empty result; other
    columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = (embeddings.select(embeddings[id_col].cast("long").alias("id"),
                              embeddings[label_col].cast("long").alias("label"),
                              F.coalesce(anchors, F.lit(False)).alias("chosen"),
                              embeddings[vector_col].cast("array<double>").alias("vector"))
            .filter("label is not null and vector is not null"))
    table = blocks(rows, scale, block_rows)
    chosen = anchor_rows(table)
    n, width = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("vector")), F.lit(0))).first()
    per_wave = max(1, min(max_wave, wave_bytes // max(width, 1)))
    n_waves = max(1, -(-n // max(1, per_wave // 2)))     # hashing deals about half a wave to each
    out = None
    for w in range(n_waves):
        own = chosen.filter(F.pmod(F.xxhash64("anchor"), F.lit(n_waves)) == w)
        found = _wave(own, table, positives, negatives, low, high) if n else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def _wave(own: DataFrame, table: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    rows = sorted(own.collect(), key=lambda r: r.anchor)
    if not rows:
        return None
    near = stored(first_positives(scored(table, load_wave(rows, {}, low, high, 1), True, positives), positives),
                  "negatives-positives")
    known: dict[int, list[int]] = {}
    for r in near.select("anchor", "score").collect():       # at most ``positives`` an anchor
        known.setdefault(r.anchor, []).append(r.score)
    wave = load_wave(rows, known, low, high, max(1, positives))
    return windows(near.unionByName(scored(table, wave, False, negatives)), negatives, low, high)
