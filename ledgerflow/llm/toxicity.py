"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

A text is folded (lower case, look-alike letters of other scripts, digits and
signs that stand for letters) and cut into words. An automaton over all
lexicon entries and exception phrases runs once over it. An entry is a whole
word or a word beginning; of several entries in one word the heaviest counts,
and none inside an exception phrase. The sum of weights is divided by a power
of the text's length, and a logistic curve turns it into a score.

Entries, weights, length exponent and curve are learned from labelled rows:
a bounded sample (``max_toxic`` and ``max_clean`` rows, chosen by a hash of
the id) of the labels whose crc32 fold is not held out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored
from ledgerflow.llm.near_dedup import shingles

# Entries that count before any label was seen, and phrases in
# which an entry is harmless.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless",
              "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")
SEED_WEIGHT = 3.0

# Characters drawn like a Latin letter, and signs used for one.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
              "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
              "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
              "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = str.maketrans(LOOKALIKES)
_WORD = re.compile(r"\w+")

FOLDS = 5                                    # fold 0 is held out
MAX_TOXIC, MAX_CLEAN = 2_000, 8_000          # labelled rows to learn from
PREFIXES = (4, 5, 6)                         # lengths of word beginnings considered
MIN_DOCS, MIN_GAIN, MIN_PRECISION = 4, 30.0, 0.5
POWERS = (0.25, 0.5, 1.0)                    # length exponents tried


def folded_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower().translate(_FOLD))


def candidates(words: set[str]) -> set[str]:
    """Entries a text supports: " word " (whole) and " begi" (beginnings)."""
    out = {f" {w} " for w in words}
    out.update(f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k)
    return out


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the score's curve."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": SEED_WEIGHT for w in SEED_WORDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = 0.5
    slope: float = 1.0
    bias: float = -3.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, v in self.weights.items():
            a.add_word(w, (len(w), v))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    def weigh(self, text: str | None, automaton) -> tuple[float, int, int]:
        """Sum of weights, matched words, words of the whole text."""
        words = folded_words(text)
        if not len(automaton) or not words:
            return 0.0, 0, len(words)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        kept = hits.values()
        if spared:
            spared.sort()
            starts = [a for a, _ in spared]
            # the farthest end of the phrases that begin up to each one: longer ones may enclose later ones
            reach = list(accumulate((b for _, b in spared), max))
            before = [bisect_right(starts, s) for s in hits]
            kept = [w for (s, w), k in zip(hits.items(), before) if not k or reach[k - 1] <= s]
        return float(sum(kept)), len(kept), len(words)

    def strength(self, weight: float, n_words: int, power: float | None = None) -> float:
        return float(np.log1p(100 * weight / max(n_words, 1) ** (self.power if power is None else power)))

    def score(self, weight: float, n_words: int) -> float:
        z = self.slope * self.strength(weight, n_words) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    max_toxic: int, max_clean: int) -> DataFrame:
    """(toxic, text) of at most about so many labelled rows outside the held-out fold."""
    own = (labels.select(labels["doc_id"].alias("id"), labels["toxic"].alias("toxic"))
           .filter("id is not null and toxic is not null").filter(fold(F.col("id")) != 0)
           .groupBy("id").agg(F.max("toxic").alias("toxic")))
    n, toxic = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = F.when(F.col("toxic") == 1, max_toxic / max(toxic, 1)).otherwise(max_clean / max(n - toxic, 1))
    chosen = own.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    # the hash keeps the share only on average: a hash order then bounds the list for certain
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(2 * (max_toxic + max_clean))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # rows that repeat a labelled id give one text
    own = (texts.join(F.broadcast(chosen), "id").groupBy("id")
           .agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")))
    return stored(own.select("toxic", "text"), "toxic-sample")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest shingle hash of each text, by which copies are found."""
    for batch in batches:
        marks = [int(s[0]) >> 1 if len(s) else 0 for s in (shingles(t.as_py()) for t in batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic").cast(pa.int32()), pa.array(marks, pa.int64()), batch.column("text")],
            ["toxic", "mark", "text"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            seen[toxic == 1].update(candidates(set(folded_words(text.as_py()))))
        a, b = seen[True], seen[False]
        names = [*a, *(e for e in b if e not in a)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([a[e] for e in names], pa.int64()),
             pa.array([b[e] for e in names], pa.int64())], ["entry", "a", "b"])


def _gain(a, b, na: int, nb: int):
    """Likelihood ratio statistic of entries in a of na toxic and b of nb clean texts."""
    def part(x, e):
        return x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12))
    share = (a + b) / max(na + nb, 1)
    g = 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share))
             + part(nb - b, nb * (1 - share)))
    return np.where(a * nb > b * na, g, 0.0)


def choose(names: list[str], toxic: np.ndarray, clean: np.ndarray) -> dict[str, float]:
    """Entries and weights from two boolean matrices (texts x names).

    Sequential covering: the entry with the largest gain over the toxic texts
    that no chosen entry explains, until none is left. Copies of one text thus
    add nothing once it is explained. Entries about as strong as the median of
    the chosen ones follow.
    """
    nt, nc = len(toxic), len(clean)
    if not nt or not nc or not names:
        return {}
    a, b = toxic.sum(0).astype(float), clean.sum(0).astype(float)
    good = (a / np.maximum(a + b, 1) >= MIN_PRECISION) & (a >= MIN_DOCS)
    length = np.array([len(x) for x in names])
    left, picked = np.ones(nt, bool), []
    while left.any():
        now = toxic[left].sum(0).astype(float)
        gain = np.where(good & (now >= MIN_DOCS), _gain(now, b, int(left.sum()), nc), 0.0)
        best = np.lexsort((length, gain))[-1]          # of equal gains the longest
        if gain[best] < MIN_GAIN:
            break
        picked.append(int(best))
        left &= ~toxic[:, best]
    if picked:
        whole = _gain(a, b, nt, nc)
        bar = max(MIN_GAIN, 0.25 * float(np.median(whole[picked])))
        more = np.nonzero(good & (whole >= bar) & (b <= 0.1 * a))[0]
        for i in sorted(more.tolist(), key=lambda i: (-whole[i], -length[i])):
            # a longer or shorter form of a chosen entry adds nothing
            if not any(names[i].startswith(names[j]) or names[j].startswith(names[i]) for j in picked):
                picked.append(i)
    return {names[i]: float(np.log((a[i] + .5) / (nt + 1)) - np.log((b[i] + .5) / (nc + 1)))
            for i in dict.fromkeys(picked)}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, bias and loss of a ridge logistic curve (Newton steps)."""
    design, w, ridge = np.stack([x, np.ones_like(x)], 1), np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge @ w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """Fit the lexicon. Without labels of both kinds the seed words stay as they are."""
    sample = labelled_sample(docs, labels, id_col, text_col, max_toxic, max_clean)
    # of texts that share their smallest shingle hash (copies) one counts
    texts = stored(sample.mapInArrow(_marked, "toxic int, mark long, text string")
                   .groupBy("toxic", "mark").agg(F.min("text").alias("text")), "toxic-texts")
    # what choose() could not take is left out here: an entry needs its number and share of toxic texts. Its
    # gain grows as texts are explained, so that it is judged there.
    top = (texts.mapInArrow(_counted, "entry string, a long, b long")
           .groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
           .filter((F.col("a") >= MIN_DOCS) & (F.col("a") / (F.col("a") + F.col("b")) >= MIN_PRECISION)))
    names = [r.entry for r in top.select("entry").orderBy("entry").collect()]
    index = {e: i for i, e in enumerate(names)}

    def present(batches):
        for batch in batches:
            found = [np.array(sorted(index[e] for e in candidates(set(folded_words(t.as_py()))) if e in index),
                              np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())],
                                             ["toxic", "found"])

    rows = texts.mapInArrow(present, "toxic int, found binary").collect()      # the bounded sample
    sides = []
    for kind in (1, 0):
        own = [np.frombuffer(r.found, np.uint32) for r in rows if (r.toxic == 1) == (kind == 1)]
        m = np.zeros((len(own), len(names)), bool)
        for i, found in enumerate(own):
            m[i, found] = True
        sides.append(m)
    lexicon = Lexicon()
    lexicon.weights.update(choose(names, *sides))

    def weighed(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            got = [lexicon.weigh(t.as_py(), automaton) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array([g[0] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.int64())], ["toxic", "weight", "n_words"])

    # sorted here, so that the fit does not depend on the order rows arrive in
    seen = sorted(sample.mapInArrow(weighed, "toxic int, weight double, n_words long").collect())
    y = np.array([float(r.toxic == 1) for r in seen])
    if 0 < y.sum() < len(y):
        fits = []
        for power in POWERS:
            x = np.array([lexicon.strength(r.weight, r.n_words, power) for r in seen])
            slope, bias, loss = _curve(x, y)
            if slope > 0:
                fits.append((round(loss, 6), power, slope, bias))
        if fits:
            _, lexicon.power, lexicon.slope, lexicon.bias = min(fits)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and n_hits for every row.

    A null or empty text has no word and gets the curve's lowest score; a null
    id is not held out. Repeated rows are scored each; an empty table gives an
    empty result; other columns are ignored.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [lexicon.weigh(t.as_py(), automaton) for t in batch.column("text")]
            score = [lexicon.score(w, n) for w, _, n in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array([int(s >= 0.5) for s in score], pa.int32()),
                 pa.array([n for _, _, n in got], pa.int64()), pa.array([h for _, h, _ in got], pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_words", "n_hits"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(fold(docs[id_col]) == 0, F.lit(False)).alias("held_out"),
                       docs[text_col].alias("text"))
    return rows.mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int, n_words long, n_hits long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns, in one scan."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = []
            for t in batch.column(at):
                w, _, n = lexicon.weigh(t.as_py(), automaton)
                keep.append(lexicon.score(w, n) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
