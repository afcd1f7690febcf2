"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to lower case, and whatever is no letter becomes one blank.
Learning counts the grams of ``ORDER`` characters of every learning text, by
language; tasks add up what they see before anything is shuffled. Discounts,
continuation counts and back-off weights of all orders follow from these
counts by Spark aggregates and joins. A language's model is one sorted array
of gram hashes beside arrays of log probabilities and back-off weights. A
text gets the language of the lowest cross-entropy per character.

Calibration texts (a bounded number, chosen by a hash of the text, copies
counted once, and not counted into the models) set the sharpness of the score
and, for each language, the cross-entropy beyond which a prediction is marked
as rejected.

Hashes are cut to ``HASH_BITS`` bits, so that a language's arrays hold 2^24
entries of 12 bytes at most, however large the corpus. Languages are
broadcast in waves of at most ``WAVE_BYTES``; a further wave reads the table
that the wave before has written.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

ORDER = 4
HASH_BITS = 24
WAVE_BYTES = 256 << 20
FOLDS, HELD_OUT = 4, 2
CALIBRATION_ROWS = 2000         # about so many texts set the score's sharpness
REJECTED_SHARE = 0.005          # of right calibration texts, so many are beyond the limit
SLICE = 1 << 18                 # characters of a text looked at together
FLUSH_GRAMS = 1 << 18           # distinct grams that a task adds up before it passes them on
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def normalised(text: str | None) -> str:
    """Letters in lower case with single blanks between; empty without a letter."""
    out = _OTHER.sub(" ", (text or "").lower()).strip()
    return out if any(map(str.isalpha, set(out))) else ""


def slices(text: str, size: int = SLICE) -> list[str]:
    """The padded text in slices, one gram for each character and the last blank."""
    padded = " " * (ORDER - 1) + text + " "
    return [padded[at:at + size + ORDER - 1] for at in range(0, len(padded) - ORDER + 1, size)]


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (rows of ORDER code points) of slices, and the number of
    the gram at each place, slice after slice."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    alphabet = np.flatnonzero(np.bincount(points))
    code = np.zeros(int(points.max()) + 1, np.int64)
    code[alphabet] = np.arange(len(alphabet))
    code = code[points]
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(len(points), bool)
    for back in range(1, ORDER):
        inside[ends - back] = False
    places = np.flatnonzero(inside)
    width = len(alphabet)
    if width ** ORDER >= 1 << 62:
        rows = np.stack([code[places + j] for j in range(ORDER)], axis=1)
        distinct, number = np.unique(rows, axis=0, return_inverse=True)
        return alphabet[distinct], number.reshape(-1)
    key = code[:-(ORDER - 1)].copy()
    for j in range(1, ORDER):
        key *= width
        key += code[j:len(code) - ORDER + 1 + j]
    distinct, number = np.unique(key[places], return_inverse=True)
    digits = [distinct // width ** (ORDER - 1 - j) % width for j in range(ORDER)]
    return alphabet[np.stack(digits, axis=1)], number


def hashed(points: np.ndarray) -> np.ndarray:
    """HASH_BITS-bit hashes of grams, given as rows of code points."""
    h = np.full(len(points), 0x9E3779B97F4A7C15 * (points.shape[1] + 1) & (1 << 64) - 1, np.uint64)
    for j in range(points.shape[1]):
        h ^= points[:, j].astype(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


@dataclass
class Model:
    """One language: sorted gram hashes, with nan where a value is lacking."""

    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray
    unseen: float

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def logs(self, keys: dict[int, np.ndarray], contexts: dict[int, np.ndarray]) -> np.ndarray:
        """Log probability of each gram's last character, by backing off."""
        total = np.zeros(len(keys[1]))
        wanted = np.arange(len(total))
        for n in range(ORDER, 0, -1):
            at, hit = self.find(keys[n][wanted])
            logp = self.logp[at]
            hit &= ~np.isnan(logp)
            total[wanted[hit]] += logp[hit]
            wanted = wanted[~hit]
            if n > 1:
                at, hit = self.find(contexts[n][wanted])
                back = self.back[at]
                hit &= ~np.isnan(back)
                total[wanted[hit]] += back[hit]
        total[wanted] += self.unseen
        return total


def entropies(texts: list[str], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy (nats a character) of each text under each model, and the
    characters predicted; no letter gives 0 characters. Texts are looked at in
    groups of about SLICE characters, so a very long one needs no more memory."""
    sums, n = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64)

    def flush(parts: list[str], owners: list[int]) -> None:
        points, number = grams(parts)
        keys = {m: hashed(points[:, ORDER - m:]) for m in range(1, ORDER + 1)}
        contexts = {m: hashed(points[:, ORDER - m:ORDER - 1]) for m in range(2, ORDER + 1)}
        lengths = np.array([len(p) - ORDER + 1 for p in parts])
        starts = np.cumsum(lengths) - lengths
        np.add.at(n, owners, lengths)
        for j, model in enumerate(models):
            np.add.at(sums[:, j], owners, -np.add.reduceat(model.logs(keys, contexts)[number], starts))

    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        for part in slices(text) if text else ():
            parts.append(part)
            owners.append(k)
            size += len(part)
            if size >= SLICE:
                flush(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        flush(parts, owners)
    return sums / np.maximum(n, 1)[:, None], n


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, c) of every text of (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*[(lang, g, c) for lang, own in seen.items() for g, c in own.items()]))
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "c"])

        def add(lang: str, parts: list[str]) -> None:
            points, number = grams(parts)
            raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            own = seen.setdefault(lang, {})
            for k, c in enumerate(np.bincount(number).tolist()):
                g = raw[ORDER * k:ORDER * (k + 1)]
                own[g] = own.get(g, 0) + c

        for batch in batches:
            waiting: dict[str, tuple[list[str], int]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                text = normalised(text)
                for part in slices(text) if text else ():
                    parts, size = waiting.get(lang, ([], 0))
                    parts.append(part)
                    waiting[lang] = (parts, size + len(part))
                    if size + len(part) >= SLICE:
                        add(lang, waiting.pop(lang)[0])
            for lang, (parts, _) in waiting.items():
                add(lang, parts)
            if sum(map(len, seen.values())) >= FLUSH_GRAMS:
                yield out()
        if seen:
            yield out()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, gram string, c long")
    return found.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, logp, back) of all orders, and (lang, unseen), from the
    counts of the highest order. Lower orders count the distinct characters
    that precede a gram. D = n1 / (n1 + 2 n2), held between 0.1 and 0.9;
    P(g) = max(c(g) - D, 0) / C(context) + D types(context) / C(context) P(g
    without its first character); order 0 is even over the seen characters
    and one more."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = (tables[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
                     .agg(F.count(F.lit(1)).alias("c")))
    entries: list[DataFrame] = []
    lower = unseen = None
    for n in range(1, ORDER + 1):
        own = tables[n].withColumn("context", F.col("gram").substr(1, n - 1))
        discount = (own.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"),
                                            F.count_if(F.col("c") == 2).alias("n2"))
                    .select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(
                        F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5)))).alias("d")))
        contexts = (own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
                    .join(discount, "lang")
                    .withColumn("gamma", F.col("d") * F.col("types") / F.col("total")))
        known = own.join(contexts, ["lang", "context"])
        seen = (F.col("c") - F.col("d")) / F.col("total")
        if lower is None:
            even = F.col("gamma") / (F.col("types") + 1)
            unseen = contexts.select("lang", F.log(even).alias("unseen"))
            p = known.select("lang", "gram", (F.greatest(seen, F.lit(0.0)) + even).alias("p"))
        else:
            entries.append(contexts.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double")
                                           .alias("logp"), F.log("gamma").alias("back")))
            p = (known.withColumn("suffix", F.expr("substring(gram, 2)"))
                 .join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
                 .select("lang", "gram", (F.greatest(seen, F.lit(0.0)) + F.col("gamma") * F.col("q")).alias("p")))
        lower = stored(p, f"lang-order{n}")
        entries.append(lower.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double")
                                    .alias("back")))
    out = entries[0]
    for e in entries[1:]:
        out = out.unionByName(e)
    return out, unseen


def hash_arrays(entries: DataFrame) -> DataFrame:
    """(lang, key, logp, back): one row for each hash, the likelier on a collision."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("gram").to_pylist()
            key = np.zeros(len(found), np.int64)
            for n in {len(g) for g in found}:
                own = [k for k, g in enumerate(found) if len(g) == n]
                raw = "".join(found[k] for k in own).encode("utf-32-le", "surrogatepass")
                key[own] = hashed(np.frombuffer(raw, "<u4").reshape(-1, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(key), batch.column("logp"), batch.column("back")],
                ["lang", "key", "logp", "back"])

    return (entries.mapInArrow(run, "lang string, key long, logp double, back double")
            .groupBy("lang", "key").agg(F.max("logp").alias("logp"), F.max("back").alias("back")))


@dataclass
class LanguageModels:
    """The written arrays (one row a language and hash), and what calibration found."""

    arrays: DataFrame
    unseen: dict[str, float]
    entries: dict[str, int]
    sharpness: float = 1.0
    means: dict[str, float] = field(default_factory=dict)
    limits: dict[str, float] = field(default_factory=dict)

    @property
    def langs(self) -> list[str]:
        return sorted(self.unseen)

    def waves(self, wave_bytes: int = WAVE_BYTES) -> list[list[str]]:
        """Languages in groups whose arrays hold at most ``wave_bytes``, one language at least."""
        out: list[list[str]] = []
        size = 0
        for lang in self.langs:
            own = 12 * self.entries[lang]
            if not out or size + own > wave_bytes:
                out.append([])
                size = 0
            out[-1].append(lang)
            size += own
        return out

    def load(self, langs: list[str]) -> list[Model]:
        """The arrays of one wave."""
        out = []
        for lang in langs:
            rows = (self.arrays.filter(F.col("lang") == lang)
                    .select(F.col("key").cast("int").alias("key"), F.col("logp").cast("float").alias("logp"),
                            F.col("back").cast("float").alias("back")).toArrow())
            key = rows.column("key").to_numpy().astype(np.uint32)
            order = np.argsort(key)
            logp, back = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float32)[order]
                          for c in ("logp", "back"))
            out.append(Model(key[order], logp, back, self.unseen[lang]))
        return out


def with_entropies(rows: DataFrame, models: LanguageModels, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``rows`` (with a column text) plus n (characters predicted) and nats, the
    cross-entropy under each language in order of ``models.langs``."""
    spark = rows.sparkSession
    out = rows.withColumn("n", F.lit(0).cast("long")).withColumn("nats", F.array().cast("array<double>"))
    waves = models.waves(wave_bytes)
    for w, langs in enumerate(waves):
        shared = spark.sparkContext.broadcast(models.load(langs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nats, n = entropies([normalised(t) for t in batch.column("text").to_pylist()], shared.value)
                before = batch.column("nats").to_pylist()
                joined = pa.array([b + own for b, own in zip(before, nats.tolist())], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in batch.schema.names if c not in ("n", "nats")), pa.array(n), joined],
                    [*(c for c in batch.schema.names if c not in ("n", "nats")), "n", "nats"])

        out = out.mapInArrow(run, out.schema)
        if w + 1 < len(waves):
            out = stored(out, "lang-wave")
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          calibration_rows: int = CALIBRATION_ROWS) -> LanguageModels:
    """Models of every language of the learning rows: text and language not
    null, and outside the held-out fold (a null id is in no fold and is learned
    from). Without learning rows there is no language. Runs its jobs at once."""
    own = (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                       docs[lang_col].cast("string").alias("lang"))
           .filter("text is not null and lang is not null")
           .filter(F.coalesce(fold(F.col("id")) != HELD_OUT, F.lit(True)))
           .withColumn("mark", F.xxhash64("text")))
    n = own.count()
    share = min(0.2, calibration_rows / max(n, 1))
    chosen = F.pmod(F.col("mark"), F.lit(1_000_000)) < int(share * 1_000_000)
    counts = stored(gram_counts(own.filter(~chosen)), "lang-counts")
    entries, unseen = kneser_ney(counts)
    arrays = stored(hash_arrays(entries), "lang-arrays")
    sizes = {r.lang: r.n for r in arrays.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = LanguageModels(arrays, {r.lang: r.unseen for r in unseen.collect()}, sizes)
    if models.langs:
        # copies count once; the languages of one text are joined by the smallest
        sample = own.filter(chosen).groupBy("mark").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
        calibrate(models, with_entropies(sample.select("lang", "text"), models).select("lang", "n", "nats"))
    return models


def calibrate(models: LanguageModels, scored: DataFrame) -> None:
    """Sets sharpness, means and limits from (lang, n, nats) of bounded rows."""
    at = {lang: j for j, lang in enumerate(models.langs)}
    rows = sorted((at[r.lang], r.n, r.nats) for r in scored.collect() if r.n and r.lang in at)
    if not rows:
        return
    truth, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    nats = np.array([r[2] for r in rows])
    loss = []
    for sharpness in 2.0 ** np.arange(-6, 7):
        loss.append((float(-np.log(np.maximum(scores(nats, n, sharpness)[np.arange(len(rows)), truth], 1e-12)).mean()),
                     float(sharpness)))
    models.sharpness = min(loss)[1]
    right = nats.argmin(axis=1) == truth
    for lang, j in at.items():
        own = right & (truth == j)
        if own.any():
            models.means[lang] = float(nats[own, j].mean())
            beyond = np.sort((nats[own, j] - models.means[lang]) * np.sqrt(n[own]))
            models.limits[lang] = float(beyond[min(len(beyond) - 1, math.ceil(len(beyond) * (1 - REJECTED_SHARE)))])


def scores(nats: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    """Shares of the languages: softmax of -sharpness sqrt(n) nats."""
    z = -sharpness * np.sqrt(n)[:, None] * (nats - nats.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text",
             wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, nats (the lowest cross-entropy per
    character) and rejected, for every row.

    A null text, one without a letter, and any text when no language was
    learned give ``und``, score 0, no cross-entropy, and count as rejected.
    Ties go to the smaller language name. A prediction is rejected where its
    cross-entropy lies beyond its language's limit; it is still returned. A
    null id is not held out. Repeated rows are judged each; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(fold(docs[id_col]) == HELD_OUT, F.lit(False)).alias("held_out"),
                       docs[text_col].alias("text"))
    langs = models.langs
    sharpness, means, limits = models.sharpness, models.means, models.limits

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            pred, score, low, rejected = [], [], [], []
            if langs and len(n):
                nats = np.array(batch.column("nats").to_pylist())
                share, best = scores(nats, n, sharpness), nats.argmin(axis=1)
                for k, j in enumerate(best.tolist()):
                    lang, h = langs[j], float(nats[k, j])
                    pred.append(lang if n[k] else UNKNOWN)
                    score.append(float(share[k, j]) if n[k] else 0.0)
                    low.append(h if n[k] else None)
                    far = lang in limits and (h - means[lang]) * math.sqrt(n[k]) > limits[lang]
                    rejected.append(bool(far or not n[k]))
            else:
                pred, score = [UNKNOWN] * len(n), [0.0] * len(n)
                low, rejected = [None] * len(n), [True] * len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "nats", "rejected"])

    return with_entropies(rows, models, wave_bytes).drop("text").mapInArrow(
        judged, "doc_id long, held_out boolean, lang_pred string, score double, nats double, rejected boolean")
