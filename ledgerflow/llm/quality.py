"""Quality rules by line sequence labelling.

Every line with a word gets a feature vector (shares of symbols, capitals,
digits, exclamation marks, repeated and repeating words, length, earlier
copies, line end). A linear-chain conditional random field with the states
boilerplate and content scores a text's whole line sequence, Viterbi decoding
picks the best labelling, and the share of words in content lines decides
whether the text stays. Fixed base rules come first: a text with fewer than
20 words, or with more than 30 % of its words inside eight-word windows that
occur twice or more, fails.

The field is trained here by gradient ascent on its likelihood (forward and
backward recursions) over a bounded sample of labelled rows and all their
lines. A label tells of a whole text, so lines get states of their own: of a
poor text, those that the start weights hold for content by SURE or more stay
content, unless all would. And since boilerplate stands around content, good texts are also
set between poor texts' boilerplate lines, as header and footer, and the field
learns from these joined sequences when the state changes. Without labels of both kinds the start weights stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 0.30
MIN_CONTENT = 0.5
MAX_ROWS = 3_000                # labelled rows to train on, with all their lines
SPAN = 64                       # lines of a training sequence: longer texts are cut into several
SURE = 1.0                      # start score of a poor text's line that counts as content
FRAME = 3                       # header and footer lines of a joined sequence, at most
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
SYMBOLS = "#*$%&|<>"

FEATURES = ("bias", "symbols", "capitals", "digits", "shouts", "repeating", "repeated", "short", "copy", "ended",
            "word_length", "length")
# Start weights of the content state.
START = (2.0, -20.0, -6.0, -2.0, -6.0, -8.0, -1.0, -0.5, -1.0, 0.5, 0.0, 0.5)

_WS, _SYM, _UP, _DIGIT, _SHOUT, _END, _LETTER = 1, 2, 4, 8, 16, 32, 64
_TOP = 0x250
_CLASS = np.zeros(_TOP + 1, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WS
for _i in range(_TOP):
    _c = chr(_i)
    _CLASS[_i] |= (_SYM * (_c in SYMBOLS) | _UP * _c.isupper() | _DIGIT * (_c in "0123456789") | _SHOUT * (_c == "!")
                   | _END * (_c in ".?:;\"»)") | _LETTER * _c.isalpha())
_CLASS[_TOP] = _LETTER


@dataclass
class Facts:
    """Base counts of one text and the features of its lines with a word."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    features: np.ndarray = field(default_factory=lambda: np.empty((0, len(FEATURES))))
    line_words: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 100 * MAX_REPEAT * self.n_words


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more.

    Window numbers are built by doubling (pairs, fours, eights), so that equal
    numbers mean equal windows.
    """
    n = len(ids)
    if n <= WINDOW:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < WINDOW:
        _, rank = np.unique(rank[:-width] * (n + 1) + rank[width:], return_inverse=True)
        width *= 2
    _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    hit = np.nonzero(count[inverse] > 1)[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def facts(text: str | None) -> Facts:
    if not text:
        return Facts()
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()                                  # exactly [^\x20\x09-\x0D]+
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _CLASS[np.minimum(points, _TOP)]
    blank = (kind & _WS) > 0
    out = Facts(n_words=len(words), word_chars=int((~blank).sum()), n_symbols=int(((kind & _SYM) > 0).sum()))
    if not words:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out.n_repeat_words = repeated_words(ids)

    begins = ~blank & np.concatenate([[True], blank[:-1]])
    line_of = np.cumsum(points == 10) - (points == 10)   # a line ends with its line feed
    n_lines = int(line_of[-1]) + 1
    word_line = line_of[begins]
    per_line = np.bincount(word_line, minlength=n_lines)
    has = np.nonzero(per_line)[0]

    copy, seen = np.zeros(n_lines), set()
    lines = text.split("\n")
    for i in has.tolist():
        if lines[i] in seen:
            copy[i] = 1
        seen.add(lines[i])
    out.n_dup_lines = int(copy.sum())

    def share(flag: int) -> np.ndarray:
        return np.bincount(line_of[(kind & flag) > 0], minlength=n_lines)[has]

    n = per_line[has].astype(float)
    solid = np.bincount(line_of[~blank], minlength=n_lines)[has].astype(float)
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (word_line[1:] == word_line[:-1])])
    repeating = np.bincount(word_line[same], minlength=n_lines)[has] / n
    distinct = np.bincount(np.unique(word_line.astype(np.int64) * len(number) + ids) // len(number),
                           minlength=n_lines)[has]
    last = np.zeros(n_lines)
    solid_at = np.nonzero(~blank)[0]
    last[line_of[solid_at]] = (kind[solid_at] & _END) > 0       # the last character of a line wins
    out.features = np.stack([
        np.ones(len(has)), share(_SYM) / solid, share(_UP) / np.maximum(share(_LETTER), 1), share(_DIGIT) / solid,
        np.minimum(share(_SHOUT) / n, 2), repeating, 1 - distinct / n, 1 / n, copy[has], last[has],
        np.minimum(solid / n / 10, 3), np.log1p(n) / 5], 1)
    out.line_words = per_line[has]
    return out


@dataclass
class Field:
    """A two-state chain: content scores w·x, boilerplate 0, plus transitions."""

    weights: np.ndarray = field(default_factory=lambda: np.array(START))
    moves: np.ndarray = field(default_factory=lambda: np.array([[0.5, 0.0], [0.0, 0.5]]))
    least: float = MIN_CONTENT                          # content share of a text that stays

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labelling (1: content) by Viterbi; ties go to content."""
        if not len(features):
            return np.empty(0, int)
        gain = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, gain[0], []                   # best scores ending in boilerplate, content
        for g in gain[1:]:
            to_a, to_b = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((to_a, to_b))
            a, b = (b + m10 if to_a else a + m00), (b + m11 if to_b else a + m01) + g
        state, out = b >= a, []
        for step in reversed(back):
            out.append(state)
            state = step[state]
        out.append(state)
        return np.array(out[::-1], int)

    def content_share(self, f: Facts) -> float:
        return float(f.line_words[self.decode(f.features) == 1].sum() / f.n_words) if f.n_words else 0.0


def _log_sum(a, b):
    return np.logaddexp(a, b)


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood for sequences x (texts, lines, features) with states y (texts, lines)."""
    own = Field()
    w, t = own.weights.copy(), own.moves.copy()
    texts, length, _ = x.shape
    m = np.zeros((2, len(w) + 4)), np.zeros((2, len(w) + 4))
    total = mask.sum()
    for step in range(1, steps + 1):
        e = np.stack([np.zeros((texts, length)), x @ w], -1)
        e[~mask] = 0
        alpha, beta = np.zeros((texts, length, 2)), np.zeros((texts, length, 2))
        alpha[:, 0] = e[:, 0]
        for i in range(1, length):
            nxt = np.stack([_log_sum(alpha[:, i - 1, 0] + t[0, s], alpha[:, i - 1, 1] + t[1, s]) + e[:, i, s]
                            for s in (0, 1)], -1)
            alpha[:, i] = np.where(mask[:, i, None], nxt, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            prv = np.stack([_log_sum(t[s, 0] + e[:, i + 1, 0] + beta[:, i + 1, 0],
                                     t[s, 1] + e[:, i + 1, 1] + beta[:, i + 1, 1]) for s in (0, 1)], -1)
            beta[:, i] = np.where(mask[:, i + 1, None], prv, 0)
        z = _log_sum(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(np.clip(alpha + beta - z[:, None, None], -50, 0)) * mask[..., None]
        grad_w = np.einsum("nl,nlf->f", (y - p[..., 1]) * mask, x)
        grad_t = np.zeros((2, 2))
        both = mask[:, 1:] & mask[:, :-1]
        for a in (0, 1):
            for b in (0, 1):
                pair = alpha[:, :-1, a] + t[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]
                seen = (y[:, :-1] == a) & (y[:, 1:] == b)
                grad_t[a, b] = ((seen - np.exp(np.clip(pair, -50, 0))) * both).sum()
        g = np.concatenate([grad_w, grad_t.ravel()]) / total - RIDGE * np.concatenate([w, t.ravel()])
        m[0][0] = 0.9 * m[0][0] + 0.1 * g
        m[1][0] = 0.999 * m[1][0] + 0.001 * g * g
        move = RATE * (m[0][0] / (1 - 0.9 ** step)) / (np.sqrt(m[1][0] / (1 - 0.999 ** step)) + 1e-8)
        w, t = w + move[:len(w)], t + move[len(w):].reshape(2, 2)
    return Field(w, t)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS) -> Field:
    """Train on at most about ``max_rows`` labelled rows of each quality, chosen
    by a hash of the id; of rows that repeat a labelled id, one text is taken."""
    own = (labels.select(labels["doc_id"].alias("id"), labels["quality"].alias("quality"))
           .filter("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality")))
    n, good = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not good or good == n:
        return Field()
    half = max_rows / 2
    share = F.when(F.col("quality") == 1, half / good).otherwise(half / (n - good))
    chosen = (own.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
              .orderBy(F.xxhash64("id"), "id").limit(2 * max_rows))
    sample = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))

    def featured(batches):
        for batch in batches:
            rows = [facts(t.as_py()).features for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality").cast(pa.int32()), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())],
                ["quality", "features"])

    rows = stored(sample.select("quality", "text").mapInArrow(featured, "quality int, features binary"),
                  "quality-sample").filter("length(features) > 0").collect()
    # sorted here, so that the fit does not depend on the order rows arrive in
    rows.sort(key=lambda r: (r.quality, bytes(r.features)))
    if len({r.quality for r in rows}) < 2:
        return Field()
    lines = [(r.quality, np.frombuffer(r.features, "<f4").reshape(-1, len(FEATURES))) for r in rows]
    own_field = train(*sequences([x for q, x in lines if q == 1], [x for q, x in lines if q != 1]))
    own_field.least = least_share(own_field, lines)
    return own_field


def least_share(own: Field, lines: list[tuple[int, np.ndarray]]) -> float:
    """The content share, from MIN_CONTENT up, that parts good texts from poor
    ones with the fewest errors, both kinds weighing alike; of equals the lowest."""
    shares: tuple[list[float], list[float]] = ([], [])
    for q, x in lines:
        words = np.expm1(5 * x[:, FEATURES.index("length")])
        shares[int(q == 1)].append(float(words[own.decode(x) == 1].sum() / words.sum()))
    poor, good = map(np.array, shares)
    errors = [((poor >= c).mean() + (good < c).mean(), c) for c in np.arange(MIN_CONTENT, 1.0, 0.05).round(2).tolist()]
    return min(errors)[1]


def sequences(good: list[np.ndarray], poor: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training sequences (lines, mask, states): the texts themselves, and each
    good text between up to FRAME boilerplate lines; none is longer than SPAN."""
    whole, frames = [(x, np.ones(len(x), int)) for x in good], []
    for x in poor:
        states = (x @ np.array(START) > SURE).astype(int)
        states = states if not states.all() else np.zeros(len(x), int)
        whole.append((x, states))
        frames.append(x[states == 0])
    for i, x in enumerate(good):
        head = frames[i % len(frames)][:i % (FRAME + 1)]
        foot = frames[-1 - i % len(frames)][:i // (FRAME + 1) % (FRAME + 1)]
        whole.append((np.concatenate([head, x, foot]),
                      np.repeat([0, 1, 0], [len(head), len(x), len(foot)])))
    cut = [(x[at:at + SPAN], s[at:at + SPAN]) for x, s in whole for at in range(0, len(x), SPAN)]
    length = max(len(x) for x, _ in cut)
    x, mask = np.zeros((len(cut), length, len(FEATURES))), np.zeros((len(cut), length), bool)
    y = np.zeros((len(cut), length), int)
    for i, (own, states) in enumerate(cut):
        x[i, :len(own)], mask[i, :len(own)], y[i, :len(own)] = own, True, states
    return x, mask, y


def quality(docs: DataFrame, crf: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and content_share for every row.

    A null or wordless text has counts of 0 (but its symbols) and fails the
    base rules. Repeated rows and null ids are judged each; an empty table
    gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "content_share"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                f = facts(text.as_py())
                share = crf.content_share(f)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
                             not f.base_failed and share >= crf.least, share))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, content_share double")
