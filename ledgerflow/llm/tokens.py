"""Token ids of whole texts by the tokenizers library, for use inside tasks.

The texts of a batch are cut where the pre-tokenizer of a byte-level BPE always
cuts: before a blank and on both sides of a line feed that stand alone between
other characters, and where ASCII letters, digits and signs (but the
apostrophe) meet. No pre-token reaches over such a place and none looks behind
it, so the ids of the pieces, in turn, are the ids of the text. The places are
found on the batch's bytes as they lie in its Arrow buffer; the pieces are
counted off by Arrow's dictionary encoding, so only distinct pieces of a batch
become Python strings.

Each distinct piece is encoded once per worker while it stays in a bounded
cache; pieces not seen before are encoded many at a time, joined by the blank
or line feed that begins each. A text that spells an added token
(``<|endoftext|>``) is encoded whole, as is every text if the tokenizer is of
another kind.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 800_000            # pieces a worker keeps: about 160 MB
LONGEST = 64                       # characters of a piece that is kept
WORDS = 500                        # encoded in one call
ROWS, BYTES = 1_024, 4 << 20       # texts encoded at once
END_ID = 0

# kinds of bytes; control characters, tab and the like are 0
LETTER, DIGIT, SIGN, BLANK, FEED, QUOTE, HIGH = range(1, 8)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = SIGN
for _kind, _chars in ((LETTER, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"),
                      (BLANK, " "), (FEED, "\n"), (QUOTE, "'")):
    _KIND[list(_chars.encode())] = _kind
_KIND[0x80:] = HIGH
_BORDER = np.zeros(64, bool)       # of two kinds side by side
_BORDER[[8 * a + b for a in (LETTER, DIGIT, SIGN) for b in (LETTER, DIGIT, SIGN) if a != b]] = True
_SOLID = np.isin(np.arange(8), (LETTER, DIGIT, SIGN, QUOTE, HIGH))
# second last byte of all white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000)
_SPACE_BYTE = np.isin(np.arange(256), (0xC2, 0x80, 0x81, 0x9A))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def borders(b: np.ndarray) -> np.ndarray:
    """Where the UTF-8 bytes may be cut: one flag before each byte and one at
    the end. Texts may follow one another, if their first bytes are cut too."""
    cut = np.zeros(len(b) + 1, bool)
    if len(b) < 2:
        return cut
    kind = _KIND[b]
    pair = (kind[:-1] << 3) | kind[1:]
    cut[1:-1] = _BORDER[pair]
    # a sign after a letter of U+00C0 to U+00FF
    at = np.flatnonzero(pair == 8 * HIGH + SIGN) + 1
    last = b[at - 1]
    cut[at[(b[at - 2] == 0xC3) & (last != 0x97) & (last != 0xB7)]] = True
    # white space that stands alone; what may be white space beyond ASCII does not count as another character
    at = np.flatnonzero((kind == BLANK) | (kind == FEED))
    at = at[(at > 0) & (at < len(b) - 1)]
    left, right = kind[at - 1], kind[at + 1]
    alone = _SOLID[left] & _SOLID[right]
    odd = np.flatnonzero(alone & (left == HIGH))
    alone[odd] = ~_SPACE_BYTE[b[at[odd] - 2]]
    odd = np.flatnonzero(alone & (right == HIGH))
    lead, second = b[at[odd] + 1], b[at[odd] + 2]
    alone[odd] = (lead != 0xC2) & ~(((lead >= 0xE1) & (lead <= 0xE3)) & _SPACE_BYTE[second])
    at = at[alone]
    cut[at] = True
    cut[at[kind[at] == FEED] + 1] = True
    return cut


def slices(texts: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """First row and row count of runs of at most ``rows`` texts and about ``size`` bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        to = min(max(int(np.searchsorted(upto, before + size, "right")), at + 1), at + rows)
        yield at, to - at
        at = to


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.cache_entries = cache_entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        file = json.loads(self.tokenizer.to_str())
        before = file.get("pre_tokenizer") or {}
        self.cuts = (before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
                     and before.get("use_regex", True)
                     and not any(file.get(k) for k in ("normalizer", "truncation", "padding")))
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # how byte-level vocabularies write a blank and a line feed
        self.begins = {" ": np.array([n.startswith("Ġ") for n in names]),
                       "\n": np.array([n == "Ċ" for n in names])}
        # cache: a piece's row; the row's ids are ids[first:first + count]
        self.cache: dict[str, int] = {}
        self.ids = np.empty(1 << 16, "<u4")
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n_ids = self.n_rows = 0

    def _spans(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and first and number of each word's, of words that begin
        with a blank, or (mark: line feed) with no white space, and hold no
        other, from one text that joins them."""
        text = "".join(words) if mark == " " else mark + mark.join(words)
        if not any(a in text for a in self.added):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.begins[mark][ids])
            if len(at) == len(words):              # else not such a vocabulary
                first = at + int(mark == "\n")
                return ids, first, np.append(at[1:], len(ids)) - first
        return self._apart(words)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), "<u4", int(count.sum()))
        return ids, np.cumsum(count) - count, count

    def _joined(self, words: list[str], mark: str) -> list[bytes]:
        ids, first, count = self._spans(words, mark)
        return [ids[a:a + n].tobytes() for a, n in zip(first.tolist(), count.tolist())]

    def _add(self, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """New rows, and their numbers."""
        rows, n_ids = self.n_rows + np.arange(len(first)), self.n_ids + len(ids)
        n_rows = self.n_rows + len(first)
        if n_ids > len(self.ids):
            self.ids = np.append(self.ids[:self.n_ids], np.empty(n_ids, "<u4"))
        if n_rows > len(self.first):
            self.first = np.append(self.first[:self.n_rows], np.empty(n_rows, np.int64))
            self.count = np.append(self.count[:self.n_rows], np.empty(n_rows, np.int64))
        self.ids[self.n_ids:n_ids] = ids
        self.first[self.n_rows:n_rows] = first + self.n_ids
        self.count[self.n_rows:n_rows] = count
        self.n_ids, self.n_rows = n_ids, n_rows
        return rows

    def _rows(self, listed: list[str]) -> tuple[np.ndarray, int, int]:
        """The rows of distinct pieces. Rows and ids beyond the two numbers
        returned are of pieces that are not kept."""
        rows = np.fromiter(map(self.cache.get, listed, repeat(-1)), np.int64, len(listed))
        kinds: dict[str, list[int]] = {" ": [], "\n": [], "apart": [], "long": []}
        for k in np.flatnonzero(rows < 0).tolist():
            p = listed[k]
            bare = p.strip()
            if len(p) > LONGEST:
                kind = "long"
            elif not self.cuts or not bare:
                kind = "apart"
            elif p[0] == " " and bare == p[1:] and " " not in bare:
                kind = " "
            elif bare == p and "\n" not in p:
                kind = "\n"
            else:
                kind = "apart"
            kinds[kind].append(k)
        kept = 0, 0
        for kind, own in kinds.items():
            if kind == "long":
                kept = self.n_rows, self.n_ids
            size = 1 if kind == "long" else WORDS
            for at in range(0, len(own), size):
                part = own[at:at + size]
                words = [listed[k] for k in part]
                new = self._add(*(self._spans(words, kind) if kind in self.begins else self._apart(words)))
                rows[part] = new
                if kind != "long":
                    self.cache.update(zip(words, new.tolist()))
        return rows, *kept

    def encode_array(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text (null: empty), followed by ``end`` if given, as binary values."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
            self.n_ids = self.n_rows = 0
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        b = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        cut = borders(b) if self.cuts else np.zeros(len(b) + 1, bool)
        for token in self.added if self.cuts else ():
            for k in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)):
                cut[at[k] + 1:at[k + 1]] = False
        cut[at] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(b))
        coded = pieces.dictionary_encode()
        rows, n_rows, n_ids = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        rows = rows[coded.indices.to_numpy()]
        count = self.count[rows]
        upto = np.append(0, np.cumsum(count))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.first[rows] - upto[:-1], count)]
        self.n_rows, self.n_ids = n_rows, n_ids
        bounds = upto[np.searchsorted(starts, at)]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string())).to_pylist()


@lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder for one tokenizer file."""
    return Encoder(path, cache_entries)
