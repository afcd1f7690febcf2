"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits,
schemes and cue words. From each anchor a small deterministic parser expands
to the left and right as far as its kind allows and validates what it found.
No text is scanned by a regular expression.

Base kinds, leftmost and non-overlapping within a kind: email, ip, card
(Luhn), phone. Added kinds: ``account`` (an IBAN with valid check digits, or
the number after a cue word such as "account no."), ``login`` (user and
password inside a URL) and ``hidden_email`` (an address written with "(at)"
or "[at]" between blanks or without).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login", "hidden_email")

# Cue words of account numbers, lower case.
CUES = ("iban", "account no", "account number", "acct no", "acct", "kontonummer", "numéro de compte",
        "número de cuenta")
AT_CUES = ("(at)", "[at]", "{at}")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_LOGIN = _ALNUM | frozenset("._%+-!$&'()*,;=~:")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for c in AT_CUES:
        a.add_word(c, ("at_cue", len(c)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def _run(t: str, i: int, allowed: frozenset) -> int:
    n = len(t)
    while i < n and t[i] in allowed:
        i += 1
    return i


def _domain(t: str, i: int) -> int:
    """End of two or more dot-separated labels at i, or -1."""
    end = _run(t, i, _LABEL)
    if end == i:
        return -1
    labels = 1
    while end < len(t) and t[end] == ".":
        nxt = _run(t, end + 1, _LABEL)
        if nxt == end + 1:
            break
        end, labels = nxt, labels + 1
    return end if labels > 1 else -1


def _left(t: str, i: int, least: int, allowed: frozenset) -> int:
    while i > least and t[i - 1] in allowed:
        i -= 1
    return i


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban(t: str, i: int) -> int:
    """End of a valid IBAN at i (blanks between groups of four allowed), or -1."""
    chars, end = [], i
    while end < len(t) and len(chars) < 34:
        if t[end] in _ALNUM:
            chars.append(t[end].upper())
            end += 1
        elif t[end] == " " and chars and len(chars) % 4 == 0 and end + 1 < len(t) and t[end + 1] in _ALNUM:
            end += 1
        else:
            break
        # the number may be followed by a blank and an ordinary word
        if len(chars) >= 15 and (end == len(t) or t[end] not in _ALNUM):
            text = "".join(chars)
            if text[:2].isalpha() and text[2:4].isdigit():
                number = "".join(str(int(c, 36)) for c in text[4:] + text[:4])
                if int(number) % 97 == 1:
                    return end
    return -1


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end), code points, by kind and start."""
    t = text or ""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)            # end of the last match of a kind, valid or not
    ip_tried = 0                               # end of the last run that cannot begin an address

    for last, (kind, length) in anchors().iter(t if t.isascii() and t.islower() else _lowered(t)):
        at = last - length + 1
        if kind == "digit":
            if at >= done["card"]:             # digits with single blanks or hyphens between
                end = at + 1
                while True:
                    if end < len(t) and t[end] in _DIGITS:
                        end += 1
                    elif end + 1 < len(t) and t[end] in " -" and t[end + 1] in _DIGITS:
                        end += 2
                    else:
                        break
                if end - at >= 2:
                    digits = t[at:end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append((at, end))
                done["card"] = end
            if at >= done["ip"] and at >= ip_tried:
                end, parts = _run(t, at, _DIGITS), 1
                ip_tried = end
                while parts < 4 and end + 1 < len(t) and t[end] == "." and t[end + 1] in _DIGITS:
                    end, parts = _run(t, end + 1, _DIGITS), parts + 1
                if parts == 4:
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
                           for p in t[at:end].split(".")):
                        spans["ip"].append((at, end))
                    done["ip"] = end
        elif kind == "at":
            start = _left(t, at, done["email"], _LOCAL)
            end = _domain(t, at + 1) if start < at else -1
            if end > 0:
                spans["email"].append((start, end))
                done["email"] = end
        elif kind == "plus":
            if at >= done["phone"] and at + 1 < len(t) and t[at + 1] in _DIGITS:
                end = _run(t, at + 2, _PHONE)
                while end > at + 3 and t[end - 1] not in _DIGITS:
                    end -= 1
                if end > at + 3 and t[end - 1] in _DIGITS:
                    if 8 <= sum(c in _DIGITS for c in t[at:end]) <= 15:
                        spans["phone"].append((at, end))
                    done["phone"] = end
        elif kind == "scheme":
            end = _run(t, last + 1, _LOGIN)
            if at >= done["login"] and end < len(t) and t[end] == "@" and ":" in t[last + 1:end] \
                    and t[last + 1] != ":" and _run(t, end + 1, _LABEL) > end + 1:
                spans["login"].append((last + 1, end))
                done["login"] = end
        elif kind == "at_cue":
            left = _left(t, at, at - 1, frozenset(" "))
            right = last + 2 if t[last + 1:last + 2] == " " else last + 1
            start, end = _left(t, left, done["hidden_email"], _LOCAL), _domain(t, right)
            if start < left and end > 0:
                spans["hidden_email"].append((start, end))
                done["hidden_email"] = end
        elif at >= done["account"] and (at == 0 or t[at - 1] not in _ALNUM):
            start = _run(t, last + 1, frozenset(" .:#=-"))
            end = _iban(t, start)
            if end < 0:
                end = _run(t, start, _DIGITS)
                end = end if start > last + 1 and 8 <= end - start <= 17 else -1
            if end > 0:
                spans["account"].append((start, end))
                done["account"] = end
    return [(k, s, e) for k in KINDS for s, e in spans[k]]


def _lowered(t: str) -> str:
    """Lower case with every character in place (a few letters lower to two)."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c if len(c.lower()) != 1 else c.lower() for c in t)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets;
    overlapping spans become one, named after the first."""
    t, out, at = text or "", [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [t[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join(out) + t[at:]


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, n_added, and the redacted text if asked for.

    A null text is an empty one without spans. Repeated rows and null ids are
    judged each; an empty table gives an empty result; other columns are
    ignored.
    """
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
              "spans string, n_added long")
    if redacted:
        names, kinds, schema = [*names, "redacted"], [*kinds, pa.string()], schema + ", redacted string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in part.column("text"):
                    t = text.as_py()
                    spans = find(t)
                    base = [s for s in spans if s[0] in BASE]
                    row = [sum(s[0] == k for s in base) for k in BASE]
                    row += [hashlib.sha256(written(base).encode()).hexdigest(), written(spans),
                            len(spans) - len(base)]
                    rows.append(row + [redact(t, spans)] * redacted)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, schema)
