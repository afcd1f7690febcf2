"""Small tables with the awkward cases, and brute-force helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, "the quick  brown fox jumps over the lazy dog and runs away."),
    (3, "thequickbrownfoxjumpsoverthelazydogandrunsaway."),
    (4, None), (5, ""), (6, " \t\n\r\x0b\x0c "), (7, "a"), (8, "a"), (8, "a"),
    (None, "no id at all, only words"), (None, None),
    (9, "Ünïcödé wörds with ｆｕｌｌｗｉｄｔｈ and 𝔊othic 😀 emoji and nbsp \x1c\x1d\x85　 spaces"),
    (10, "word " * 3000), (11, "x" * 50_000), (12, "line\n" * 500),
    (13, "trailing space "), (14, " leading"), (15, "two\n\nlines\n"), (16, "nul \0 byte"),
    (17, "<|endoftext|> is text <|im_end|>"),
    (2, "another text under a used id, with enough words to count"),
]
EXTRA = ["_lf_id", "_lf_key", "kept", "digest", "row", "source", "n", "cid", "bucket", "toxic", "score"]


def awkward(spark, extra=True):
    """The awkward rows, with further columns whose names clash with working names."""
    cols = "doc_id long, text string"
    rows = AWKWARD
    if extra:
        cols += "".join(f", {c} string" for c in EXTRA)
        rows = [(*r, *[f"s{(r[0] or 0) % 3}" if c == "source" else f"{c} {k}" for c in EXTRA])
                for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, cols)


def prose(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
             for _ in range(vocabulary)]
    return lambda k: " ".join(rng.choice(words) for _ in range(k)), rng


def near_rows(n=120, seed=3):
    """Documents of which many are edited copies of others, at all distances."""
    make, rng = prose(n, seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            text = " ".join(words)
            if rng.random() < 0.2:
                text = text.upper()
        else:
            text = make(rng.choice([3, 8, 40, 120, 200]))
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_components(rows):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            both = len(a & b)
            if a and b and 100 * both >= 85 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}
