import re
from collections import Counter
from itertools import product

import numpy as np

from ledgerflow.llm import quality
from ledgerflow.llm.common import table

from .fixtures import AWKWARD, WORD, awkward, prose

SF = "/root/testdata/sf0.1"


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def texts():
    make, rng = prose(0, 4, vocabulary=12)
    out = [t for _, t in AWKWARD]
    out += ["\n".join(make(rng.randint(0, 12)) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    return out + ["a b c d e f g h " * 2, "a b c d e f g h", "x\n\nx\n \nx\r\nx", "| a | # b\n| a | # b"]


def test_base_counts():
    for t in texts():
        f = quality.facts(t)
        got = (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed)
        assert got == brute(t), repr(t)[:200]
        assert f.line_words.sum() == f.n_words and len(f.line_words) == len(f.features)


def path_score(crf, x, path):
    gain = x @ crf.weights
    return sum(g for g, s in zip(gain, path) if s) + sum(crf.moves[a, b] for a, b in zip(path, path[1:]))


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(0)
    for _ in range(50):
        crf = quality.Field(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(rng.integers(1, 8), len(quality.FEATURES)))
        best = max(path_score(crf, x, p) for p in product((0, 1), repeat=len(x)))
        assert path_score(crf, x, crf.decode(x)) == np.float64(best) or abs(
            path_score(crf, x, crf.decode(x)) - best) < 1e-9
    assert len(quality.Field().decode(np.empty((0, len(quality.FEATURES))))) == 0


def test_gradient_raises_the_likelihood_of_a_known_chain():
    rng = np.random.default_rng(1)
    n, length, d = 60, 6, len(quality.FEATURES)
    y = rng.integers(0, 2, (n, 1)) * np.ones((1, length), int)
    x = rng.normal(size=(n, length, d)) * 0.5
    x[..., 1] += np.where(y == 1, -1.0, 1.0)
    mask = np.arange(length)[None, :] < rng.integers(1, length + 1, n)[:, None]
    crf = quality.train(x, mask, y, steps=80)
    right = [(crf.decode(x[i][mask[i]]) == y[i][mask[i]]).mean() for i in range(n)]
    assert np.mean(right) > 0.95
    assert crf.moves[0, 0] > crf.moves[0, 1]


def test_accuracy_on_rows_not_trained_on(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    crf = quality.learn(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.quality(docs, crf).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    long_enough = [r for r in got if r.n_words >= 20]
    assert np.mean([r.kept == (r.quality == 1) for r in long_enough]) > 0.97
    good = [r.kept for r in long_enough if r.quality == 1]
    assert np.mean(good) > 0.99


def test_awkward_rows(spark):
    got = quality.quality(awkward(spark), quality.Field()).collect()
    assert len(got) == len(AWKWARD)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string"), quality.Field()).count() == 0


def test_without_labels_the_start_weights_stay(spark):
    none = spark.createDataFrame([(1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    crf = quality.learn(awkward(spark), none)
    assert np.array_equal(crf.weights, np.array(quality.START))


def test_planted_header_and_footer_are_marked(spark):
    """Good pages with junk lines around them: these lines are boilerplate, the rest is content."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    crf = quality.learn(docs, labels.filter("doc_id % 2 = 0"))
    good = [r.text for r in docs.join(labels.filter("quality = 1 and doc_id % 2 = 1"), "doc_id")
            .select("text").collect() if r.text.count("\n") >= 3]
    junk = ["CLICK!! HERE!! NOW!! SUBSCRIBE!! TODAY!! FREE!!", "home%%% about*** login$$$ cart### help&&& terms%%%"]
    right = wrong = mixed = 0
    for k, text in enumerate(good):
        lines = [x for x in text.split("\n") if x.split()]
        page = [junk[k % 2]] + lines + [junk[(k + 1) % 2], junk[k % 2] + " again!!"]
        f = quality.facts("\n".join(page))
        got = crf.decode(f.features).tolist()
        want = [0] + [1] * len(lines) + [0, 0]
        right += sum(a == b for a, b in zip(got, want))
        wrong += sum(a != b for a, b in zip(got, want))
        mixed += 0 < crf.content_share(f) < 1
    assert len(good) > 30 and mixed > 0.95 * len(good)
    assert right > 0.95 * (right + wrong)


def test_sequences_use_all_lines_and_change_state():
    width = len(quality.FEATURES)
    good, poor = [np.ones((150, width)), np.ones((2, width))], [np.zeros((130, width)), np.zeros((1, width))]
    mixed = np.zeros((6, width))
    mixed[2, 0] = 1                                  # bias alone: content by the start weights
    assert quality.sequences(good, [mixed])[2].sum() == 2 * 152 + 1
    x, mask, y = quality.sequences(good, poor)
    assert x.shape[1] == quality.SPAN
    assert mask.sum() >= 2 * 152 + 131
    assert (x[mask][:, 0] == y[mask]).all()                     # every line keeps the state it came with
    changes = sum((np.diff(y[i][mask[i]]) != 0).sum() for i in range(len(y)))
    assert changes >= 1


def test_rows_that_repeat_a_labelled_id_give_one_text(spark):
    rows = [(1, "good text here " * 8)] * 500 + [(2, "BAD!! " * 40)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert isinstance(quality.learn(docs, labels), quality.Field)
