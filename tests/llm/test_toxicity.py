import random
import zlib

import numpy as np

from ledgerflow.llm import toxicity
from ledgerflow.llm.common import table

from .fixtures import AWKWARD, awkward

SF = "/root/testdata/sf0.1"


def test_held_out_english_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    lex = toxicity.learn(docs, labels)
    got = (toxicity.toxicity(docs, lex).filter("held_out").join(labels, "doc_id")
           .join(docs.select("doc_id", "lang"), "doc_id").filter("lang = 'en'").collect())
    hits = [r.predicted == r.toxic for r in got]
    assert len(hits) > 300 and np.mean(hits) > 0.97
    positives = [r.predicted for r in got if r.toxic == 1]
    assert np.mean(positives) > 0.9


def test_learns_beginnings_and_ignores_copies():
    # 30 copies of one toxic text share a word that means nothing
    names = [" bad", " copyword ", " the "]
    toxic = np.array([[1, 1, 1]] * 30 + [[1, 0, 1]] * 40, bool)
    clean = np.array([[0, 0, 1]] * 200, bool)
    chosen = toxicity.choose(names, toxic, clean)
    assert " bad" in chosen and " the " not in chosen
    assert chosen[" bad"] > 3


def test_folding_and_exceptions():
    lex = toxicity.Lexicon()
    a = lex.automaton()
    for t in ("You 1d10t!", "you IDIOT", "уou іdiоt", "m0r0n"):
        assert lex.weigh(t, a)[1] == 1, t
    assert lex.weigh("put it in the trash can", a)[1] == 0
    assert lex.weigh("such trash, can you believe", a)[1] == 0      # punctuation is folded away
    assert lex.weigh("trash", a)[1] == 1
    assert lex.weigh("idiots", a)[1] == 0                            # whole words only
    assert lex.score(*lex.weigh("idiot " * 5, a)[::2]) > lex.score(*lex.weigh("idiot " + "fine " * 500, a)[::2])


def test_awkward_rows(spark):
    got = toxicity.toxicity(awkward(spark), toxicity.Lexicon()).collect()
    assert len(got) == len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == want
    out = toxicity.drop_toxic(awkward(spark), toxicity.Lexicon())
    assert out.columns == awkward(spark).columns and out.count() == len(AWKWARD)


def test_without_labels_the_seed_words_stay(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, none).weights == toxicity.Lexicon().weights
    nulls = spark.createDataFrame([(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, nulls).weights == toxicity.Lexicon().weights
    empty = spark.createDataFrame([], docs.schema)
    assert toxicity.toxicity(empty, toxicity.Lexicon()).count() == 0


def test_learns_a_marker_from_labels(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, f"plain words number {i} " + (f"zzub{i % 37} here" if toxic else "are here")))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels[:10], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(docs, lab)
    got = toxicity.toxicity(docs, lex).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)


def test_learns_markers_rarer_than_thousands_of_ordinary_entries(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(8)) for _ in range(3000)]
    markers = ["zaxquob", "zubfrim", "yoxplen", "yitgarb", "xelbund", "xovnapt"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.sample(words, 1500) + [markers[i // 5 % 6]] * (10 * toxic))))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    lex = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(any(f" {m} ".startswith(e) for e in lex.weights) for m in markers)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in toxicity.toxicity(docs, lex).collect())


def naive(lexicon, text):
    """weigh by trying every entry and phrase at every place."""
    words = toxicity.folded_words(text)
    line = f" {' '.join(words)} "
    hits, spared = {}, []
    for at in range(len(line)):
        for entry, weight in lexicon.weights.items():
            if line.startswith(entry, at):
                hits[at] = max(weight, hits.get(at, 0.0))
        for phrase in lexicon.exceptions:
            if line.startswith(f" {phrase} ", at):
                spared.append((at, at + len(phrase) + 1))
    kept = [w for s, w in hits.items() if not any(a <= s < b for a, b in spared)]
    return sum(kept), len(kept), len(words)


def test_weigh_equals_a_naive_matcher():
    import random

    rng = random.Random(8)
    lexicon = toxicity.Lexicon(weights={" bad ": 2.0, " bad": 1.0, " worse ": 3.0, " pond ": 1.5, " scum ": 2.5, " b": 0.5},
                               exceptions=("pond scum", "bad pond", "worse bad pond scum", "scum"))
    automaton = lexicon.automaton()
    words = ["bad", "worse", "pond", "scum", "badly", "fine", "b4d", "scums", "."]
    for _ in range(800):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        got = lexicon.weigh(text, automaton)
        want = naive(lexicon, text)
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9, text


def test_long_text_with_many_spared_phrases_takes_linear_time():
    import time

    lexicon = toxicity.Lexicon()
    automaton = lexicon.automaton()

    def seconds(n):
        begun = time.perf_counter()
        assert lexicon.weigh("pond scum idiot " * n, automaton)[1] == n
        return time.perf_counter() - begun

    seconds(2_000)
    assert seconds(64_000) < 60 * max(seconds(4_000), 0.005)


def test_rows_that_repeat_a_labelled_id_give_one_text(spark):
    docs = spark.createDataFrame([(1, "you idiot")] * 300 + [(2, "fine day")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels, "doc_id", "text", 10, 10).count() == 2
