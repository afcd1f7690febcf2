"""Language models against a plain Kneser-Ney version, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.llm import language_id as L

from .fixtures import AWKWARD, awkward


def brute(texts):
    """p(gram) of every order, and the back-off weight of every context, from plain dictionaries."""
    counts = {L.ORDER: Counter()}
    for t in texts:
        padded = " " * (L.ORDER - 1) + t + " "
        counts[L.ORDER].update(padded[i:i + L.ORDER] for i in range(len(padded) - L.ORDER + 1))
    for n in range(L.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p, gamma = {}, {}
    for n in range(1, L.ORDER + 1):
        n1, n2 = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        total, types = defaultdict(int), defaultdict(int)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        for h in total:
            gamma[h] = d * types[h] / total[h]
        for g, c in counts[n].items():
            lower = p[g[1:]] if n > 1 else 1 / (types[""] + 1)
            p[g] = max(c - d, 0) / total[g[:-1]] + gamma[g[:-1]] * lower
    return p, gamma


def brute_nats(text, p, gamma):
    padded = " " * (L.ORDER - 1) + text + " "
    total = 0.0
    for i in range(len(padded) - L.ORDER + 1):
        g = padded[i:i + L.ORDER]
        while g and g not in p:
            total -= math.log(gamma.get(g[:-1], 1.0)) if len(g) > 1 else math.log(gamma[""] / (len(
                [x for x in p if len(x) == 1]) + 1))
            g = g[1:]
        total -= math.log(p[g]) if g else 0.0
    return total / (len(text) + 1)


def texts(n=60, seed=4):
    rng = random.Random(seed)
    words = {"aa": ["kala", "talo", "ja", "mökki", "yö"], "bb": ["river", "house", "and", "the", "night"]}
    return [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))), lang)
            for k, lang in enumerate(rng.choice(["aa", "bb"]) for _ in range(n))]


COLS = "doc_id long, text string, lang string"


def test_models_equal_plain_kneser_ney(spark):
    rows = texts()
    counts = L.gram_counts(spark.createDataFrame(rows, COLS).repartition(3))
    entries, unseen = L.kneser_ney(counts)
    got = {}
    for r in entries.collect():
        got[(r.lang, r.gram, "p" if r.logp is not None else "g")] = r.logp if r.logp is not None else r.back
    ends = {r.lang: r.unseen for r in unseen.collect()}
    for lang in ("aa", "bb"):
        p, gamma = brute([L.normalised(t) for _, t, g in rows if g == lang])
        want = {(lang, g, "p"): math.log(v) for g, v in p.items()}
        want |= {(lang, g, "g"): math.log(v) for g, v in gamma.items() if g}
        own = {k: v for k, v in got.items() if k[0] == lang}
        assert own.keys() == want.keys()
        assert all(abs(own[k] - want[k]) < 1e-9 for k in want)
        # every context's probabilities add up to one
        assert abs(sum(v for g, v in p.items() if len(g) == 1) + math.exp(ends[lang]) - 1) < 1e-9


def test_entropies_equal_plain_back_off(spark):
    rows = texts()
    df = spark.createDataFrame(rows, COLS)
    entries, unseen = L.kneser_ney(L.gram_counts(df))
    arrays = L.hash_arrays(entries).cache()
    sizes = {r.lang: r["count"] for r in arrays.groupBy("lang").count().collect()}
    models = L.LanguageModels(arrays, {r.lang: r.unseen for r in unseen.collect()}, sizes)
    probe = ["kala yö", "the xylophone", "q", "river ja", "ßœ kala"]
    nats, n = L.entropies(probe, models.load(models.langs))
    assert n.tolist() == [len(t) + 1 for t in probe]
    for j, lang in enumerate(models.langs):
        p, gamma = brute([L.normalised(t) for _, t, g in rows if g == lang])
        for k, t in enumerate(probe):
            assert abs(nats[k, j] - brute_nats(t, p, gamma)) < 1e-4


def test_slices_and_waves_change_nothing(spark, monkeypatch):
    rows = texts(80)
    models = L.learn(spark.createDataFrame(rows, COLS), calibration_rows=20)
    docs = spark.createDataFrame([(k, t * 40) for k, t, _ in rows], "doc_id long, text string")
    one = [tuple(r) for r in L.identify(docs, models).orderBy("doc_id").collect()]
    two = [tuple(r) for r in L.identify(docs, models, wave_bytes=1).orderBy("doc_id").collect()]
    assert one == two and len(models.waves(1)) == 2
    loaded = models.load(models.langs)
    whole, n = L.entropies([t * 40 for _, t, _ in rows], loaded)
    monkeypatch.setattr(L, "SLICE", 50)
    monkeypatch.setattr(L.slices, "__defaults__", (50,))
    cut, m = L.entropies([t * 40 for _, t, _ in rows], loaded)
    assert np.allclose(whole, cut) and (n == m).all()


def test_awkward_rows(spark):
    docs = awkward(spark)
    learned = L.learn(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")))
    out = [r for r in L.identify(docs, learned).collect()]
    assert len(out) == len(AWKWARD)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("x", "y", "und")
    assert {by[i][0].lang_pred for i in (4, 5, 6)} == {"und"}
    assert by[4][0].rejected and by[4][0].score == 0
    assert len(by[8]) == 2
    digits = spark.createDataFrame([(1, "123 ½ -- 456")], "doc_id long, text string")
    assert L.identify(digits, learned).first().lang_pred == "und"


def test_without_languages_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], COLS)
    learned = L.learn(docs)
    r = L.identify(docs, learned).first()
    assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert L.identify(docs.limit(0), learned).collect() == []
    assert L.identify(docs.limit(0), L.learn(spark.createDataFrame(texts(), COLS))).collect() == []


def test_calibration_counts_copies_once_and_rejects_the_unlike(spark):
    rows = texts(200) + [(k, "kala talo ja", "aa") for k in range(1000, 1400)]
    learned = L.learn(spark.createDataFrame(rows, COLS), calibration_rows=60)
    assert learned.limits
    odd = spark.createDataFrame([(1, "zzz qqq xxx www " * 20), (2, "talo ja kala ja talo ja yö")],
                                "doc_id long, text string")
    far = {r.doc_id: r for r in L.identify(odd, learned).collect()}
    assert far[1].rejected and far[2].lang_pred == "aa" and not far[2].rejected
