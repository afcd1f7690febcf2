"""Hard negatives against a brute-force version, with the awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import hard_negatives as H

COLS = "vec_id long, embedding array<float>, label int"
MOST, LEAST = 2**63 - 1, -2**63


def brute(rows, anchor, positives=5, negatives=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), sorted."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is None or not anchor(i):
            continue
        ranked = []
        for b, (j, w, other) in enumerate(own):
            score = max(LEAST, min(MOST, sum(x * y for x, y in zip(v, w))))
            if b != a:
                ranked.append((-score, j is None, j or 0, other == label))
        ranked.sort()
        for neg, null, j, same in [r for r in ranked if r[3]][:positives]:
            found = [r for r in ranked if not r[3] and -80 * neg <= -100 * r[0] <= -100 * neg][:negatives]
            for k, r in enumerate(found, 1):
                out.append((i, None if null else j, k, None if r[1] else r[2], -neg, -r[0]))
    return sorted(out, key=str)


def got(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def rows(n=300, seed=1):
    rng = random.Random(seed)
    base = [[rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)] for _ in range(12)]
    out = [(k, [x + rng.choice([0.0, 0.0, 0.01]) for x in rng.choice(base)], rng.randrange(4)) for k in range(n)]
    for k in range(0, n, 17):
        out.append(out[k])                                 # repeated rows
    out += [(5, [0.5, 0.5, 0.5, 0.5], 2), (None, [1.0, 1.0, 0.5, 0.25], 1), (None, [1.0, 1.0, 0.5, 0.25], 2),
            (None, None, None), (1000, None, 1), (1001, [0.5] * 4, None), (1010, [0.5, None, 0.5, 0.5], 1),
            (1020, [float("nan")] * 4, 1), (1030, [float("inf")] * 4, 1), (1040, [], 1), (1050, [1.0], 2),
            (1060, [0.5] * 9, 3)]
    return out


@pytest.mark.parametrize("options", [{}, {"max_wave": 3, "block_rows": 7}, {"positives": 2, "negatives": 9}])
def test_equals_brute_force(spark, options):
    data = rows()
    df = spark.createDataFrame(data, COLS).repartition(5)
    found = H.mine(df, F.col("vec_id") % 10 == 0, **options)
    want = brute(data, lambda i: i % 10 == 0, options.get("positives", 5), options.get("negatives", 5))
    assert got(found) == want and len(want) > 200


def test_beaten_pairs_are_dropped_before_the_shuffle(spark, monkeypatch):
    """Thousands of copies of one vector: a task passes on a few rows an anchor."""
    monkeypatch.setattr(H, "PENDING", 100)
    data = [(k, [1.0, 0.5], 0 if k < 1500 else 1) for k in range(3000)]
    df = spark.createDataFrame(data, COLS).coalesce(2)
    found = H.mine(df, F.col("vec_id").isin(0, 2000), block_rows=50)
    assert got(found) == brute(data, lambda i: i in (0, 2000))
    table = H.blocks(df.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
                               (F.col("vec_id") == 0).alias("chosen"),
                               F.col("embedding").cast("array<double>").alias("vector")), 256, 50)
    wave = H.load_wave(H.anchor_rows(table).collect(), {}, 80, 100, 1)
    assert H.scored(table, wave, True, 5).count() <= 10


def test_large_components_stay_exact(spark):
    data = [(0, [3e15, 1.0], 1), (1, [3e15, 2.0], 1), (2, [3e15, 1.0], 2), (3, [3e15, -1.0], 2),
            (10, [1e30, 0.0], 1), (11, [1e30, 0.0], 2), (12, [-1e30, 5.0], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert got(H.mine(df, F.col("vec_id") % 10 == 0)) == brute(data, lambda i: i % 10 == 0)


def test_products_switch_types_without_change():
    rng = np.random.default_rng(0)
    for top in (10, 10**4, 10**8):
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (6, 8))
        assert (H.products(a.astype(float), b.astype(float)) == a @ b.T).all()


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], COLS)
    assert H.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    df = spark.createDataFrame(rows(60), COLS)
    none = H.mine(df, F.col("vec_id") < 0)
    assert none.collect() == [] and none.columns[:2] == ["anchor_id", "positive_id"]
    extra = df.withColumn("anchor", F.lit("x")).withColumn("score", F.lit("y")).withColumn("id", F.lit("z"))
    pick = F.col("vec_id") % 10 == 0
    assert got(H.mine(extra, pick)) == got(H.mine(df, pick))
