import numpy as np
import pytest

from ledgerflow.llm import near_dedup
from ledgerflow.llm.common import only_kept

from .fixtures import AWKWARD, awkward, near_components, near_rows, shingle_set


@pytest.mark.parametrize("small", [64, 3])
def test_matches_all_pairs(spark, small):
    """small=3 sends nearly every bucket through the cluster search, in many blocks."""
    rows = near_rows(150, seed=small)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(df, small=small, block_shingles=1500).collect()
    want = near_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({v[1] for v in want.values()}) < 130


def test_shingles_are_those_of_the_contract():
    for _, t in AWKWARD:
        assert len(near_dedup.shingles(t)) == len(shingle_set(t))


def test_awkward_rows(spark):
    got = near_dedup.near_dedup(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[(4, 0)].component_id == 4 and by[(5, 0)].kept and by[(6, 0)].kept
    assert by[(8, 1)].component_id == 7 and not by[(8, 1)].kept
    out = only_kept(awkward(spark), near_dedup.near_dedup(awkward(spark)))
    assert out.columns == awkward(spark).columns
    assert [r.doc_id for r in out.filter("text = 'a'").collect()] == [7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_dedup(df).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 5 + [(2, "a b c d e f")], "doc_id long, text string")
    assert near_dedup.near_dedup(df).filter("kept").count() == 5
    assert only_kept(df, near_dedup.near_dedup(df)).count() == 1


def test_registers_estimate_similarity(spark):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = near_dedup.registers(pool[:1800]), near_dedup.registers(pool[200:])
    assert a.dtype == np.uint16
    true = 1600 / 2000
    assert abs((a == b).mean() - true) < 0.2
    bands = [x.view(np.int64).tolist() for x in (a, b)]
    df = spark.createDataFrame([(*bands, 1800, 1800)], "a array<long>, b array<long>, n long, m long")
    est = df.select(near_dedup.estimate(df.a, df.b, df.n, df.m)).first()[0]
    assert est == pytest.approx((a == b).mean(), abs=1e-3)


def test_banding_meets_its_miss_probability():
    t = 0.85
    assert (1 - t ** near_dedup.ROWS) ** near_dedup.BANDS < 1e-6


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_block_links_span_exactly_the_components():
    rows = near_rows(80, seed=9)
    sets = [near_dedup.shingles(t) for _, t in rows]
    links = near_dedup.block_links(sets)
    root = list(range(len(sets)))
    for i, j in links:
        a, b = root[i], root[j]
        assert a != b                      # a forest
        root = [min(a, b) if x in (a, b) else x for x in root]
    want = near_components(list(enumerate(t for _, t in rows)))
    assert {i: r for i, r in enumerate(root)} == {i: want[i][1] for i in range(len(sets))}


def test_copies_of_two_linked_rows_are_confirmed_once(spark, monkeypatch):
    """300 copies of each of two near texts: one set a class, one pair confirmed."""
    words = [f"w{i}" for i in range(120)]
    near = [*words[:-1], "other"]
    rows = [(1, " ".join(words))] * 300 + [(2, " ".join(near))] * 300
    names = {}
    stored = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, **o: names.setdefault(name, stored(df, name, **o)))
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(1, 1), (2, 1)}
    assert names["near-sets"].count() == 2 and names["near-links"].count() == 1


def test_one_of_each_keeps_one_row_of_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:-1], "more"])]
    rows = [(None, texts[0]), (None, texts[1]), (None, "alone here"), (None, None), (None, ""), (5, "x y z"), (5, "p q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (r.text for r in only_kept(df, near_dedup.one_of_each(df)).collect()))) == sorted(
        map(str, [min(texts[:2], key=lambda t: spark.range(1).selectExpr(f"xxhash64('{t}')").first()[0]),
                  "alone here", None, "", "x y z", "p q r"]))
    again = spark.createDataFrame([(7, t) for t in texts] + [(3, texts[0])], "doc_id long, text string")
    assert [r.doc_id for r in only_kept(again, near_dedup.one_of_each(again)).collect()] == [3]
