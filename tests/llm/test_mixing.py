import math
from collections import Counter, defaultdict

import pytest

from ledgerflow.llm import mixing

from .fixtures import WORD, awkward


def corpus(spark, sizes, each=7):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"{source} " + "w " * (each + i % 5), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def totals(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len(WORD.findall(r.text))
    return out


def entropy(tokens, a):
    s = sum(tokens.values())
    p = [(t / s) ** a for t in tokens.values()]
    return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)


def test_exponent_meets_the_entropy(spark):
    docs = corpus(spark, {"a": 900, "b": 90, "c": 9})
    tot = mixing.source_totals(docs, "source", mixing.tokens_of(docs.text))
    target = 0.8
    a = mixing.find_exponent(tot, entropy=target)
    assert entropy(totals(docs.collect()), a) == pytest.approx(target, abs=1e-5)
    assert mixing.find_exponent(tot, entropy=5.0) == 0.0
    assert mixing.find_exponent(tot, entropy=0.01) == 1.0
    with pytest.raises(ValueError):
        mixing.find_exponent(tot)


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0])
def test_repetition_limit_and_no_row_dropped(spark, limit):
    docs = corpus(spark, {"a": 600, "b": 60, "c": 15})
    out = mixing.mix(docs, repetition=limit).collect()
    uses = Counter(r.doc_id for r in out)
    assert set(uses) == {r.doc_id for r in docs.collect()}
    natural, mixed = totals(docs.collect()), totals(out)
    for s, n in natural.items():
        assert n <= mixed[s] <= n * limit + 12 + 1
    for (_, _), n in Counter((r.doc_id, r.mix_epoch) for r in out).items():
        assert n == 1
    assert mixed["c"] / natural["c"] == pytest.approx(limit, abs=0.15)


def test_budget_is_met_by_source(spark):
    docs = corpus(spark, {"a": 500, "b": 200, "c": 40})
    budget = 6000
    out = mixing.mix(docs, budget=budget, entropy=1.0).collect()
    weights = {r.source: r.mix_weight for r in out}
    assert sum(weights.values()) == pytest.approx(1)
    mixed = totals(out)
    for s, w in weights.items():
        assert budget * w - 1 <= mixed[s] <= budget * w + 13       # cut at a row


def test_last_pass_takes_a_prefix_of_the_block_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    docs = corpus(spark, {"a": 300, "b": 100})
    out = mixing.mix(docs, budget=2000, entropy=math.log(2)).collect()
    last, seen = defaultdict(set), defaultdict(set)
    for r in out:
        seen[r.source, r.mix_epoch].add(r.mix_block)
    for (source, epoch), blocks in seen.items():
        if (source, epoch + 1) not in seen:
            last[source] = blocks
    for blocks in last.values():
        assert max(blocks) - len(blocks) <= 2                     # a block may hold no row
    assert all(0 <= r.mix_position < 1.0001 for r in out)


def test_same_result_without_broadcast(spark):
    docs = corpus(spark, {"a": 100, "b": 10, "c": 1})
    one = mixing.mix(docs, repetition=3.0).collect()
    two = mixing.mix(docs, repetition=3.0, max_sources=0).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    out = mixing.mix(docs, repetition=2.0)
    assert out.columns == docs.columns + ["mix_epoch", "mix_block", "mix_position", "mix_weight"]
    first = [tuple(r)[:len(docs.columns)] for r in out.filter("mix_epoch = 0").collect()]
    assert sorted(first, key=repr) == sorted(map(tuple, docs.collect()), key=repr)      # all columns as they were
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(texts) == {(r.doc_id, r.text) for r in docs.collect()}
    empty = spark.createDataFrame([], docs.schema)
    assert mixing.mix(empty, repetition=2.0).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(blank, repetition=2.0).count() == 2
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan


def test_mix_order_permutes_the_rows_of_a_block(spark):
    """Inside one block every row has its own place, and no pass repeats another's order."""
    df = spark.range(200).selectExpr("id AS doc_id", "'s' AS source", "concat('word ', id) AS text")
    rows = mixing.mix(df, repetition=2.0, order=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.mix_epoch, []).append((r.mix_order, r.doc_id))
    assert all(len({o for o, _ in own}) == len(own) for own in by.values())
    orders = [[d for _, d in sorted(own)] for own in by.values()]
    assert all(o != sorted(o) for o in orders) and len({tuple(o) for o in orders}) == len(orders)
    assert all(0 <= o <= 1 for own in by.values() for o, _ in own)
