import hashlib
import re

from ledgerflow.llm import exact_dedup
from ledgerflow.llm.common import only_kept

from .fixtures import AWKWARD, awkward


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}


def test_matches_brute_force_on_awkward_rows(spark):
    want = brute(AWKWARD)
    got = exact_dedup.exact_dedup(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    key = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == key[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)


def test_a_crowded_filter_changes_nothing(spark):
    rows = [(i, f"text {i % 700}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [sorted(map(tuple, exact_dedup.exact_dedup(df, bits=b).collect())) for b in (1 << 15, 1 << 22)]
    assert out[0] == out[1]
    assert sum(r[3] for r in out[0]) == 700


def test_a_filter_beyond_the_broadcast_bound_changes_nothing(spark):
    rows = [(i, f"text {i % 1400}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (exact_dedup.exact_dedup(df, max_broadcast=b) for b in (1 << 27, 1))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_few_unique_rows_pass_a_filter_sized_by_the_rows(spark):
    prints = exact_dedup.fingerprints(spark.range(100_000).selectExpr("id AS doc_id", "concat('t', id) AS text"))
    bits = 1 << (32 * 100_000 - 1).bit_length()
    marked = exact_dedup.maybe_repeated(prints, exact_dedup.repeated_filter(prints, bits), bits)
    assert marked.filter("maybe").count() < 500


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).count() == 0
    assert only_kept(df, exact_dedup.exact_dedup(df)).count() == 0


def test_only_kept_leaves_one_row_a_text_and_all_columns(spark):
    docs = awkward(spark)
    out = only_kept(docs, exact_dedup.exact_dedup(docs))
    assert out.columns == docs.columns
    texts = [norm(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in AWKWARD})
    # the same without a broadcast list
    again = only_kept(docs, exact_dedup.exact_dedup(docs), max_listed=0)
    assert sorted(norm(r.text) for r in again.collect()) == sorted(texts)


def test_native_plan(spark):
    plan = exact_dedup.exact_dedup(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan
