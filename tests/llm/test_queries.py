"""The registered queries over whole tables: oracles, brute force and the pipeline."""

import os
import sys
import zlib

import pytest

import __spark_entry__ as E
import corpus_pipeline
from ledgerflow.llm import packing, pii, quality, queries, tokens
from ledgerflow.llm.common import table

from ..conftest import ROOT, SF_SMALL
from .fixtures import near_components
from .test_exact_dedup import norm
from .test_pii import base
from .test_quality import brute as quality_brute

sys.path.insert(0, os.path.join(ROOT, "tools"))
from compare import duck_con, rows_of, type_diffs  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(queries.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_oracle(spark, name):
    for sf in (SF_SMALL, SF):
        duck = duck_con(sf)
        df = E.queries()[name](spark, sf)
        assert type_diffs(df.dtypes, duck, queries.SQL[name]) == []
        assert rows_of(df.toPandas()) == rows_of(duck.execute(queries.SQL[name]).df())


def test_op2_against_all_pairs(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_near_dedup(spark, SF).collect()}
    assert got == near_components(docs)


def test_op3_against_the_patterns(spark, docs):
    by = dict(docs)
    for r in queries.op3_pii(spark, SF).collect():
        want = base(by[r.doc_id])
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.BASE] == [
            f"{k}:{s}:{e}" for k, s, e in want]


def test_op6_and_op7_against_whole_encodings(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    import numpy as np

    want, start = {}, 0
    for i, text in sorted(docs):
        b = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[i] = (start, len(b) // 4, zlib.crc32(b), b)
        start += len(b) // 4
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_store(spark, SF).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    pieces = queries.op6_packing(spark, SF).collect()
    assert sum(r.length for r in pieces) == start
    assert max(r.sequence_id for r in pieces) == (start - 1) // packing.WINDOW
    for r in pieces:
        assert zlib.crc32(want[r.doc_id][3][4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32


def test_op8_base_columns(spark, docs):
    by = dict(docs)
    for r in queries.op8_quality(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == quality_brute(by[r.doc_id])


def test_op1_uses_every_document(spark, docs):
    out = queries.op1_mix_sources(spark, SF).collect()
    assert {r.doc_id for r in out} == {i for i, _ in docs}
    assert len({(r.doc_id, r.mix_epoch) for r in out}) == len(out)


def test_pipeline_stages_against_brute_force(spark):
    frame, want = table(spark, SF, "documents"), None
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in frame.collect()}
        frame = corpus_pipeline.stored(stage(spark, frame, SF), name)
        if name == "packing":
            break
        assert frame.columns == columns
        after = [r.doc_id for r in frame.collect()]
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                k = norm(t)
                best[k] = min(best.get(k, (1, 0)), (-len(t), i))
            want = sorted(i for _, i in best.values())
        elif name == "near_dedup":
            want = sorted({c for _, c in near_components(list(before.items())).values()})
        elif name == "mixing":
            want, after = sorted(before), sorted(set(after))
        else:
            want = sorted(set(before) & set(after))
            assert len(after) > 0.9 * len(before)
        assert sorted(after) == want, name
    assert {r.doc_id for r in frame.collect()} == set(before)


def test_quality_queries_do_not_drop_rows(spark, docs):
    for f in (queries.op4_toxicity, queries.op8_quality, queries.op9_exact_dedup):
        assert f(spark, SF).count() == len(docs)
    assert quality.MIN_WORDS == 20


def test_pipeline_interleaves_sources_and_passes_in_the_sequences(spark):
    # stored by source, and two passes of the small one
    rows = [(i, f"doc{i} " + "word " * 20, "big" if i < 900 else "small") for i in range(1200)]
    docs = corpus_pipeline.stored(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3),
                                  "test-docs")
    mixed = corpus_pipeline.stored(corpus_pipeline.mixing_stage(spark, docs, SF), "test-mixed")
    pieces = corpus_pipeline.packing_stage(spark, mixed, SF).filter("start = 0").collect()
    stream = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    places = {}
    for at, doc in enumerate(stream):
        places.setdefault(doc, []).append(at)
    assert set(places) == set(range(1200))
    twice = [p for p in places.values() if len(p) == 2]
    assert len(twice) > 100
    gaps = [p[1] - p[0] for p in twice]
    assert sum(gaps) / len(gaps) > len(stream) / 4 and sum(g < 25 for g in gaps) < len(gaps) / 10
    share = sum(d >= 900 for d in stream) / len(stream)
    for k in range(10):                     # every tenth of the stream holds the sources by weight
        own = stream[k * len(stream) // 10:(k + 1) * len(stream) // 10]
        assert abs(sum(d >= 900 for d in own) / len(own) - share) < 0.15


def test_op13_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op13_language_id(spark, SF).collect() if r.lang_pred != "und"]
    assert len(lang) - len(rows) < 20 and set(r.lang_pred for r in rows) <= set(lang.values())
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 200 and sum(held) >= 0.98 * len(held)
