import zlib

import numpy as np
import pytest

from ledgerflow.llm import token_store
from ledgerflow.llm.tokens import Encoder, default_tokenizer

from .fixtures import AWKWARD, awkward


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4").tobytes()
    parts = token_store.shuffled(ids, planes)
    assert len(parts) == (4 if planes == "byte" else 32)
    assert token_store.unshuffled(b"".join(parts), [len(p) for p in parts], n, planes) == ids


@pytest.mark.parametrize("planes,chunk_ids,shards", [("byte", 1 << 16, 3), ("bit", 50, 4), ("byte", 1, 1)])
def test_store_round_trip(spark, tmp_path, planes, chunk_ids, shards):
    docs = awkward(spark)
    if chunk_ids == 1:
        docs = docs.filter("length(text) < 100 or text is null")
    path = str(tmp_path / "store")
    token_store.write(docs, path, chunk_ids=chunk_ids, planes=planes, shards=shards)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (i, _), b in zip(rows, Encoder(default_tokenizer()).encode([t for _, t in rows])):
        b += b"\0\0\0\0"
        want.append((i, start, len(b) // 4, b, zlib.crc32(b)))
        start += len(b) // 4
    got = token_store.read(spark, path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
    assert sorted([(r[0], r[1], r[2], bytes(r[3]), r[4]) for r in got.collect()], key=lambda r: r[1]) == want
    assert token_store.chunks(spark, path).filter(f"n_ids > {chunk_ids}").count() == 0


def test_a_damaged_chunk_is_noticed(spark, tmp_path):
    token_store.write(awkward(spark), str(tmp_path / "a"), shards=1)
    chunk = token_store.chunks(spark, str(tmp_path / "a")).first()
    ids = token_store.unshuffled(chunk.payload, chunk.lengths, chunk.n_ids, chunk.planes)
    assert zlib.crc32(ids) == chunk.crc32
    assert zlib.crc32(ids[:-1] + b"\1") != chunk.crc32


def test_empty_table(spark, tmp_path):
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"))
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


def test_a_hot_id_and_copies_are_spread(spark, tmp_path):
    rows = [(None, f"text number {k}") for k in range(300)] + [(7, "the same text")] * 300
    rows += [(k, "other") for k in range(100, 200)]
    path = str(tmp_path / "hot")
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, shards=7)
    held = {r.shard: r.n for r in token_store.chunks(spark, path).selectExpr("shard", "size(docs) n")
            .groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert len(held) == 7 and max(held.values()) < 250
    got = token_store.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]


def test_rows_of_the_fixture_are_awkward():
    assert any(t is None for _, t in AWKWARD)
