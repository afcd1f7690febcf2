"""The written state table: partition-wise rewrite, atomic commits."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import state as M
from ledgerflow.operators.state_table import BUCKET, CommitConflict, StateTable

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, v string, at timestamp_ntz, n long"


def _changes(spark, rows):
    return spark.createDataFrame([(k, v, T0 + dt.timedelta(minutes=m), 0) for k, v, m in rows], SCHEMA)


def _fold(state, changes):
    return M.upsert_latest(state, changes, ["k"], ["at", "v"], keep=("n",))


def _table(spark, tmp_path, buckets=100):
    schema = spark.createDataFrame([], SCHEMA).schema
    return StateTable.create(spark, str(tmp_path / "state"), schema, ["k"], buckets)


def _rows(df):
    return {r.k: (r.v, r.n) for r in df.collect()}


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.merge(_changes(spark, [(f"k{i}", "a", 0) for i in range(3000)]), _fold)
    before = t.commit()["buckets"]
    assert len(before) == 100
    seen = []

    def fold(state, changes):
        seen.append(len(state.inputFiles()))
        return _fold(state, changes)

    assert t.merge(_changes(spark, [("k7", "b", 1)]), fold) == 2
    after = t.commit()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and after.keys() == before.keys()
    assert len(seen) == 1 and seen[0] == 1                       # one bucket's file was read
    assert len([d for d in os.listdir(f"{t.root}/data/{after[next(b for b in before if before[b] != after[b])]}")
                if d.startswith(BUCKET)]) == 1
    got = _rows(t.read())
    assert len(got) == 3000 and got["k7"][0] == "b" and got["k8"][0] == "a"
    assert _rows(t.read(1))["k7"][0] == "a"                      # the commit before
    assert t.lookup(spark.createDataFrame([("k7",), ("none",)], "k string")).collect()[0].v == "b"


def test_a_failed_batch_leaves_the_old_state(spark, tmp_path):
    t = _table(spark, tmp_path, 4)
    t.merge(_changes(spark, [("a", "1", 0), ("b", "1", 0)]), _fold)

    def broken(state, changes):
        bad = F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
        return _fold(state, changes).withColumn("v", bad.cast("string"))

    with pytest.raises(Exception, match="lost"):
        t.merge(_changes(spark, [("a", "2", 1), ("b", "2", 1)]), broken)
    assert t.version() == 1 and _rows(t.read()) == {"a": ("1", 0), "b": ("1", 0)}
    t.merge(_changes(spark, [("a", "2", 1)]), _fold)
    t.vacuum()
    assert _rows(t.read()) == {"a": ("2", 0), "b": ("1", 0)}
    assert set(os.listdir(f"{t.root}/data")) == set(t.commit()["buckets"].values())


def test_a_second_writer_is_refused_and_may_repeat(spark, tmp_path):
    t = _table(spark, tmp_path, 4)

    def slow(state, changes):
        if t.version() == 0:
            t.merge(_changes(spark, [("a", "other", 5)]), _fold)       # published in between
        return _fold(state, changes)

    with pytest.raises(CommitConflict):
        t.merge(_changes(spark, [("a", "mine", 9)]), slow)
    assert _rows(t.read()) == {"a": ("other", 0)}
    t.merge(_changes(spark, [("a", "mine", 9)]), slow)
    assert _rows(t.read()) == {"a": ("mine", 0)}
    with pytest.raises(CommitConflict):
        _table(spark, tmp_path, 4)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    t = _table(spark, tmp_path, 4)
    t.merge(_changes(spark, [("a", "1", 0), ("b", "1", 0)]), _fold, batch=0)
    reads = spark.createDataFrame([("a",)] * 500 + [("zz",), (None,)], "k string")
    for _ in range(2):
        t.merge(reads, lambda s, c: M.touch_count(s, c, "k", "n"), batch=1)
    assert _rows(t.read()) == {"a": ("1", 500), "b": ("1", 0)}


def test_empty_batches_emptied_buckets_and_foreign_rows(spark, tmp_path):
    t = _table(spark, tmp_path, 8)
    assert t.read().count() == 0
    assert t.merge(_changes(spark, []), _fold) == 0
    t.merge(_changes(spark, [("a", "1", 0), ("a", "0", 0), (None, "x", 0)]), _fold)
    assert sorted(r.v for r in t.read().collect()) == ["1", "x"]
    with pytest.raises(ValueError):
        t.merge(_changes(spark, [("a", "2", 1)]), lambda s, c: _fold(s, c).unionByName(
            _changes(spark, [(f"q{i}", "x", 0) for i in range(50)])))
    t.merge(spark.createDataFrame([("a",)], "k string"), lambda s, c: M.delete_keys(s, c, ["k"]))
    assert [r.v for r in t.read().collect()] == ["x"]
    with pytest.raises(ValueError):
        StateTable.create(spark, str(tmp_path / "other"), t.read().schema, ["nokey"])


def test_batches_equal_one_merge(spark, tmp_path):
    rows = [(f"k{i % 17 if i % 3 else 0}", str(i), i) for i in range(300)]       # one hot key
    t = _table(spark, tmp_path, 5)
    for part in range(3):
        t.merge(_changes(spark, rows[part * 100:(part + 1) * 100]), _fold)
    whole = _fold(spark.createDataFrame([], SCHEMA), _changes(spark, rows))
    assert _rows(t.read()) == _rows(whole)
