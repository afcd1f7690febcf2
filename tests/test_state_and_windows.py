"""State merges, TTL edges and skew-safe windows."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.operators import state as M
from ledgerflow.operators.setops import dedupe_by_key
from ledgerflow.operators.reshape import report_frame, unpivot_numeric
from ledgerflow.operators.windows import page_after, page_index, prefix_sums, running_hit_count, top_n_per_group
from ledgerflow.session import written

NOW = dt.datetime(2024, 1, 31)


def test_ttl_exact_edge(spark):
    rows = [("a", NOW - dt.timedelta(seconds=3600), 3600),
            ("b", NOW - dt.timedelta(seconds=3600, microseconds=1), 3600),
            ("c", NOW - dt.timedelta(seconds=3000), None)]
    cache = spark.createDataFrame(rows, "query_hash string, created_at timestamp_ntz, ttl_seconds long")
    assert sorted(r.query_hash for r in M.ttl_live(cache, NOW).collect()) == ["a", "c"]


def test_upsert_latest_keeps_and_replaces(spark):
    state = spark.createDataFrame([("k1", "old", NOW, 5)], "k string, v string, created_at timestamp_ntz, n long")
    ch = spark.createDataFrame([("k1", "new1", NOW + dt.timedelta(1), 0),
                                ("k1", "new2", NOW + dt.timedelta(2), 0),
                                ("k2", "x", NOW + dt.timedelta(3), 0)],
                               "k string, v string, created_at timestamp_ntz, n long")
    out = {r.k: r for r in M.upsert_latest(state, ch, ["k"], ["created_at"], keep=("created_at", "n"),
                                           first=("created_at",)).collect()}
    assert out["k1"].v == "new2" and out["k1"].created_at == NOW and out["k1"].n == 5
    assert out["k2"].created_at == NOW + dt.timedelta(3) and out["k2"].n == 0


def test_upsert_count_paths(spark):
    w = spark.createDataFrame([("h", NOW, 1), ("h", NOW + dt.timedelta(1), 2), ("g", NOW, 3)],
                              "query_hash string, created_at timestamp_ntz, event_id long")
    first = {r.query_hash: r.hit_count for r in M.upsert_count(None, w, ["query_hash"], ["created_at"], 0).collect()}
    assert first == {"h": 1, "g": 0}
    again = {r.query_hash: r.hit_count for r in M.upsert_count(
        M.upsert_count(None, w, ["query_hash"], ["created_at"], 0),
        w.filter("query_hash = 'g'"), ["query_hash"], ["created_at"], 0).collect()}
    assert again == {"h": 1, "g": 1}


def test_top_n_per_group_matches_row_number(spark):
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = sorted(map(tuple, top_n_per_group(df, "g", [F.col("v").desc()], 4).collect()))
    assert got == sorted([("hot", v) for v in (299, 298, 297, 296)] + [("cold", v) for v in (4, 3, 2, 1)])


def test_dedupe_by_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "b"), ("c", 5, "z")],
                               "k string, p int, v string")
    assert sorted(map(tuple, dedupe_by_key(df, "k", ["p"]).collect())) == [("a", "b"), ("c", "z")]


def test_entity_mentions_first_match_wins(spark):
    qs = [("1", f"spend for nation_{n} item {i}", NOW + dt.timedelta(minutes=i))
          for i, n in enumerate([1, 1, 1, 2, 2, 2, 2])]
    h = spark.createDataFrame(qs, "user_name string, query_text string, asked_at timestamp_ntz")
    ents = spark.createDataFrame([("NATION_2", 1), ("NATION_1", 2)], "entity string, position int")
    r = M.entity_mentions(h, ents, "1").collect()
    assert len(r) == 1 and r[0].memory_val == "NATION_2" and r[0].mentions == 4
    assert abs(r[0].confidence - 0.4) < 1e-12


def test_merge_batches_equals_single_merge(spark):
    from .conftest import SF_SMALL
    from ledgerflow.sources.fixtures import Views
    v = Views(spark, SF_SMALL, materialize=False)
    ch = v.memory_changes
    once = sorted(map(tuple, M.memory_state(ch).collect()))
    days = [dt.datetime(2024, 1, d) for d in (1, 6, 11, 16, 21, 26, 31)]
    batches = [ch.filter((F.col("updated_at") >= F.lit(a)) & (F.col("updated_at") < F.lit(b)))
               for a, b in zip(days[:-1], days[1:])] + [ch.filter(F.col("updated_at") >= F.lit(days[-1]))]
    empty = spark.createDataFrame([], M.memory_state(ch).schema)
    folded = M.merge_batches(empty, batches, lambda s, b: M.memory_state(b, s), every=2)
    assert sorted(map(tuple, folded.collect())) == once


def test_running_hit_count_keeps_every_row_of_a_hot_key(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('k', id % 1000)) AS query_hash",
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, (id * 7919) % 500000) AS created_at", "id",
        "concat('payload ', id) AS payload")
    out = running_hit_count(df, "query_hash", "created_at", "id")
    assert out.columns == [*df.columns, "hit_count"]
    sums = out.groupBy("query_hash").agg(F.count("*").alias("n"), F.min("hit_count").alias("lo"),
                                         F.max("hit_count").alias("hi"), F.count_distinct("hit_count").alias("d"))
    rows = sums.collect()
    assert sum(r.n for r in rows) == n
    assert all((r.lo, r.hi, r.d) == (0, r.n - 1, r.n) for r in rows)


def test_running_hit_count_with_null_keys_and_times(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", NOW, 2), (None, None, 3), (None, NOW, 4), ("a", None, 5)],
                               "query_hash string, created_at timestamp_ntz, id long")
    got = {r.id: r.hit_count for r in running_hit_count(df, "query_hash", "created_at", "id").collect()}
    assert got == {1: 0, 5: 1, 2: 2, 3: 0, 4: 1}


def test_running_hit_count_of_one_instant_is_dealt_evenly(spark, monkeypatch):
    """1M writes of one key in one instant, a third of them equal rows: no part
    above twice the mean, and the numbers are those of a plain sort."""
    from ledgerflow.operators import windows

    seen = []
    monkeypatch.setattr(windows, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    n = 1_000_000
    df = spark.range(n).selectExpr("'hot' AS query_hash", "timestamp_ntz'2024-01-01' AS created_at",
                                   "IF(id % 3 = 0, -1, (id * 7919) % 1000003) AS id")
    out = running_hit_count(df, "query_hash", "created_at", "id").select("id", "hit_count").toPandas()
    sizes = [r["count"] for r in seen[0].groupBy(F.shiftright("_row", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8 and sum(sizes) == n
    out = out.sort_values("hit_count")
    assert (out["hit_count"].to_numpy() == range(n)).all() and out["id"].is_monotonic_increasing


def test_prefix_sums_of_values(spark):
    rows = [(None if k % 5 == 0 else k % 3, k, None if k % 11 == 0 else k * k) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(7)
    got = {r.o: r._before for r in prefix_sums(df, ["k"], [F.col("o").asc()], value=F.col("v"), parts=13).collect()}
    want, sums = {}, {}
    for k, o, v in rows:
        want[o] = sums.get(k, 0)
        sums[k] = want[o] + (v or 0)
    assert got == want
    assert prefix_sums(df.limit(0), ["k"], [F.col("o").asc()]).count() == 0


def test_pages_by_key_equal_pages_by_offset(spark):
    df = spark.range(50).selectExpr("id % 7 AS a", "id AS b")
    rows = [tuple(r) for r in df.orderBy("a", "b").collect()]
    last = {"a": rows[19][0], "b": rows[19][1]}
    assert [tuple(r) for r in page_after(df, 10, ["a", "b"], last).collect()] == rows[20:30]


def test_page_index_equals_offset_and_reads_one_range(spark):
    df = spark.range(10_000).selectExpr("(id * 7919) % 1009 AS a", "id AS b", "IF(id % 50 = 0, null, id % 3) AS c")
    order = [F.col("c").asc_nulls_first(), F.col("a").desc(), F.col("b").asc()]
    index = page_index(df, order, parts=9)
    assert sum(index.counts) == 10_000
    rows = [tuple(r) for r in df.orderBy(*order).collect()]
    for page, size in ((0, 10), (33, 100), (99, 100), (100, 100), (3, 3000), (2, 4000), (10**6, 10)):
        assert [tuple(r) for r in index.page(page, size).collect()] == rows[page * size:(page + 1) * size]
    plan = index.page(33, 100)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_row), GreaterThanOrEqual(_row," in plan
    assert page_index(df.limit(0), order).page(0, 10).count() == 0


def test_display_limits_are_opt_in(spark):
    import pytest

    df = spark.range(700).selectExpr("concat('d', id) AS d", "id AS v")
    assert unpivot_numeric(df).count() == 700
    assert unpivot_numeric(df, max_rows=200).count() == 0
    assert report_frame(df).count() == 700
    assert report_frame(df, max_rows=3, order=["v"]).collect()[0][0] == "d0"
    with pytest.raises(ValueError):
        report_frame(df, max_rows=3)


def test_delete_type_keeps_rows_without_a_type(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "k string, cache_type string")
    assert sorted(r.k for r in M.delete_type(df, "x").collect()) == ["b", "c"]


def test_newest_rows_bound_is_exact(spark):
    from ledgerflow.operators.filters import newest_rows

    df = spark.range(20_000).selectExpr("date_add(date'2020-01-01', cast(id % 400 as int)) AS posting_date",
                                        "id AS invoice_number").unionByName(
        spark.createDataFrame([(None, 1)], "posting_date date, invoice_number long"))
    got = newest_rows(df, 120)
    assert 120 <= got.count() < 400 and got.filter("posting_date is null").isEmpty()
    assert got.agg(F.min("posting_date")).first()[0] > dt.date(2021, 1, 1)
    assert newest_rows(df, 10**6).count() == 20_001
