"""The prefix trie against a brute-force version."""

import hashlib
import random

import pytest

from ledgerflow.llm import prefix_trie as P

COLS = "conv_id long, turn long, role string, text string"


def brute(rows, ids=()):
    """conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends, sorted."""
    by = {i: [] for i in ids if i is not None}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    seqs = {c: tuple((r, x) for *_, r, x in sorted(t)) for c, t in by.items()}
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    below, nodes = {}, {}
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        own, kids = members[p], below.get(p, [])
        nodes[p] = (min(own), len(own), len(kids), sum(nodes[k][3] for k in kids) or 1,
                    sum(nodes[k][4] for k in kids) + (len(own) - 1) * (len(p[-1][1]) if p else 0),
                    hashlib.sha256(",".join(str(c) for c in sorted(own) if seqs[c] == p).encode()).hexdigest())
    return sorted((n[0], len(p), nodes[p[:-1]][0] if p else -1, *n[1:]) for p, n in nodes.items())


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def conversations(n=120, seed=2):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "ccc", "é😀"]
    rows, ids = [], []
    for c in range(-5, n):
        ids.append(c)
        if c % 4 == 0:                                # a quarter are copies of one conversation
            rows += [(c, t, "user", f"hot {t}") for t in range(5)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts[:2 if t < 2 else 5]))
                     for t in range(rng.randrange(4))]
    rows += [(3, None, None, None), (3, None, "user", None), (3, 1, None, "x"), (3, 1, None, "x"), (None, 1, "u", "v")]
    rng.shuffle(rows)
    return rows, ids


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 23, "pending": 1},
                                     {"shards": 40, "pending": 3, "max_skeleton": 9}])
def test_equals_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(P, "ENDS", 4)
    rows, ids = conversations()
    df = spark.createDataFrame(rows, COLS).repartition(4)
    names = spark.createDataFrame([(i,) for i in ids] + [(None,), (7,)], "conv_id long")
    assert got(P.trie(df, names, **options)) == brute(rows, ids)


def test_hot_path_is_split_and_the_skeleton_bounded(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(6)]
    table = P.paths(spark.createDataFrame(rows, COLS))
    split = P.splitters(table, 8)
    assert len(split) == 7 and len({p for p, _ in split}) == 1      # copies of one path lie in eight shards
    sizes = P.sharded(table, split, 8, P.PENDING).filter("kind = 2 and depth = 0").collect()
    assert len(sizes) == 8 and max(r.n_convs for r in sizes) < 70
    other = [(c, t, "user", f"{c} {t}") for c in range(100) for t in range(6)]
    few = P.splitters(P.paths(spark.createDataFrame(other, COLS)), 50, max_skeleton=60)
    assert 0 < sum(len(p) // P.KEY for p, _ in few) <= 60


def test_long_conversation_and_many_children(spark):
    rows = [(0, t, "user", "x" * (t % 3)) for t in range(3000)]
    rows += [(c, t, "user", "x" * (t % 3)) for c in (1, 2) for t in range(0, 2500 + c)]
    rows += [(c, 0, "user", f"first {c}") for c in range(10, 500)]
    out = {(r.conv_id, r.depth): r for r in P.trie(spark.createDataFrame(rows, COLS), pending=50).collect()}
    assert len(out) == 1 + 3000 + 490
    root = out[(0, 0)]
    assert (root.n_convs, root.n_children, root.n_leaves) == (493, 491, 491)
    assert out[(0, 2501)].n_convs == 3 and out[(0, 2502)].n_convs == 2 and out[(0, 2503)].n_convs == 1
    assert root.saved_tokens == 2 * sum(t % 3 for t in range(2501)) + 2501 % 3


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], COLS)
    assert P.trie(empty).collect() == []
    alone = got(P.trie(empty, spark.createDataFrame([(4,), (2,)], "conv_id long")))
    assert alone == [(2, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
    rows, _ = conversations(30)
    df = spark.createDataFrame(rows, COLS)
    extra = df.selectExpr("*", "'a' AS path", "1 AS key", "2 AS sizes", "3 AS shard", "4 AS kind", "5 AS depth")
    assert got(P.trie(extra)) == got(P.trie(df))
