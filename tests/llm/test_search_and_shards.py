import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from retailspark.llm import sharding, topk
from pyspark.sql import functions as F

from .conftest import corpus


def brute_top(rows, k):
    ok, queries = [], {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            ok.append((i, q))
            if i % 50 == 0:
                queries[i] = min(queries.get(i, q), q)
    out = []
    for q, own in queries.items():
        s = sorted((-sum(a * b for a, b in zip(own, v)), c) for c, v in ok if c != q)[:k]
        out += [(q, r, c, -x) for r, (x, c) in enumerate(s, 1)]
    return sorted(out)


def vectors(n, dim, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((7, dim))
    return [(int(i), [float(x) for x in np.float32(centres[i % 7] + 0.3 * r.standard_normal(dim))]) for i in range(n)]


def run_top(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, shard int")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0, k).collect())


def test_top_k_over_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rows = vectors(600, 16)
    assert run_top(spark, rows) == brute_top(rows, 5)


def test_blocks_prune_but_lose_nothing():
    r = np.random.default_rng(1)
    rows = np.round(r.standard_normal((3000, 24)) * 60) + 40 * (np.arange(3000) % 5 == 0)[:, None]
    q = rows[:40] + 3
    block = topk.Block(np.arange(3000), rows)
    floor = np.sort(rows @ q.T, axis=0)[-5]
    row, of, score = block.search(q, floor)
    want = rows @ q.T
    assert {(int(a), int(b)) for a, b in zip(row, of)} == {(int(a), int(b)) for a, b in np.argwhere(want >= floor)}
    assert (score == want[row, of]).all()


def test_ties_nulls_repeats_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 0.5, -0.25]
    rows = [(0, same), (1, same), (2, same), (50, same), (3, None), (4, [1.0, None, 0.0]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (None, same), (7, [-1.0, -1.0, -1.0]), (8, [0.0, 0.0, 0.0]), (9, []), (1, same), (2, [9.0, 9.0, 9.0]), (10, [1.0])]
    assert run_top(spark, rows) == brute_top(rows, 5)
    assert run_top(spark, [(0, same)]) == []
    assert run_top(spark, [(0, same), (1, same)]) == brute_top([(0, same), (1, same)], 5)
    assert run_top(spark, []) == []


def test_large_values_are_exact_or_refused(spark):
    big = [(i, [float(2**20 + i * 17), -float(2**19 - i)]) for i in range(60)]
    assert run_top(spark, big) == brute_top(big, 5)
    with pytest.raises(Exception, match="64 bits"):
        run_top(spark, [(0, [1e10, 1e10]), (1, [1e10, 1e10])])


def expected_shard(key, node):
    while node.children:
        def draw(c):
            h = xxhash.xxh64_intdigest(c.name.encode(), seed=42)
            if key is not None:
                h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=h)
            return -math.log(((h >> 11) + 0.5) / (1 << 53)) / c.total
        live = [c for c in node.children if c.total > 0]
        node = min(live, key=draw)
    return node.shard


def test_documents_go_where_the_draws_say(spark, docs):
    before, after = sharding.tree(sharding.EIGHT), sharding.tree(sharding.NINE)
    got = sharding.shard_documents(docs, before, after).collect()
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), expected_shard(d, before), expected_shard(d, after)) for d, t in corpus()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got), key=repr) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_rows_no_shards(none):
    assert sharding.shard_documents(none, sharding.tree(sharding.EIGHT), sharding.tree(sharding.NINE)).collect() == []


def test_movement_stays_in_the_subtrees_whose_weights_change(spark):
    ids = spark.range(20_000)
    spec = sharding.EIGHT
    place = lambda t: dict(ids.select("id", sharding.place(F.col("id"), sharding.tree(t)).alias("s")).collect())
    old = place(spec)
    share = [sum(s == k for s in old.values()) / 20_000 for k in range(8)]
    assert max(share) < 0.14 and min(share) > 0.11
    new = place(sharding.NINE)
    assert all(new[i] == s or new[i] == 8 for i, s in old.items())
    assert 0.09 < sum(s == 8 for s in new.values()) / 20_000 < 0.13
    rack = place({"a": spec["a"], "b": {"b0": {4: 1.0, 5: 1.0}, "b1": {6: 1.0, 7: 1.0, 8: 1.0}}})
    for i, s in old.items():  # rows move into region b only, and within it into rack b1 only
        assert rack[i] == s or rack[i] >= 4
        if s in (4, 5):
            assert rack[i] == s or rack[i] in (6, 7, 8)
        if s in (6, 7):
            assert rack[i] == s or rack[i] == 8
    assert 8 not in place({"a": spec["a"], "b": {"b0": {4: 1.0, 5: 1.0}, "b1": {6: 1.0, 8: 0.0}}}).values()
    double = place({"a": spec["a"], "b": {"b0": {4: 2.0, 5: 1.0}, "b1": spec["b"]["b1"]}})
    assert all(double[i] >= 4 for i, s in old.items() if s >= 4)


def test_a_tree_without_weight_is_refused():
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), sharding.tree({"a": {"a0": {0: 0.0}}}))
