import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retailspark.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, node long, score string, rid int, h long, part int"


def brute(rows, positives=5, negatives=3):
    ok = []
    for rid, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((rid, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for rid, i, label, q in ok:
        if i % 50:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, v)), c, r, k) for r, c, k, v in ok if r != rid)
        for p, pos, _, _ in [x for x in s if x[3] == label][:positives]:
            fits = [(-n, c) for n, c, _, k in s if k != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, pos, r, c, -p, n) for r, (n, c) in enumerate(fits[:negatives], 1)]
    return Counter(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, k, 1, "x", 2, 3, 4) for i, v, k in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in hardneg.hard_negatives(df, F.col("id") % 50 == 0, label).collect())


def vectors(n, dim, spread=0.3, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((4, dim)) * 0.4
    return [(int(i), [float(x) for x in np.float32(centres[i % 4] + spread * r.standard_normal(dim))], int(r.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("bits, dims", [(1, 1), (3, 2), (2, 3), (2, 4), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(bits, dims):
    cells = np.array(list(itertools.product(range(2**bits), repeat=dims)))
    key = hardneg.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_are_met():
    r = np.random.default_rng(2)
    block, q = r.integers(-90, 90, (50, 6)), r.integers(-90, 90, (20, 6))
    flat = lambda x: x.astype("<i8").tobytes()
    ends = flat(np.zeros(20))
    group = hardneg.Group({"n": 20, "rids": ends, "ids": ends, "labels": ends, "mat": flat(q), "top": ends, "floor": ends, "floor_id": ends}, 6, np.float64)
    low, high = group.bounds(block.min(0)[None], block.max(0)[None])
    score = q @ block.T
    assert (low[:, 0] <= score.min(1)).all() and (score.max(1) <= high[:, 0]).all()
    low, high = group.bounds(block[:1], block[:1])
    assert (low[:, 0] == score[:, 0]).all() and (high == low).all()


def test_mining_over_several_levels_of_zone_maps(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 5), ("GROUP_ROWS", 4), ("FANOUT", 6), ("TASK_ZONES", 20), ("TASK_BLOCKS", 16), ("BEAM", 2)):
        monkeypatch.setattr(hardneg, name, value)
    rows = vectors(900, 12)
    assert run(spark, rows) == brute(rows)


def test_bounds_leave_blocks_unread(spark, monkeypatch):
    """Vectors in tight clumps: most blocks are ruled out by their zone maps."""
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 16)
    read = []
    follow = hardneg.Tree.follow

    def counted(self, groups, same, beam):
        pairs = follow(self, groups, same, beam)
        if beam is None:
            read.append(pairs.count() / (groups.count() * self.blocks.count()))
        return pairs

    monkeypatch.setattr(hardneg.Tree, "follow", counted)
    monkeypatch.setattr(hardneg, "GROUP_ROWS", 2)
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 6))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 40] + 0.01 * r.standard_normal(6))], int(i % 3)) for i in range(1600)]
    assert run(spark, rows) == brute(rows)
    assert read[0] < 0.2


def test_ties_nulls_repeats_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 0.5, -0.25]
    less = [0.8, 0.4, -0.2]
    rows = [(0, same, 0), (50, same, 1), (1, same, 1), (2, same, 1), (2, same, 1), (3, less, 2), (4, less, 2), (4, less, 2), (5, less, 3), (6, None, 1), (8, [1.0, None, 0.0], 1), (9, [nan, 0.0, 0.0], 1), (10, [inf, 0.0, 0.0], 1), (None, same, 1), (11, less, None), (12, [-1.0, -1.0, -1.0], 1), (13, [], 4), (15, [0.9], 4), (50, [0.5, 0.5, 0.5], 2), (50, same, 1), (100, [0.0, 0.0, 0.0], 2)]
    want = brute(rows)
    assert want and run(spark, rows) == want
    assert run(spark, []) == Counter()
    none = [(0, [], 1), (1, [], 1), (2, [], 2), (50, [], 1)]
    assert run(spark, none) == brute(none)


def test_one_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 20)
    rows = vectors(600, 8, seed=9)
    rows = [(i, rows[3][1] if i % 3 == 0 else v, k % 4) for i, v, k in rows]
    assert run(spark, rows) == brute(rows)


def test_large_values_are_exact_or_refused(spark):
    big = [(i, [float(2**18 + i * 17), -float(2**17 - i)], i % 3) for i in range(120)]
    assert run(spark, big) == brute(big)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [float(2**40)], 1), (1, [float(2**40)], 1)])


def test_packing_keeps_every_row():
    table = pa.table({"part": pa.array([3] * 23, pa.int32()), "rid": range(23), "id": range(100, 123), "label": [1, 2] * 11 + [3], "v": [[i, -i] for i in range(23)]})
    got = list(hardneg._packed(None, 2, 5)(table.to_batches(max_chunksize=7)))
    assert [b.column("place")[0].as_py() for b in got] == [0, 1, 2, 3, 4] and [b.column("n")[0].as_py() for b in got] == [5, 5, 5, 5, 3]
    assert np.concatenate([np.frombuffer(b.column("ids")[0].as_py(), "<i8") for b in got]).tolist() == list(range(100, 123))
    assert np.frombuffer(got[1].column("high")[0].as_py(), "<i8").tolist() == [9, -5] and got[4].column("kinds")[0].as_py() == [1, 2, 3]
