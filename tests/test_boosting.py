"""Leaf-wise boosted trees: a hand-checked tree, growth against brute force, and quality."""
import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.operators import boosting

def frame(spark, x, y, parts=3):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(str(i), *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} double" for c in cols) + ", y int").repartition(parts), cols


def test_first_tree_by_hand(spark):
    """Eight rows, base log-odds 0: gradients are +-1/2, Hessians 1/4.  The first
    feature at 2 leaves two rows of label 0 on the left (gradient 1, Hessian
    1/2) and gradient -1, Hessian 3/2 on the right: gain 2 + 2/3 - 0."""
    x = np.array([[1, 0], [2, 0], [3, 0], [3, 1], [5, 0], [6, 0], [7, 0], [8, 1]], float)
    y = np.array([0, 0, 0, 1, 1, 1, 1, 0])
    df, cols = frame(spark, x, y)
    model = boosting.fit(df, cols, "y", "id", n_estimators=1, learning_rate=0.1, num_leaves=2, subsample=1.0, colsample=1.0, min_rows=1)
    tree = model.trees[0]
    assert model.base == 0 and tree.feature == [0, -1, -1] and tree.at[0] == 2.0
    assert tree.gain[0] == pytest.approx(8 / 3) and tree.rows == [8, 2, 6]
    assert tree.value[1:] == pytest.approx([-0.2, 0.2 / 3])
    score = {r.id: r.score for r in boosting.scored(model, df, cols).collect()}
    assert score["0"] == pytest.approx(1 / (1 + math.exp(0.2))) and score["7"] == pytest.approx(1 / (1 + math.exp(-0.2 / 3)))


def best_first(x, y, leaves, min_rows, rate=0.1):
    """A tree by trying every split of every leaf, one split at a time."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def split(rows):
        best = (0.0, -1, 0.0)
        for j in range(x.shape[1]):
            for at in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= at]
                right = rows[x[rows, j] > at]
                if min(len(left), len(right)) >= min_rows:
                    gain = sum(g[r].sum() ** 2 / h[r].sum() for r in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, j, at)
        return best

    heap, n = [(-split(np.arange(len(y)))[0], 0, np.arange(len(y)))], 1
    done = []
    while heap and n < leaves:
        gain, _, rows = heapq.heappop(heap)
        if gain >= -1e-9:
            done.append(rows)
            break
        _, j, at = split(rows)
        for part in (rows[x[rows, j] <= at], rows[x[rows, j] > at]):
            heapq.heappush(heap, (-split(part)[0], int(part[0]), part))
        n += 1
    out = np.zeros(len(y))
    for rows in [r for _, _, r in heap] + done:
        out[rows] = -rate * g[rows].sum() / h[rows].sum()
    return out


@pytest.mark.parametrize("max_rows", [1000, None])
def test_growth_is_best_first_whatever_the_blocks(spark, monkeypatch, max_rows):
    monkeypatch.setattr(boosting, "BLOCK", 60)
    monkeypatch.setattr(boosting, "PARTS", 2)
    r = np.random.default_rng(1)
    x = np.round(r.random((400, 3)) * 40)
    y = ((x[:, 0] > 11) & (x[:, 1] < 30) | (x[:, 2] > 33) ^ (r.random(400) < 0.1)).astype(int)
    df, cols = frame(spark, x, y, 5)
    model = boosting.fit(df, cols, "y", "id", n_estimators=1, learning_rate=0.1, num_leaves=12, subsample=1.0, colsample=1.0, min_rows=7, max_rows=max_rows)
    assert sum(f < 0 for f in model.trees[0].feature) == 12
    assert model.margin(x) - model.base == pytest.approx(best_first(x, y, 12, 7))


def test_boosting_learns_alike_from_one_task_and_from_passes(spark):
    r = np.random.default_rng(2)
    x = np.round(r.random((1500, 4)), 2)
    y = (r.random(1500) < 1 / (1 + np.exp(-8 * (x[:, 0] * x[:, 1] - 0.25) - 3 * (x[:, 2] > 0.7)))).astype(int)
    df, cols = frame(spark, x, y, 2)
    train = df.filter("cast(id as int) < 1000")
    some = dict(n_estimators=4, learning_rate=0.3, num_leaves=8, renew=2)
    fits = [boosting.fit(train.repartition(n), cols, "y", "id", max_rows=m, **some) for n, m in ((3, 1000), (7, 1000), (2, None))]
    for other in fits[1:]:
        assert np.allclose(fits[0].margin(x), other.margin(x))
    full = boosting.fit(train, cols, "y", "id", n_estimators=60)
    assert all(sum(f < 0 for f in t.feature) <= 31 for t in full.trees) and len(full.trees) == 60
    s, t = full.margin(x[1000:]), y[1000:]
    assert (s[t == 1][:, None] > s[t == 0][None]).mean() > 0.75
    assert full.importance()[3] < min(full.importance()[:2]) and full.importance().sum() == pytest.approx(1)
    part = boosting.fit(train, cols, "y", "id", n_estimators=2, max_rows=400)
    assert 200 < part.trees[0].rows[0] < 420


def test_edge_cases(spark):
    x = np.array([[1.0, float("nan")], [2.0, 1.0], [3.0, 2.0]])
    df, cols = frame(spark, x, np.array([1, 1, 1]))
    one = boosting.fit(df, cols, "y", "id", n_estimators=3)
    assert one.trees == [] and all(r.score > 0.999 for r in boosting.scored(one, df, cols).collect())
    none = boosting.fit(df.filter("false"), cols, "y", "id")
    assert none.trees == [] and none.base == 0
    mixed, _ = frame(spark, np.repeat(x, 20, 0), np.array([1, 0, 1] * 20))
    fitted = boosting.fit(mixed, cols, "y", "id", n_estimators=3, min_rows=5)
    assert len(boosting.scored(fitted, mixed.withColumn("f1", F.lit(None).cast("double")), cols).collect()) == 60
