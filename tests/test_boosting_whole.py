"""Boosted trees learn from all rows, in one task or by passes, cut at quantiles of all rows."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.operators import boosting
from retailspark.operators import propensity as pr
from test_boosting import best_first, frame


@pytest.mark.parametrize("blocks", [20, 4])
def test_a_large_table_is_learned_whole(spark, monkeypatch, blocks):
    """210,000 rows, in one task and by passes: the root holds every one, and
    the cuts are quantiles of all."""
    monkeypatch.setattr(boosting, "TASK_BLOCKS", blocks)
    n = 210_000
    df = spark.range(n, numPartitions=3).select(
        F.col("id").cast("string").alias("CustomerID"),
        *[(F.col("id") % (k + 2)).cast("double").alias(c) for k, c in enumerate(pr.FEATURE_COLUMNS[1:])],
        F.col("id").cast("double").alias(pr.FEATURE_COLUMNS[0]),
        (F.col("id") >= n // 2).cast("int").alias("label"))
    model = pr.fit_gbt(df, n_estimators=1, num_leaves=2, subsample=1.0, colsample=1.0)["model"]
    tree = model.trees[0]
    assert tree.rows[0] == n and tree.rows[1] + tree.rows[2] == n
    edges = model.edges[0]
    assert edges.tolist() == [(k * n) // 255 for k in range(1, 255)]
    assert tree.at[0] == min(edges, key=lambda e: abs(e - n / 2 + 1))
    assert model.base == 0


ODD = [0.0, -0.0, 1.5, 1.5, math.inf, -math.inf, 5e-324, -5e-324, 1e300, -1e300]


@pytest.mark.parametrize("slices", [64, 8192])
def test_quantiles_of_all_rows_are_those_of_one_task(spark, monkeypatch, slices):
    monkeypatch.setattr(boosting, "SLICES", slices)
    r = np.random.default_rng(4)
    n = 3000
    x = np.stack([r.lognormal(3, 2, n).round(2), r.normal(0, 1e-9, n), r.integers(0, 7, n), r.choice(ODD + r.normal(0, 5, 40).tolist(), n),
                  np.full(n, np.nan), np.full(n, 3.0), np.where(r.random(n) < 0.6, 1.0, r.random(n)), np.where(r.random(n) < 0.3, np.nan, r.random(n)),
                  (r.random(n) * 2**62).astype(np.int64).astype(float), np.where(np.arange(n) % 2, 1.0, np.nextafter(1.0, 2.0))])
    schema = "id string, " + ", ".join(f"f{i} double" for i in range(len(x))) + ", y int"
    df = spark.createDataFrame([(str(i), *map(float, v), 0) for i, v in enumerate(x.T)], schema).repartition(5)
    narrow = boosting._narrow(df, [f"f{i}" for i in range(len(x))], "y", "id")
    for bins in (2, 16, 255):
        want, got = boosting._edges(x, bins), boosting._all_edges(narrow, len(x), bins)
        assert [e.tolist() for e in got] == [(e + 0.0).tolist() for e in want]


def test_passes_grow_best_first(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 20)
    monkeypatch.setattr(boosting, "TASK_BLOCKS", 2)
    r = np.random.default_rng(1)
    x = np.round(r.random((400, 3)) * 40)
    y = ((x[:, 0] > 11) & (x[:, 1] < 30) | (x[:, 2] > 33) ^ (r.random(400) < 0.1)).astype(int)
    df, cols = frame(spark, x, y, 5)
    for rows in (df, df.repartition(2), df.repartition(9)):
        model = boosting.fit(rows, cols, "y", "id", n_estimators=1, learning_rate=0.1, num_leaves=12, subsample=1.0, colsample=1.0, min_rows=7)
        assert model.margin(x) - model.base == pytest.approx(best_first(x, y, 12, 7))


@pytest.mark.parametrize("parts", [2, 32])
def test_passes_learn_what_one_task_learns(spark, monkeypatch, parts):
    r = np.random.default_rng(5)
    x = np.round(r.random((1200, 4)), 3)
    x[r.random(1200) < 0.1, 3] = np.nan
    y = (r.random(1200) < 1 / (1 + np.exp(-8 * (x[:, 0] * x[:, 1] - 0.25)))).astype(int)
    cols = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame([(str(i), *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id string, " + ", ".join(f"{c} double" for c in cols) + ", y int")
    some = dict(n_estimators=5, learning_rate=0.3, num_leaves=8, renew=2)
    one = boosting.fit(df, cols, "y", "id", **some)
    assert one.trees[0].rows[0] > 900  # 80 % of all
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "PARTS", parts)
    monkeypatch.setattr(boosting, "TASK_BLOCKS", 4)
    monkeypatch.setattr(boosting, "_in_one_task", None)  # 1,200 rows are too many for it
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    by_passes = boosting.fit(df.repartition(7), cols, "y", "id", **some)
    assert [t.feature for t in by_passes.trees] == [t.feature for t in one.trees]
    assert np.allclose(by_passes.margin(x), one.margin(x))
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
