"""Predictions and K-means passes do their work once."""

import numpy as np
from pyspark.sql import functions as F

from retailspark.functions.special import hyp2f1_many
from retailspark.operators import kmeans_batch


def _series(a, b, c, z, n_terms):
    t = s = 1.0
    for n in range(n_terms - 1):
        t = t * ((a + n) * (b + n) / ((c + n) * (n + 1.0))) * z
        s += t
    return s


def test_series_work_out_a_ratio_once_a_step(spark):
    rows = [(c, z) for c in (0.7, 1.7, 30.5) for z in (0.0, 0.1, 0.55)]
    df = spark.createDataFrame(rows, "c double, z double")
    for n_terms in (2, 3, 40):
        many = hyp2f1_many(0.03, -0.5, F.col("c"), [F.col("z"), F.col("z") / 2], n_terms)
        out = df.select("c", "z", many.alias("f")).select("c", "z", "f.s0", "f.s1")
        for r in out.collect():
            assert r["s0"] == _series(0.03, -0.5, r["c"], r["z"], n_terms)
            assert r["s1"] == _series(0.03, -0.5, r["c"], r["z"] / 2, n_terms)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_divide") <= 2  # ahead of the first step, and in one
    poles = spark.range(1).select(hyp2f1_many(0.5, 0.5, F.lit(-1.0), [F.lit(0.1)], 2)["s0"].alias("near"),
                                  hyp2f1_many(0.5, 0.5, F.lit(-1.0), [F.lit(0.1)], 3)["s0"].alias("at")).first()
    assert poles["near"] is not None and poles["at"] is None


def test_costs_only_where_asked(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 2), (9.0, 3), (11.0, 4)], "x double, _h bigint")
    cen = [np.array([[0.0], [10.0]])]
    a, b = (kmeans_batch._lloyd_pass(df, ["x"], cen, costs=c) for c in (True, False))
    assert a[2].tolist() == [3.0] and b[2].tolist() == [0.0]
    assert a[0][0].tolist() == b[0][0].tolist() and a[1][0].tolist() == b[1][0].tolist()
