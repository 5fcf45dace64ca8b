"""Order statistics by counting, against sorted lists and numpy."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retailspark.functions import stats
from retailspark.functions.selection import order_statistics, quantiles
from retailspark.functions.stats import describe, exact_quantiles
from retailspark.operators import eda


def frame(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


def statistics(spark, xs, ranks, **how):
    known = [x for x in xs if x is not None]
    return order_statistics(frame(spark, xs), "x", ranks, min(known), max(known), **how)


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_every_rank(spark, buckets):
    rng = random.Random(3)
    xs = [round(rng.lognormvariate(3, 4), 2) for _ in range(300)] + [12.5] * 150 + [-4.0, 0.0, 0.01, None, None]
    rng.shuffle(xs)
    want = sorted(x for x in xs if x is not None)
    ranks = range(0, len(want), 40)
    assert statistics(spark, xs, ranks, buckets=buckets) == {r: want[r] for r in ranks}


def test_neighbouring_doubles_and_far_ones(spark):
    near = [1.0]
    for _ in range(20):
        near.append(math.nextafter(near[-1], 2.0))
    xs = [-1e300, 5e-324, 0.0, *near, 1e300]
    want = sorted(xs)
    got = statistics(spark, xs, range(len(xs)))
    assert got == dict(enumerate(want))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=40), st.lists(st.floats(0, 1), min_size=1, max_size=3))
def test_quantiles_are_numpys(spark, xs, probs):
    got = quantiles(frame(spark, xs), "x", probs, len(xs), min(xs), max(xs))
    assert np.allclose(got, np.quantile(xs, probs), rtol=1e-12, atol=1e-3)


def test_one_value_needs_no_pass(spark):
    assert statistics(spark, [7.0] * 5, [0, 4]) == {0: 7.0, 4: 7.0}
    assert order_statistics(frame(spark, []), "x", [], 0.0, 0.0) == {}


def test_what_has_no_answer_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows at ranks"):
        statistics(spark, [1.0, 2.0], [2])
    with pytest.raises(ValueError, match="finite"):
        statistics(spark, [1.0, math.inf], [0])


def test_quantiles_leave_nulls_out_and_are_null_without_values(spark):
    assert exact_quantiles(frame(spark, [3.0, None, 1.0]), "x", [0.5, 1.0]).first().asDict() == {"q0": 2.0, "q1": 3.0}
    assert exact_quantiles(frame(spark, [None]), "x", [0.5]).first()["q0"] is None


def test_describe(spark):
    xs = [10.0, 20.0, 30.0, 40.0]
    got = {r["stat"]: r["v"] for r in describe(frame(spark, xs), "x", "v").collect()}
    assert got == pytest.approx({"count": 4.0, "mean": 25.0, "std": round(float(np.std(xs, ddof=1)), 6), "min": 10.0,
                   "25%": 17.5, "50%": 25.0, "75%": 32.5, "90%": 37.0, "99%": 39.7, "max": 40.0})
    none = {r["stat"]: r["v"] for r in describe(frame(spark, []), "x", "v").collect()}
    assert none["count"] == 0.0 and none["50%"] is None and none["max"] is None


def test_order_values_are_not_ranked(spark, monkeypatch):
    def ranked(*_):
        raise AssertionError("a global rank")

    monkeypatch.setattr(stats, "with_global_rank", ranked)
    tx = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("b", 9.0)], "InvoiceNo string, TotalPrice double")
    assert {r["stat"]: r["order_value"] for r in eda.order_value_stats(tx).collect()}["50%"] == 6.25
