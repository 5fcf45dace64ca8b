"""The cleaning groups rows where the lines met their orders."""

import datetime as dt

from pyspark.sql import functions as F

from retailspark.operators import clean, propensity, rfm
from retailspark.plans import pipeline
from retailspark.sources import testdata


def _tables(spark, folder, orders=40):
    """Small tables with equal lines, null keys, a repeated part and orders of unknown buyers."""
    day = dt.date(2020, 1, 1)
    rows = {
        "nation": ([(0, "A"), (1, "B")], "n_nationkey int, n_name string"),
        "customer": ([(i, i % 3) for i in range(1, 9)] + [(None, 1)], "c_custkey bigint, c_nationkey int"),
        "part": ([(i, f"part {i}", i + 0.5) for i in range(1, 90)] + [(7, "part 7", 7.5), (None, "x", 1.0)],
                 "p_partkey bigint, p_name string, p_retailprice double"),
        "orders": ([(i, i % 11 if i % 6 else None, day + dt.timedelta(days=i)) for i in range(1, orders + 1)] + [(None, 1, day), (3, 4, day)],
                   "o_orderkey bigint, o_custkey bigint, o_orderdate date"),
        "lineitem": ([(i, (i * k) % 95 + 1, k, float(k), "R" if i % 4 == 0 else "N")
                      for i in range(1, orders + 1) for k in (1, 1, 2, 7)] + [(None, 1, 1, 1.0, "N"), (4, None, 2, 1.0, "N"), (50, 5, 1, None, None)],
                     "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def _all(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_are_grouped_where_they_lie(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    _tables(spark, d)
    want = clean.tagged(testdata.retail_raw(spark, d))
    near = clean.tagged(testdata.retail_raw(spark, d, 7, "_order"), near="_order")
    assert near.columns == want.columns and _all(near) == _all(want) and near.agg(F.max("_copies")).first()[0] > 1
    monkeypatch.setattr(pipeline, "LINES_EACH", 10)
    assert pipeline.shares(spark, d) > 4
    assert _all(pipeline.tagged(spark, d)) == _all(want)
    assert _all(pipeline.tx(spark, d)) == _all(clean.cleaned(want))
    assert _all(clean.audit(pipeline.tagged(spark, d))) == _all(clean.audit(want))


def test_whole_rows_are_not_shuffled(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    _tables(spark, d)
    monkeypatch.setattr(pipeline, "LINES_EACH", 10)
    seen = []
    monkeypatch.setattr(type(pipeline.ws(spark, d)), "table", lambda self, name, build: seen.append(build()) or seen[-1])
    plan = pipeline.tagged(spark, d)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not any("InvoiceNo" in line or "StockCode" in line for line in moved)


def test_rfm_and_historical_value_share_their_totals(spark):
    t = dt.datetime
    tx = spark.createDataFrame([("a", "1", t(2020, 1, 1), 1.25), ("a", "1", t(2020, 1, 1), 2.0), ("a", None, t(2020, 3, 1), None),
                                ("b", None, t(2020, 2, 1), None), (None, "2", None, 3.0)],
                               "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice double")
    totals = rfm.customer_totals(tx)
    assert _all(totals) == _all(spark.createDataFrame(
        [("a", 32500, 1, t(2020, 1, 1), t(2020, 3, 1)), ("b", None, 0, t(2020, 2, 1), t(2020, 2, 1)), (None, 30000, 1, None, None)],
        "c string, u bigint, n bigint, f timestamp_ntz, l timestamp_ntz"))
    assert _all(rfm.compute_rfm(tx, totals=totals)) == _all(rfm.compute_rfm(tx)) == sorted(
        [("a", 1, 1, 3.25), ("b", 30, 0, None), (None, None, 1, 3.0)], key=repr)


def test_training_counts_need_no_copies_of_lines(spark):
    t = dt.datetime
    tx = spark.createDataFrame(
        [("a", "1", "p", t(2020, 1, 1), 1.0), ("a", "1", "q", t(2020, 1, 1), 2.0), ("a", "2", "p", t(2020, 1, 5), 3.0), ("a", None, None, t(2020, 1, 6), 4.0),
         ("a", "2", "late", t(2020, 2, 5), 9.0), ("b", "3", "p", t(2020, 2, 1), 5.0), (None, "4", "p", t(2020, 1, 2), None), ("c", "5", None, t(2019, 1, 1), 1.0)],
        "CustomerID string, InvoiceNo string, StockCode string, InvoiceDate timestamp_ntz, TotalPrice double")
    got = propensity.build_training_table(tx, F.lit(t(2020, 1, 10)).cast("timestamp_ntz"))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.CustomerID: (r.frequency, r.monetary, r.recency_days, r.tenure_days, r.distinct_products, r.label) for r in got.collect()}
    assert rows == {"a": (2, 10.0, 4, 9, 2, 1), None: (1, None, 8, 8, 1, 0), "c": (1, 1.0, 374, 374, 0, 0)}
