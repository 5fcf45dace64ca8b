"""What a task of the cleaning holds, and its customer ids."""

from pyspark.sql import functions as F

from retailspark.operators import clean
from retailspark.plans import pipeline


def test_no_groups_before_the_cleaning_shuffle(spark):
    raw = spark.createDataFrame([("1", "10000A", "x", 1, "2011-01-01 10:00:00", 2.5, "7.0", "UK")] * 3,
                                "Invoice string, StockCode string, Description string, Quantity bigint, InvoiceDate string, Price double, `Customer ID` string, Country string")
    df = clean.tagged(raw, 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("HashAggregate") < plan.index("Exchange")
    assert "HashAggregate" not in plan[plan.index("Exchange"):]
    assert [(r["_copies"], r["_rule"], r["CustomerID"]) for r in df.collect()] == [(3, 0, "7")]


def test_shares_grow_with_the_lines(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert pipeline.shares(spark, str(tmp_path)) is None
    monkeypatch.setattr(pipeline, "LINES_EACH", 10)
    assert pipeline.shares(spark, str(tmp_path)) == 100


def test_customer_ids_with_and_without_a_pattern(spark):
    want = {"13085": "13085", "13085.0": "13085", "13085.": "13085", "13085.00": "13085", "013": "13", "+5": "5", "-5.0": "-5",
            "-0": "0", " 7 ": "7", "7 .0": None, "\t7": None, "13085.7": None, "1.3085E4": "13085", "NaN": None, "": None, ".0": None,
            "x": None, "1" * 18: "1" * 18, "9" * 30: "9" * 30, "9" * 39: None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "c string").select(F.col("c"), F.col("c").alias("CustomerID"))
    assert {r["c"]: r["CustomerID"] for r in clean.normalize_customer_id(df).collect()} == want
