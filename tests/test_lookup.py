"""Lookups in serving tables: bloom filters on the key, bound values."""

import pytest
from pyspark.sql import functions as F

from retailspark.sources import retail


def rows_read(found):
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lookup") / "serving")
    customers = spark.range(0, 40_000, 2).select(F.format_string("%06d", "id").alias("customer_id"), (F.col("id") * 3).alias("spend"))
    customers = customers.union(spark.createDataFrame([(None, 1), ("x' OR 'a' = 'a", 2)], "customer_id string, spend bigint")).coalesce(1)
    retail.load_all(spark, {"customers": customers, "other": customers}, at)
    return at


def test_an_absent_id_reads_no_row_group(spark, root):
    inside = [f"{i:06d}" for i in range(1001, 1041, 2)]  # between the least and the greatest id
    read = [rows_read(retail.lookup(spark, root, "customers", i)) for i in inside]
    assert read.count(0) >= len(read) - 2  # a bloom filter may err now and then
    assert rows_read(retail.lookup(spark, root, "customers", "zz")) == 0


def test_a_known_id_is_found_once(spark, root):
    assert [tuple(r) for r in retail.lookup(spark, root, "customers", "001000").collect()] == [("001000", 3000)]
    assert [r.spend for r in retail.lookup(spark, root, "other", "001000", key="customer_id").collect()] == [3000]


def test_values_are_bound_and_null_finds_nothing(spark, root):
    assert [r.spend for r in retail.lookup(spark, root, "customers", "x' OR 'a' = 'a").collect()] == [2]
    assert retail.lookup(spark, root, "customers", "' OR '1' = '1").count() == 0
    assert retail.lookup(spark, root, "customers", None).count() == 0


def test_an_empty_table(spark, tmp_path):
    at = str(tmp_path / "serving")
    retail.load_all(spark, {"products": spark.createDataFrame([], "stock_code string, revenue double")}, at)
    assert retail.lookup(spark, at, "products", "1").collect() == []
