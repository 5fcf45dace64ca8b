"""Rule index, versioned loads, K-means without rows, sinks over the phase outputs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.operators import basket, kmeans_batch
from retailspark.sources import retail


def rules_frame(spark, rules):
    rows = [(sorted(a), sorted(c), 0.1, 0.5, lift) for a, c, lift in rules]
    return spark.createDataFrame(rows, "antecedents array<string>, consequents array<string>, support double, confidence double, lift double")


def test_a_basket_meets_a_rule_once_and_fires_what_it_should(spark):
    r = random.Random(5)
    items = ["hot"] + [f"i{n}" for n in range(30)]
    rules = [({"hot", f"i{n}"}, {f"i{(n + 1) % 30}"}, 1.0 + n) for n in range(30)] + [({"hot"}, {"i3"}, 1.5), ({"i1", "i2", "hot"}, {"x"}, 9.0), ({"never"}, {"i1"}, 99.0)]
    baskets = [(f"b{n}", ["hot"] + r.sample(items[1:], 3)) for n in range(200)] + [("e", []), ("n", None)]
    b = spark.createDataFrame(baskets, "basket_id string, items array<string>")
    fired = basket.fired_rules(rules_frame(spark, rules), b)
    got = sorted((x.basket_id, tuple(x.antecedents), tuple(x.consequents)) for x in fired.collect())
    want = sorted((k, tuple(sorted(a)), tuple(sorted(c))) for k, have in baskets for a, c, _ in rules if have and a <= set(have))
    assert got == want
    # rows that the index look-up makes, before the containment test
    held = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("sets"))
    index = basket.rule_index(rules_frame(spark, rules), held)
    met = b.select("basket_id", F.explode("items").alias("key")).join(index, "key").count()
    assert met <= 1.2 * len(want) and index.filter("key = 'hot'").count() == 1


def test_recommendations_keep_the_best_rule_of_each_product(spark):
    rules = [({"a"}, {"x"}, 2.0), ({"a", "b"}, {"x", "y"}, 3.0), ({"c"}, {"y"}, 9.0), ({"b"}, {"a"}, 5.0)]
    b = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "a"]), ("3", ["z"])], "basket_id string, items array<string>")
    got = sorted((r.basket_id, r.rank, r.StockCode, r.lift, r.from_rule) for r in basket.recommend_for_baskets(rules_frame(spark, rules), b).collect())
    assert got == [("1", 1, "x", 3.0, "a, b"), ("1", 2, "y", 3.0, "a, b"), ("2", 1, "x", 2.0, "a")]


def test_a_reader_sees_all_old_or_all_new_tables(spark, tmp_path):
    root = str(tmp_path / "serving")
    with pytest.raises(FileNotFoundError):
        retail.serving_version(spark, root)
    counts = retail.load_all(spark, {"a": spark.range(3), "b": spark.range(5)}, root)
    assert sorted(map(tuple, counts.collect())) == [("a", 3), ("b", 5)]
    old = retail.serving_version(spark, root)
    read = lambda: [retail.serving_table(spark, root, n).count() for n in "ab"]

    seen = []
    peek = F.udf(lambda x: x, "long")
    swap = retail._swap_manifest

    def during(*args):  # the new tables are written, the manifest is not yet swapped
        seen.append(read())
        swap(*args)

    retail._swap_manifest = during
    try:
        retail.load_all(spark, {"a": spark.range(7).select(peek("id").alias("id")), "b": spark.range(8)}, root, view_prefix="v_")
    finally:
        retail._swap_manifest = swap
    assert seen == [[3, 5]] and read() == [7, 8] and spark.table("v_b").count() == 8
    assert retail.serving_table(spark, root, "a", old).count() == 3  # a reader that began before
    broken = spark.range(4).select(F.expr("assert_true(id < 2, 'broken')").alias("id"))
    with pytest.raises(Exception, match="broken"):
        retail.load_all(spark, {"a": spark.range(1), "b": broken}, root)
    assert read() == [7, 8]


def test_kmeans_without_rows(spark):
    none = spark.createDataFrame([], "CustomerID string, x double, y double")
    centers, cost = kmeans_batch.fit_many(none, "CustomerID", ["x", "y"], [(2, 1), (3, 1)])
    assert [c.shape for c in centers] == [(0, 2), (0, 2)] and not cost.any()
    assert kmeans_batch.assign(none, ["x", "y"], centers[0]).columns[-1] == "Cluster"


def test_kmeans_is_no_worse_than_the_library(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((60, 2)) + c for c in ((0, 0), (6, 0), (0, 7))])
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "CustomerID string, x double, y double")
    _, cost = kmeans_batch.fit_many(df, "CustomerID", ["x", "y"], [(3, s) for s in range(4)])
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df).cache()
    library = min(KMeans(k=3, seed=s).fit(vec).summary.trainingCost for s in range(4))
    assert min(cost) <= library * 1.0001
