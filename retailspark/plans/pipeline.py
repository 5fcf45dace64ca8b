"""Stage wiring: which operator feeds which, with phase outputs materialised
once per (session, data folder) — see ``stages.Stages``."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators import clean, rfm
from retailspark.plans.stages import Stages
from retailspark.sources import testdata


def ws(spark: SparkSession, sf_dir: str) -> Stages:
    return Stages.of(spark, sf_dir)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Ranges of the key, sorted: a point lookup on the written table then reads
    the one row group whose statistics hold the key."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


#: Order lines that one task of the cleaning gets.
LINES_EACH = 250_000


def shares(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for a shuffle of the order lines, by their number, so that what a
    task holds does not grow with the table; None while these are no more than
    the cluster's cores."""
    lines = ws(spark, sf_dir).value("n_lines", lambda: testdata.table(spark, sf_dir, "lineitem").count())
    n = -(-lines // LINES_EACH)
    return n if n > spark.sparkContext.defaultParallelism else None


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.retail_raw(spark, sf_dir, shares(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct raw rows with the first rule each fails: one pass for the
    cleaned table and the audit.  A large table's rows are grouped where they
    met their order, so the whole rows move no second time; an invoice's rows
    are written side by side."""
    def build():
        n = shares(spark, sf_dir)
        rows = (clean.tagged(testdata.retail_raw(spark, sf_dir, n, "_order"), near="_order") if n
                else clean.tagged(raw(spark, sf_dir)))
        return rows.sortWithinPartitions("_rule", "InvoiceNo")
    return ws(spark, sf_dir).table("clean_tagged", build)


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned transactions (phase-0 output): the rows of the tagged table that
    fail no rule, which it holds ahead of the others; not written twice."""
    return clean.cleaned(tagged(spark, sf_dir))


def tx_file(spark: SparkSession, sf_dir: str) -> str:
    """Path of the cleaned transactions as a table of their own."""
    stages = ws(spark, sf_dir)
    return stages.once("transactions_clean", lambda: tx(spark, sf_dir).write.mode("overwrite").parquet(
        stages.path("transactions_clean")))


def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws(spark, sf_dir).table("customer_totals", lambda: rfm.customer_totals(tx(spark, sf_dir)))


def rfm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws(spark, sf_dir).table("rfm", lambda: rfm.compute_rfm(
        tx(spark, sf_dir), totals=customer_totals(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws(spark, sf_dir).table("rfm_scored", lambda: rfm.score_rfm(rfm_table(spark, sf_dir)))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import eda
    return ws(spark, sf_dir).table("products", lambda: by_key(eda.build_products(tx(spark, sf_dir)), "stock_code"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import eda
    return ws(spark, sf_dir).table("monthly", lambda: eda.build_monthly(tx(spark, sf_dir)))


def country(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import eda
    return ws(spark, sf_dir).table("country", lambda: eda.build_country(tx(spark, sf_dir)))


def customer_top_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import eda
    return ws(spark, sf_dir).table(
        "customer_top_product", lambda: eda.build_customer_top_product(tx(spark, sf_dir)))


# ------------------------------------------------------------------ CLV
HORIZON_MONTHS = 3
HOLDOUT_DAYS = 180


def clv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import clv
    return ws(spark, sf_dir).table("clv_summary", lambda: clv.build_summary(tx(spark, sf_dir)))


def historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import clv
    return ws(spark, sf_dir).table("clv_historical", lambda: clv.historical_clv(
        tx(spark, sf_dir), customer_totals(spark, sf_dir)))


def _told(fit, name: str):
    """``fit``, with a warning where it did not converge."""
    if not fit.converged:
        warnings.warn(f"the {name} fit did not converge in {fit.n_iter} steps; its predictions may be off", stacklevel=2)
    return fit


def bgnbd_fit(spark: SparkSession, sf_dir: str):
    from retailspark.operators import clv
    return ws(spark, sf_dir).value("bgnbd_fit", lambda: _told(clv.fit_bgnbd(clv_summary(spark, sf_dir)), "BG/NBD"))


def gg_fit(spark: SparkSession, sf_dir: str):
    from retailspark.operators import clv
    return ws(spark, sf_dir).value("gg_fit", lambda: _told(clv.fit_gamma_gamma(clv_summary(spark, sf_dir)), "Gamma-Gamma"))


def clv_predictions(spark: SparkSession, sf_dir: str, fixed: bool = False) -> DataFrame:
    from retailspark.operators import clv
    if fixed:
        return ws(spark, sf_dir).table("clv_predictions_fixed", lambda: clv.predict(
            clv_summary(spark, sf_dir), clv.BGNBD(*clv.FIXED_BG), clv.GammaGamma(*clv.FIXED_GG),
            HORIZON_MONTHS))
    return ws(spark, sf_dir).table("clv_predictions", lambda: clv.predict(
        clv_summary(spark, sf_dir), bgnbd_fit(spark, sf_dir).params, gg_fit(spark, sf_dir).params,
        HORIZON_MONTHS))


def customer_clv(spark: SparkSession, sf_dir: str, fixed: bool = False) -> DataFrame:
    """summary ⟕ predictions ⟕ historical ⟕ segments (one row per customer;
    every join is on the CustomerID key of two customer-level tables)."""
    def build():
        hist = historical(spark, sf_dir).select(
            "CustomerID", F.col("total_revenue").alias("historical_clv"), "n_orders",
            "avg_order_value", "tenure_days")
        # the fixed twin needs no fitted clusters: segment only
        seg = (scored(spark, sf_dir).select("CustomerID", "Segment",
                                            F.lit(None).cast("string").alias("ClusterName"))
               if fixed else segments(spark, sf_dir).select("CustomerID", "Segment", "ClusterName"))
        return (clv_summary(spark, sf_dir)
                .join(clv_predictions(spark, sf_dir, fixed), "CustomerID", "left")
                .join(hist, "CustomerID", "left")
                .join(seg, "CustomerID", "left"))
    return ws(spark, sf_dir).table("customer_clv_fixed" if fixed else "customer_clv", build)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored RFM customers ⊕ K-means cluster and cluster name."""
    from retailspark.operators import kmeans
    return ws(spark, sf_dir).table("customer_segments", lambda: kmeans.attach_clusters(
        spark, scored(spark, sf_dir), km_features(spark, sf_dir), km_sweep(spark, sf_dir)))


def km_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import kmeans
    return ws(spark, sf_dir).table("km_features", lambda: kmeans.scaled_features(scored(spark, sf_dir)))


def km_sweep(spark: SparkSession, sf_dir: str):
    """(rows, best centres per k) of the k = 2..10 × 10-seed sweep, once."""
    from retailspark.operators import kmeans
    return ws(spark, sf_dir).value("km_sweep", lambda: kmeans.sweep(km_features(spark, sf_dir)))


# ------------------------------------------------------------------ basket
def basket_tx(spark: SparkSession, sf_dir: str, attr: str = "p_type") -> DataFrame:
    return testdata.basket_items(spark, sf_dir, attr)


def item_descriptions(spark: SparkSession, sf_dir: str, attr: str = "p_type") -> DataFrame:
    """Modal part name per item value (labels for rules over part attributes)."""
    pt = testdata.table(spark, sf_dir, "part")
    from retailspark.operators import eda
    return eda.modal_by(pt.withColumnRenamed(attr, "StockCode"), "StockCode", "p_name", "Description")


def rules(spark: SparkSession, sf_dir: str, attr: str = "p_type") -> DataFrame:
    from retailspark.operators import basket
    return ws(spark, sf_dir).table(f"rules_{attr}", lambda: basket.mine_rules(testdata.basket_lines(spark, sf_dir, attr)))


def rules_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat ``rules`` serving table (items = brands: many single-item rules)."""
    from retailspark.operators import basket
    return ws(spark, sf_dir).table("rules_serving", lambda: basket.flatten_rules(basket.label_rules(
        rules(spark, sf_dir, "p_brand"), item_descriptions(spark, sf_dir, "p_brand"))))


def customer_top_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id → brand with the highest line revenue (ties → smallest);
    the per-customer key the brand rules are looked up with."""
    def build():
        li = testdata.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
        od = testdata.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        pt = testdata.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        from retailspark.functions.money import money_units
        per = (li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
               .groupBy(F.col("o_custkey").cast("string").alias("customer_id"),
                        F.col("p_brand").alias("stock_code"))
               .agg(F.sum(money_units(F.col("l_extendedprice"))).alias("_u")))
        best = per.groupBy("customer_id").agg(
            F.min(F.struct((-F.col("_u")).alias("neg"), F.col("stock_code").alias("code"))).alias("b"))
        return best.select("customer_id", F.col("b.code").alias("stock_code"),
                           (-F.col("b.neg") / 10000.0).alias("revenue"))
    return ws(spark, sf_dir).table("customer_top_brand", build)


# ------------------------------------------------------------------ propensity
PROPENSITY_HORIZON = 90


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import propensity as pr
    def build():
        t = tx(spark, sf_dir)
        return pr.build_training_table(t, pr.default_cutoff(t, PROPENSITY_HORIZON), PROPENSITY_HORIZON)
    return ws(spark, sf_dir).table("propensity_training", build)


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import propensity as pr
    return ws(spark, sf_dir).table("propensity_split",
                                   lambda: pr.train_test(training_table(spark, sf_dir)))


def fitted_model(spark: SparkSession, sf_dir: str, kind: str = "logistic"):
    from retailspark.operators import propensity as pr
    def build():
        train = split_table(spark, sf_dir).filter(~F.col("is_test"))
        return pr.fit_logistic(train) if kind == "logistic" else pr.fit_gbt(train)
    return ws(spark, sf_dir).value(f"model_{kind}", build)


def propensity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from retailspark.operators import propensity as pr
    return ws(spark, sf_dir).table("propensity_scores", lambda: pr.predict_proba(
        fitted_model(spark, sf_dir, "gbt"), training_table(spark, sf_dir))
        .select("CustomerID", F.col("score").alias("propensity"), "label"))


def fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic closed-form score of the features, 2 dp (ties occur)."""
    t = training_table(spark, sf_dir)
    raw = F.col("frequency") / (F.col("frequency") + 1.0 + F.col("recency_days") / 30.0)
    return t.select("CustomerID", "label", (F.floor(raw * 100 + 0.5) / 100.0).alias("score"))


# ------------------------------------------------------------------ customer 360
def customers(spark: SparkSession, sf_dir: str, fixed: bool = False) -> DataFrame:
    """Denormalised customer table.  ``fixed=True``: every column is a
    deterministic function of the data (R-score clusters, fixed-parameter
    CLV, closed-form score) — the oracle-checkable twin of the fitted one."""
    from retailspark.operators import kmeans, serving
    if not fixed:
        return ws(spark, sf_dir).table("customers", lambda: by_key(serving.customers_frame(
            segments(spark, sf_dir), customer_clv(spark, sf_dir),
            propensity_scores(spark, sf_dir)), "customer_id"))

    def build():
        sc = scored(spark, sf_dir)
        names = kmeans.name_clusters(kmeans.profile_clusters(sc.withColumn("Cluster", F.col("R"))))
        seg = sc.join(F.broadcast(names.withColumnRenamed("Cluster", "R")), "R")  # ≤ 5 rows
        c = customer_clv(spark, sf_dir, fixed=True).select(
            "CustomerID", *[F.round(x, 6).alias(x) for x in
                            ("predicted_clv", "prob_alive", "predicted_purchases", "historical_clv")],
            "clv_method")
        prop = fixed_scores(spark, sf_dir).select("CustomerID", F.col("score").alias("propensity"))
        return by_key(serving.customers_frame(seg, c, prop), "customer_id")
    return ws(spark, sf_dir).table("customers_fixed", build)
