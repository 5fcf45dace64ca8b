"""Query registry: one entry per operator of the survey inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver's tables (via
the adapter views), with every computed column aliased to the name its DuckDB
oracle (``plans.oracles``) uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators import clean, rfm
from retailspark.plans import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- cleaning
@query("clean_transactions")
def q_clean_transactions(spark, d):
    return P.tx(spark, d)


@query("clean_audit")
def q_clean_audit(spark, d):
    return clean.audit(P.tagged(spark, d))


# ---------------------------------------------------------------- RFM
@query("snapshot_date")
def q_snapshot_date(spark, d):
    tx = P.tx(spark, d)
    return tx.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("snapshot_date"))


@query("compute_rfm")
def q_compute_rfm(spark, d):
    return P.rfm_table(spark, d)


@query("score_rfm")
def q_score_rfm(spark, d):
    return P.scored(spark, d)


@query("segment_summary_eda")
def q_segment_summary_eda(spark, d):
    return rfm.summarize_segments(P.scored(spark, d))


@query("segment_actions")
def q_segment_actions(spark, d):
    return rfm.segment_actions(P.scored(spark, d))


# ---------------------------------------------------------------- EDA
from retailspark.operators import eda  # noqa: E402


@query("eda_overview")
def q_eda_overview(spark, d):
    return eda.dataset_overview(P.tx(spark, d))


@query("eda_monthly")
def q_eda_monthly(spark, d):
    return eda.monthly_summary(P.tx(spark, d))


@query("eda_country")
def q_eda_country(spark, d):
    return eda.country_summary(P.tx(spark, d))


@query("eda_country_top10")
def q_eda_country_top10(spark, d):
    return eda.country_summary(P.tx(spark, d), top_n=10)


@query("eda_order_stats")
def q_eda_order_stats(spark, d):
    return eda.order_value_stats(P.tx(spark, d))


@query("eda_customer_dist")
def q_eda_customer_dist(spark, d):
    return eda.customer_value_distribution(P.tx(spark, d))


@query("modal_description")
def q_modal_description(spark, d):
    tx = P.tx(spark, d)
    codes = tx.select("StockCode").distinct()
    return codes.join(eda.modal_by(tx, "StockCode", "Description", "description"), "StockCode", "left").select(
        "StockCode", F.coalesce("description", F.lit("")).alias("description"))


@query("eda_top_products")
def q_eda_top_products(spark, d):
    return eda.top_products(P.tx(spark, d), n=20)


@query("product_descriptions")
def q_product_descriptions(spark, d):
    return eda.product_descriptions(P.tx(spark, d))


@query("sum_products")
def q_sum_products(spark, d):
    return P.products(spark, d).orderBy(F.desc("revenue"), "stock_code")


@query("sum_monthly")
def q_sum_monthly(spark, d):
    return P.monthly(spark, d).orderBy("month")


@query("sum_country")
def q_sum_country(spark, d):
    return P.country(spark, d).orderBy(F.desc("revenue"), "country")


@query("customer_top_product")
def q_customer_top_product(spark, d):
    return P.customer_top_product(spark, d).orderBy("customer_id")


# ---------------------------------------------------------------- CLV
from retailspark.functions.labels import SEGMENT_GRID, lookup  # noqa: E402
from retailspark.operators import clv, kmeans  # noqa: E402


def _round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@query("clv_historical")
def q_clv_historical(spark, d):
    return P.historical(spark, d)


@query("clv_summary")
def q_clv_summary(spark, d):
    return P.clv_summary(spark, d)


@query("clv_summary_events")
def q_clv_summary_events(spark, d):
    from retailspark.sources.testdata import purchase_tx
    return clv.build_summary(purchase_tx(spark, d))


@query("clv_eligible")
def q_clv_eligible(spark, d):
    return P.clv_summary(spark, d).filter(clv.eligible())


@query("clv_corr")
def q_clv_corr(spark, d):
    return clv.frequency_monetary_correlation(P.clv_summary(spark, d))


def _cal_obs(tx: DataFrame):
    obs = tx.select(F.max("InvoiceDate")).scalar()
    cal = tx.select(F.max("InvoiceDate") - F.expr(f"INTERVAL {P.HOLDOUT_DAYS} DAYS")).scalar()
    return cal, obs


@query("clv_cal_holdout")
def q_clv_cal_holdout(spark, d):
    tx = P.tx(spark, d)
    cal, obs = _cal_obs(tx)
    return clv.calibration_holdout(tx, cal, obs)


@query("clv_method_counts")
def q_clv_method_counts(spark, d):
    return P.clv_predictions(spark, d).groupBy("clv_method").agg(F.count(F.lit(1)).alias("customers"))


def _fixed_summary_cols(spark, d, cols):
    s = P.clv_summary(spark, d)
    bg, gg = clv.BGNBD(*clv.FIXED_BG), clv.GammaGamma(*clv.FIXED_GG)
    x, tx_, T, m = F.col("frequency"), F.col("recency"), F.col("T"), F.col("monetary_value")
    return _round_doubles(s.select("CustomerID", *cols(bg, gg, x, tx_, T, m)))


@query("clv_expected_fixed")
def q_clv_expected_fixed(spark, d):
    return _fixed_summary_cols(spark, d, lambda bg, gg, x, t, T, m: [
        clv.expected_purchases(P.HORIZON_MONTHS * clv.DAYS_PER_MONTH, bg, x, t, T)
        .alias("predicted_purchases")])


@query("clv_expected_heavy")
def q_clv_expected_heavy(spark, d):
    """Buyers with hundreds to thousands of purchase days: whole nations."""
    from retailspark.sources.testdata import nation_tx
    s = clv.build_summary(nation_tx(spark, d))
    x, tx_, T = F.col("frequency"), F.col("recency"), F.col("T")
    e = clv.expected_purchases_many([float(P.HOLDOUT_DAYS), 365.25], clv.BGNBD(*clv.FIXED_BG), x, tx_, T)
    return _round_doubles(s.select("CustomerID", "frequency", e[0].alias("purchases_180"),
                                   e[1].alias("purchases_365")))


@query("clv_alive_fixed")
def q_clv_alive_fixed(spark, d):
    return _fixed_summary_cols(spark, d, lambda bg, gg, x, t, T, m: [
        clv.prob_alive(bg, x, t, T).alias("prob_alive")])


@query("clv_avg_value_fixed")
def q_clv_avg_value_fixed(spark, d):
    return _fixed_summary_cols(spark, d, lambda bg, gg, x, t, T, m: [
        clv.expected_avg_value(gg, x, m).alias("predicted_avg_value")])


@query("clv_predict_fixed")
def q_clv_predict_fixed(spark, d):
    return _round_doubles(P.clv_predictions(spark, d, fixed=True))


@query("bgnbd_fit")
def q_bgnbd_fit(spark, d):
    return clv.param_summary(spark, P.bgnbd_fit(spark, d), "bg_nbd")


@query("ggf_fit")
def q_ggf_fit(spark, d):
    return clv.param_summary(spark, P.gg_fit(spark, d), "gamma_gamma")


@query("clv_end_to_end")
def q_clv_end_to_end(spark, d):
    return P.clv_predictions(spark, d)


@query("clv_validate")
def q_clv_validate(spark, d):
    tx = P.tx(spark, d)
    cal, obs = _cal_obs(tx)
    ch = P.ws(spark, d).table("clv_cal_holdout", lambda: clv.calibration_holdout(tx, cal, obs))
    fit = P.ws(spark, d).value("bgnbd_cal_fit", lambda: clv.fit_bgnbd(
        ch, freq_col="frequency_cal", rec_col="recency_cal", T_col="T_cal"))
    return clv.holdout_metrics(ch, fit.params, P.HOLDOUT_DAYS)


@query("clv_validate_fixed")
def q_clv_validate_fixed(spark, d):
    tx = P.tx(spark, d)
    cal, obs = _cal_obs(tx)
    ch = P.ws(spark, d).table("clv_cal_holdout", lambda: clv.calibration_holdout(tx, cal, obs))
    return _round_doubles(clv.holdout_metrics(ch, clv.BGNBD(*clv.FIXED_BG), P.HOLDOUT_DAYS))


@query("customer_clv")
def q_customer_clv(spark, d):
    return P.customer_clv(spark, d)


@query("customer_clv_fixed")
def q_customer_clv_fixed(spark, d):
    return _round_doubles(P.customer_clv(spark, d, fixed=True).drop("ClusterName"))


def _clv_by_segment(c: DataFrame) -> DataFrame:
    return (c.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("predicted_clv").alias("avg_predicted_clv"),
        F.sum("predicted_clv").alias("total_predicted_clv"),
        F.avg("prob_alive").alias("avg_prob_alive"))
        .orderBy(F.desc("total_predicted_clv"), "Segment"))


@query("clv_by_segment_fixed")
def q_clv_by_segment_fixed(spark, d):
    return _round_doubles(_clv_by_segment(
        _round_doubles(P.customer_clv(spark, d, fixed=True))), 4)


@query("clv_top10_fixed")
def q_clv_top10_fixed(spark, d):
    c = _round_doubles(P.customer_clv(spark, d, fixed=True))
    return (c.select("CustomerID", "Segment", "frequency", "monetary_value", "predicted_purchases",
                     "prob_alive", "predicted_clv", "historical_clv")
            .orderBy(F.desc("predicted_clv"), "CustomerID").limit(10))


@query("clv_histogram_fixed")
def q_clv_histogram_fixed(spark, d):
    """60 equal-width bins of predicted CLV up to its 99th percentile
    (eligible customers, CLV > 0)."""
    from retailspark.functions.stats import exact_quantiles
    c = _round_doubles(P.customer_clv(spark, d, fixed=True)).filter(
        (F.col("clv_method") == "bg_nbd_gamma_gamma") & (F.col("predicted_clv") > 0))
    p99 = exact_quantiles(c, "predicted_clv", [0.99]).first()["q0"]
    kept = c.filter(F.col("predicted_clv") <= F.lit(p99))
    b = F.least(F.floor(F.col("predicted_clv") / F.lit(p99 / 60.0)), F.lit(59)).cast("int")
    return kept.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customers")) \
        .select("bin", F.round(F.col("bin") * F.lit(p99 / 60.0), 4).alias("bin_start"), "customers")


@query("clv_segment_median_fixed")
def q_clv_segment_median_fixed(spark, d):
    from retailspark.functions.stats import group_medians
    c = _round_doubles(P.customer_clv(spark, d, fixed=True))
    m = group_medians(c, "Segment", "predicted_clv", "CustomerID", "m")
    return m.select("Segment", F.round("m", 4).alias("median_clv")).orderBy("median_clv", "Segment")


# ---------------------------------------------------------------- K-means
def _vec(spark, d):
    return P.km_features(spark, d)


@query("km_features")
def q_km_features(spark, d):
    return _round_doubles(_vec(spark, d), 9)


@query("km_silhouette_by_segment")
def q_km_silhouette(spark, d):
    feat = _vec(spark, d).join(P.scored(spark, d).select("CustomerID", "Segment"), "CustomerID")
    vec = kmeans._vectors(feat)
    seg_ids = {name: float(i) for i, name in enumerate(sorted(set(SEGMENT_GRID.values())))}
    lab = vec.withColumn("label", lookup(seg_ids, F.col("Segment")))
    return spark.createDataFrame([(round(kmeans.silhouette(lab, "label"), 9),)], "silhouette double")


@query("km_evaluate")
def q_km_evaluate(spark, d):
    rows, _ = P.km_sweep(spark, d)
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


@query("km_choose_k")
def q_km_choose_k(spark, d):
    return kmeans.choose_k(q_km_evaluate(spark, d))


@query("customer_segments")
def q_customer_segments(spark, d):
    return P.segments(spark, d)


@query("km_profile")
def q_km_profile(spark, d):
    return kmeans.profile_clusters(P.segments(spark, d)).orderBy(F.desc("avg_monetary"))


@query("km_names")
def q_km_names(spark, d):
    return P.segments(spark, d).select("Cluster", "ClusterName").distinct().orderBy("Cluster")


@query("km_profile_by_r")
def q_km_profile_by_r(spark, d):
    return kmeans.profile_clusters(P.scored(spark, d).withColumnRenamed("R", "Cluster"))


@query("km_names_by_r")
def q_km_names_by_r(spark, d):
    prof = kmeans.profile_clusters(P.scored(spark, d).withColumnRenamed("R", "Cluster"))
    return kmeans.name_clusters(prof)


# ---------------------------------------------------------------- basket
from retailspark.operators import basket  # noqa: E402


@query("frequent_products")
def q_frequent_products(spark, d):
    return basket.frequent_products(P.basket_tx(spark, d, "p_brand"))


@query("frequent_products_tx")
def q_frequent_products_tx(spark, d):
    return basket.frequent_products(P.tx(spark, d))


@query("basket_matrix")
def q_basket_matrix(spark, d):
    return basket.basket_matrix(P.basket_tx(spark, d))


@query("frequent_itemsets")
def q_frequent_itemsets(spark, d):
    return basket.frequent_itemsets(basket.basket_matrix(P.basket_tx(spark, d)))


@query("frequent_itemsets_brand")
def q_frequent_itemsets_brand(spark, d):
    return basket.frequent_itemsets(basket.basket_matrix(P.basket_tx(spark, d, "p_brand")))


@query("association_rules")
def q_association_rules(spark, d):
    return P.rules(spark, d).select("antecedents", "consequents", "support", "confidence", "lift")


@query("association_rules_confidence")
def q_association_rules_confidence(spark, d):
    b = basket.basket_matrix(P.basket_tx(spark, d))
    return basket.association_rules(basket.frequent_itemsets(b), metric="confidence",
                                    min_threshold=0.5) \
        .select("antecedents", "consequents", "support", "confidence", "lift")


@query("mine_rules")
def q_mine_rules(spark, d):
    return P.rules(spark, d, "p_brand").select("antecedents", "consequents", "support", "confidence", "lift")


@query("rules_labelled")
def q_rules_labelled(spark, d):
    return basket.label_rules(P.rules(spark, d), P.item_descriptions(spark, d))


@query("rules_flat")
def q_rules_flat(spark, d):
    return P.rules_serving(spark, d)


def _baskets(spark, d):
    return (P.basket_tx(spark, d).groupBy(F.col("InvoiceNo").alias("basket_id"))
            .agg(F.array_sort(F.collect_set("StockCode")).alias("items")))


@query("recommend_basket")
def q_recommend_basket(spark, d):
    return basket.recommend_for_baskets(P.rules(spark, d), _baskets(spark, d), top_n=5)


@query("recommend_product")
def q_recommend_product(spark, d):
    prods = P.basket_tx(spark, d, "p_brand").select("StockCode").distinct()
    return basket.recommend_for_products(P.rules(spark, d, "p_brand"), prods, top_n=5)


@query("nbo_descriptions")
def q_nbo_descriptions(spark, d):
    prods = P.basket_tx(spark, d, "p_brand").select("StockCode").distinct()
    recs = basket.recommend_for_products(P.rules(spark, d, "p_brand"), prods, top_n=5)
    return basket.add_descriptions(recs, P.item_descriptions(spark, d, "p_brand"))


@query("rules_scatter")
def q_rules_scatter(spark, d):
    return P.rules_serving(spark, d).select("support", "confidence", "lift")


# ---------------------------------------------------------------- propensity
from retailspark.operators import propensity as pr  # noqa: E402


@query("default_cutoff")
def q_default_cutoff(spark, d):
    tx = P.tx(spark, d)
    return tx.agg((F.max("InvoiceDate") - F.expr("INTERVAL 90 DAYS")).alias("cutoff"))


@query("training_table")
def q_training_table(spark, d):
    return P.training_table(spark, d)


@query("propensity_base_rate")
def q_propensity_base_rate(spark, d):
    return pr.base_rate(P.training_table(spark, d))


@query("split_xy")
def q_split_xy(spark, d):
    return pr.split_xy(P.training_table(spark, d))


@query("train_test")
def q_train_test(spark, d):
    return P.split_table(spark, d).select("CustomerID", "label", "is_test")


@query("evaluate_roc_auc")
def q_roc_auc(spark, d):
    return pr.roc_auc(P.fixed_scores(spark, d))


@query("evaluate_pr_auc")
def q_pr_auc(spark, d):
    return _round_doubles(pr.average_precision(P.fixed_scores(spark, d)), 9)


@query("evaluate_brier")
def q_brier(spark, d):
    return _round_doubles(pr.brier(P.fixed_scores(spark, d)), 9)


@query("calibration_table")
def q_calibration(spark, d):
    return _round_doubles(pr.calibration_table(P.fixed_scores(spark, d), n_bins=10), 9)


def _test_scores(spark, d, kind):
    """Written once: the metrics rank and aggregate them several times."""
    test = P.split_table(spark, d).filter(F.col("is_test"))
    return P.ws(spark, d).table(f"test_scores_{kind}",
                                lambda: pr.predict_proba(P.fitted_model(spark, d, kind), test))


@query("fit_logistic")
def q_fit_logistic(spark, d):
    m = P.fitted_model(spark, d, "logistic")["model"]
    rows = [(c, float(w)) for c, w in zip(pr.FEATURE_COLUMNS, m.coefficients.toArray())]
    rows.append(("intercept", float(m.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query("fit_gbt")
def q_fit_gbt(spark, d):
    m = P.fitted_model(spark, d, "gbt")["model"]
    return spark.createDataFrame([(c, float(v)) for c, v in zip(pr.FEATURE_COLUMNS, m.importance())],
                                 "feature string, importance double")


@query("predict_proba")
def q_predict_proba(spark, d):
    return _test_scores(spark, d, "logistic").select("CustomerID", "label", "score")


@query("model_comparison")
def q_model_comparison(spark, d):
    out = None
    for kind in ("logistic", "gbt"):
        s = _test_scores(spark, d, kind)
        # three single-row metric frames side by side (1 row each)
        m = (pr.roc_auc(s).withColumn("_k", F.lit(1))
             .join(pr.average_precision(s).withColumn("_k", F.lit(1)), "_k")
             .join(pr.brier(s).withColumn("_k", F.lit(1)), "_k")
             .drop("_k").withColumn("model", F.lit(kind)))
        out = m if out is None else out.unionByName(m)
    return out


@query("propensity_scores")
def q_propensity_scores(spark, d):
    return P.propensity_scores(spark, d)


@query("propensity_calibration_model")
def q_propensity_calibration_model(spark, d):
    return pr.calibration_table(_test_scores(spark, d, "gbt"), n_bins=10)


@query("shap_importance")
def q_shap_importance(spark, d):
    return pr.tree_attribution(P.fitted_model(spark, d, "gbt"), P.split_table(spark, d).filter(F.col("is_test")))


@query("linear_importance")
def q_linear_importance(spark, d):
    return pr.linear_attribution(P.fitted_model(spark, d, "logistic"),
                                 P.split_table(spark, d).filter(F.col("is_test")))


@query("shap_additivity")
def q_shap_additivity(spark, d):
    """Rows whose base and attributions do not add up to the model's margin."""
    test = P.split_table(spark, d).filter(F.col("is_test"))
    rows = pr.tree_attribution_rows(P.fitted_model(spark, d, "gbt"), test)
    margin = F.log(F.col("score") / (1 - F.col("score")))
    both = rows.join(_test_scores(spark, d, "gbt").select("CustomerID", margin.alias("margin")), "CustomerID")
    total = F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda a, v: a + v)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.abs(total - F.col("margin")) > 1e-6, 1)).alias("off"))


@query("logistic_rows")
def q_logistic_rows(spark, d):
    """The fitted logistic model's test scores against the closed form from its
    coefficients: rows that differ."""
    fitted = P.fitted_model(spark, d, "logistic")
    m = fitted["moments"]
    z = F.lit(float(fitted["model"].intercept))
    for c, w in zip(pr.FEATURE_COLUMNS, fitted["model"].coefficients.toArray()):
        if m[f"sd_{c}"]:
            z = z + F.lit(float(w)) * (F.col(c) - F.lit(m[f"mu_{c}"])) / F.lit(m[f"sd_{c}"])
    s = _test_scores(spark, d, "logistic")
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.abs(F.col("score") - 1 / (1 + F.exp(-z))) > 1e-9, 1)).alias("off"))


# ---------------------------------------------------------------- serving
from retailspark.operators import serving as sv  # noqa: E402


def _cf(spark, d):
    return P.customers(spark, d, fixed=True)


@query("customers_frame")
def q_customers_frame(spark, d):
    return P.customers(spark, d)


@query("customers_fixed")
def q_customers_fixed(spark, d):
    return _cf(spark, d)


@query("get_customer")
def q_get_customer(spark, d):
    return RT.lookup(spark, _served(spark, d), "customers", "100")


@query("segment_summary")
def q_segment_summary(spark, d):
    return sv.segment_summary(_cf(spark, d))


@query("top_clv")
def q_top_clv(spark, d):
    return sv.top_clv(_cf(spark, d), 20)


@query("nbo_for_product")
def q_nbo_for_product(spark, d):
    return sv.offers_per_antecedent(P.rules_serving(spark, d), 5)


@query("nbo_for_customer")
def q_nbo_for_customer(spark, d):
    return sv.offers_for_customers(P.customer_top_brand(spark, d), P.rules_serving(spark, d), 5)


@query("win_back_candidates")
def q_win_back(spark, d):
    return sv.win_back_candidates(_cf(spark, d))


@query("customer_exists")
def q_customer_exists(spark, d):
    from retailspark.sources.testdata import table
    probes = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return sv.customer_exists(_cf(spark, d), probes)


@query("count_customers")
def q_count_customers(spark, d):
    return _cf(spark, d).agg(F.count(F.lit(1)).alias("customers"))


@query("list_customers")
def q_list_customers(spark, d):
    return sv.list_customers(_cf(spark, d), 100)


@query("top_products")
def q_top_products(spark, d):
    return sv.top_products(P.products(spark, d), 20)


@query("get_product")
def q_get_product(spark, d):
    return RT.lookup(spark, _served(spark, d), "products", "00001")


@query("monthly_series")
def q_monthly_series(spark, d):
    return P.monthly(spark, d).orderBy("month")


@query("country_top")
def q_country_top(spark, d):
    return sv.country_top(P.country(spark, d), 15)


@query("product_overview")
def q_product_overview(spark, d):
    return sv.product_overview(P.products(spark, d))


@query("sql_segment_rollup")
def q_sql_segment_rollup(spark, d):
    return sv.segment_rollup(_cf(spark, d))


@query("sql_pareto_deciles")
def q_sql_pareto(spark, d):
    return sv.pareto_deciles(_cf(spark, d))


@query("sql_valuable_at_risk")
def q_sql_var(spark, d):
    return sv.valuable_at_risk(_cf(spark, d))


@query("sql_single_item_rules")
def q_sql_single(spark, d):
    return sv.single_item_rules(P.rules_serving(spark, d))


@query("sql_targeting")
def q_sql_targeting(spark, d):
    return sv.targeting(_cf(spark, d))


@query("kpi_weighted")
def q_kpi_weighted(spark, d):
    return sv.kpi_weighted(sv.segment_summary(_cf(spark, d)))


@query("segment_revenue_share")
def q_segment_revenue_share(spark, d):
    return sv.segment_revenue_share(sv.segment_summary(_cf(spark, d)))


@query("peak_month")
def q_peak_month(spark, d):
    return sv.peak_month(P.monthly(spark, d))


@query("monthly_long")
def q_monthly_long(spark, d):
    return sv.monthly_long(P.monthly(spark, d))


@query("country_map")
def q_country_map(spark, d):
    named = P.country(spark, d).join(TD.country_names(spark, d), "country")
    return sv.country_map(named.drop("country").withColumnRenamed("name", "country"))


@query("product_label")
def q_product_label(spark, d):
    return sv.product_label(P.products(spark, d), 15)


# ---------------------------------------------------------------- insight / campaign
from retailspark.functions import labels as L  # noqa: E402
from retailspark.operators import campaign as cp  # noqa: E402
from retailspark.operators import insight as ins  # noqa: E402
from retailspark.sources import testdata as TD  # noqa: E402


def _offers(spark, d):
    return sv.offers_for_customers(P.customer_top_brand(spark, d), P.rules_serving(spark, d), 5)


@query("risk_band")
def q_risk_band(spark, d):
    return _cf(spark, d).select("customer_id", "prob_alive", L.risk_band(F.col("prob_alive")).alias("risk_level"))


@query("labels_zh")
def q_labels_zh(spark, d):
    return _cf(spark, d).select(
        "customer_id", L.segment_zh(F.col("segment")).alias("segment_zh"),
        L.cluster_zh(F.col("cluster_name")).alias("cluster_zh"),
        L.risk_zh(L.risk_band(F.col("prob_alive"))).alias("risk_zh"),
        L.action_zh(F.col("action")).alias("action_zh"))


@query("insight_context")
def q_insight_context(spark, d):
    return ins.insight_context(_cf(spark, d), _offers(spark, d))


@query("insight_template")
def q_insight_template(spark, d):
    return ins.insight_template(ins.insight_context(_cf(spark, d), _offers(spark, d)))


@query("insight_constraints")
def q_insight_constraints(spark, d):
    return ins.insight_violations(ins.insight_template(ins.insight_context(_cf(spark, d), _offers(spark, d))))


@query("chat_facts")
def q_chat_facts(spark, d):
    return ins.chat_facts(_cf(spark, d), _offers(spark, d))


@query("answer_template")
def q_answer_template(spark, d):
    return ins.answer_template(ins.chat_facts(_cf(spark, d), _offers(spark, d)))


@query("fetch_fan_in")
def q_fetch_fan_in(spark, d):
    return ins.fetch_fan_in(_cf(spark, d), _offers(spark, d))


def _winback(spark, d):
    return sv.win_back_candidates(_cf(spark, d)).select("customer_id", "segment", "predicted_clv",
                                                        "recency", "prob_alive")


@query("discount_tiers")
def q_discount_tiers(spark, d):
    return cp.discount_tiers(_winback(spark, d))


@query("match_offers")
def q_match_offers(spark, d):
    return cp.campaign_candidates(_winback(spark, d), _offers(spark, d))


def _edits(spark, d):
    wb = _winback(spark, d)
    # reviewer edits: drop long-dormant customers, cap the discount of low-P(alive) ones
    excluded = wb.filter(F.col("recency") > 1500).select("customer_id")
    overrides = wb.filter(F.col("prob_alive") < 0.5).select("customer_id", F.lit(0.05).alias("discount"))
    return excluded, overrides


def _revised(spark, d):
    return cp.campaign_revision(cp.campaign_candidates(_winback(spark, d), _offers(spark, d)), *_edits(spark, d))


@query("campaign_revision")
def q_campaign_revision(spark, d):
    return _revised(spark, d)


@query("campaign_summary")
def q_campaign_summary(spark, d):
    return cp.campaign_summary(_revised(spark, d))


@query("campaign_brief")
def q_campaign_brief(spark, d):
    return cp.campaign_brief(cp.campaign_summary(_revised(spark, d)))


@query("campaign_build")
def q_campaign_build(spark, d):
    """The pending draft as it goes to review: with the tiered candidates and their offers."""
    c = P.ws(spark, d).table("campaign_candidates", lambda: cp.campaign_candidates(_winback(spark, d), _offers(spark, d)))
    return cp.draft_with_candidates(cp.campaign_build(c, "win-back"), c)


@query("campaign_build_revised")
def q_campaign_build_revised(spark, d):
    excluded, overrides = _edits(spark, d)
    return cp.campaign_build(cp.campaign_candidates(_winback(spark, d), _offers(spark, d)), "win-back",
                             excluded=excluded, overrides=overrides)


#: Drafts of the review queries: candidates are dealt to them by customer number, two a thread.
N_DRAFTS = 14


def _drafts(spark, d):
    def build():
        c = cp.campaign_candidates(_winback(spark, d), _offers(spark, d))
        number = F.col("customer_id").cast("bigint") % N_DRAFTS
        return c.select(number.alias("approval_id"),
                        F.concat(F.lit("t"), F.floor(number / 2).cast("string")).alias("thread_id"),
                        F.timestamp_add("HOUR", number, F.lit("1995-01-01").cast("timestamp_ntz")).alias("created_at"),
                        "customer_id", "segment", "predicted_clv", "discount", "offer")
    return P.ws(spark, d).table("campaign_drafts", build)


def _reviewed(spark, d):
    c = _drafts(spark, d)
    return cp.campaign_decisions(cp.campaign_drafts(c), c, TD.decision_log(spark, d, N_DRAFTS))


@query("campaign_decisions")
def q_campaign_decisions(spark, d):
    return _reviewed(spark, d)[0]


@query("campaign_decided_candidates")
def q_campaign_decided_candidates(spark, d):
    return _reviewed(spark, d)[1].select("approval_id", "customer_id", "discount", "offer")


@query("campaign_list")
def q_campaign_list(spark, d):
    return cp.campaign_list(_reviewed(spark, d)[0])


@query("campaign_list_approved")
def q_campaign_list_approved(spark, d):
    return cp.campaign_list(_reviewed(spark, d)[0], "approved")


@query("campaign_latest")
def q_campaign_latest(spark, d):
    return cp.campaign_latest(_reviewed(spark, d)[0]).select("thread_id", "approval_id", "status", "candidate_count")


@query("status_check")
def q_status_check(spark, d):
    return cp.status_violations(_reviewed(spark, d)[0].select(
        F.when(F.col("reviewer") == "r3", F.lit("lost")).otherwise(F.col("status")).alias("status")))


@query("conversation_history")
def q_conversation_history(spark, d):
    return cp.conversation_history(TD.messages(spark, d))


@query("message_role_check")
def q_message_role_check(spark, d):
    return cp.role_violations(TD.messages(spark, d))


@query("conversation_append")
def q_conversation_append(spark, d):
    return _appended(spark, d)[1]


@query("thread_upsert")
def q_thread_upsert(spark, d):
    return _appended(spark, d)[0]


def _appended(spark, d):
    """Threads known from their first turns; later turns come in with the
    customer they speak of (every fourth speaks of none)."""
    m = TD.messages(spark, d)
    key = F.col("thread_id").cast("bigint")
    old, new = m.filter(F.col("turn") < 1), m.filter(F.col("turn") >= 1)
    threads = old.select("thread_id", F.when(key % 2 == 0, F.concat(F.lit("c"), "thread_id")).alias("customer_id")).distinct()
    named = new.withColumn("customer_id", F.when(F.col("turn") % 4 != 1, F.concat(F.lit("n"), "thread_id", F.lit("."), F.col("turn").cast("string"))))
    return cp.conversation_append(threads, old, named)


@query("thread_cascade_delete")
def q_thread_cascade_delete(spark, d):
    m = TD.messages(spark, d)
    # threads whose conversation never got an answer are deleted
    answered = m.filter(F.col("role") == "ai").select("thread_id").distinct()
    unanswered = m.select("thread_id").distinct().join(answered, "thread_id", "left_anti")
    kept, approvals = cp.thread_cascade_delete(m, _thread_approvals(m), unanswered)
    return (kept.select("thread_id", F.lit("message").alias("kind"), "turn", "role")
            .unionByName(approvals.select("thread_id", F.lit("approval").alias("kind"), "turn", "role")))


def _thread_approvals(m):
    """One approval for each thread, as of its last turn."""
    return m.groupBy("thread_id").agg(F.max("turn").alias("turn"), F.lit("pending").alias("role"))


# ---------------------------------------------------------------- sources / sinks
from retailspark.sources import retail as RT  # noqa: E402


def _stage_path(spark, d, name):
    ws = P.ws(spark, d)
    return ws.path(name)


@query("src_raw_csv")
def q_src_raw_csv(spark, d):
    path = _stage_path(spark, d, "raw_csv")
    ws = P.ws(spark, d)
    ws.once("raw_csv", lambda: RT.write_csv(P.raw(spark, d), path))
    return RT.load_raw(spark, path)


@query("src_clean_parquet")
def q_src_clean_parquet(spark, d):
    return RT.load_clean(spark, P.tx_file(spark, d))


@query("sink_rules")
def q_sink_rules(spark, d):
    path = _stage_path(spark, d, "association_rules_out")
    labelled = basket.label_rules(P.rules(spark, d), P.item_descriptions(spark, d))
    RT.write_table(labelled, path)
    return spark.read.parquet(path)


@query("load_all")
def q_load_all(spark, d):
    frames = {"customers": _cf(spark, d), "rules": P.rules_serving(spark, d),
              "products": P.products(spark, d), "monthly": P.monthly(spark, d),
              "country": P.country(spark, d), "customer_top_product": P.customer_top_product(spark, d)}
    return RT.load_all(spark, frames, _stage_path(spark, d, "serving"))


def _served(spark, d):
    """The root of the serving tables, loaded once for this workspace's lookups."""
    P.ws(spark, d).once("serving_lookups", lambda: q_load_all(spark, d).collect())  # 6 rows
    return _stage_path(spark, d, "serving")


@query("tbl_passthrough")
def q_tbl_passthrough(spark, d):
    q_load_all(spark, d).collect()  # 6 rows
    root = _stage_path(spark, d, "serving")
    version = RT.serving_version(spark, root)
    return _whole_summaries({name: RT.serving_table(spark, root, name, version) for name in _SUMMARY_KEYS})


_SUMMARY_KEYS = {"products": "stock_code", "monthly": "month", "country": "country", "customer_top_product": "customer_id"}


def _whole_summaries(frames):
    """All columns of the four summaries in one frame (0 and '' where a table
    lacks one); ``text``: the description of a product, the product of a customer."""
    out = None
    for name, key in _SUMMARY_KEYS.items():
        df = frames[name]
        text = {"products": "description", "customer_top_product": "stock_code"}.get(name)
        more = [F.col(c).cast("long").alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in ("quantity", "orders", "customers")]
        t = df.select(F.lit(name).alias("table"), F.col(key).alias("key"), (F.col(text) if text else F.lit("")).alias("text"), "revenue", *more)
        out = t if out is None else out.unionByName(t)
    return out


def _round_trip(spark, d, name, df):
    """Write a phase output and read it back."""
    path = _stage_path(spark, d, name)
    RT.write_table(df, path)
    return spark.read.parquet(path)


@query("sink_clean")
def q_sink_clean(spark, d):
    return _round_trip(spark, d, "out/transactions_clean", P.tx(spark, d))


@query("sink_segments")
def q_sink_segments(spark, d):
    return _round_trip(spark, d, "out/customer_segments", P.scored(spark, d))


@query("sink_clv")
def q_sink_clv(spark, d):
    return _round_trip(spark, d, "out/customer_clv", _round_doubles(P.customer_clv(spark, d, fixed=True).drop("ClusterName")))


@query("sink_scores")
def q_sink_scores(spark, d):
    return _round_trip(spark, d, "out/propensity_scores", P.fixed_scores(spark, d))


@query("sink_summaries")
def q_sink_summaries(spark, d):
    frames = {"products": P.products(spark, d), "monthly": P.monthly(spark, d),
              "country": P.country(spark, d), "customer_top_product": P.customer_top_product(spark, d)}
    return _whole_summaries({name: _round_trip(spark, d, f"out/{name}", df) for name, df in frames.items()})


def _written_whole(spark, d, name, df, columns):
    """Rows of a phase output that was written and read back, and those that
    differ from what the phase made, in any of its ``columns``, either way."""
    back = _round_trip(spark, d, f"out/{name}", df)
    missing = [c for c in columns if c not in back.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    off = df.exceptAll(back).unionByName(back.exceptAll(df))
    both = back.select(F.lit(0).alias("o")).unionByName(off.select(F.lit(1).alias("o")))
    return both.agg(F.count(F.when(F.col("o") == 0, 1)).alias("rows"), F.count(F.when(F.col("o") == 1, 1)).alias("off"))


@query("sink_segments_fitted")
def q_sink_segments_fitted(spark, d):
    """The phase output itself: scores, action, fitted cluster and its name."""
    return _written_whole(spark, d, "customer_segments_fitted", P.segments(spark, d), ["CustomerID", "RFM_Score", "Segment", "Action", "Cluster", "ClusterName"])


@query("sink_clv_fitted")
def q_sink_clv_fitted(spark, d):
    """CLV from the fitted models, with segment and cluster name."""
    return _written_whole(spark, d, "customer_clv_fitted", P.customer_clv(spark, d), ["CustomerID", "predicted_clv", "clv_method", "Segment", "ClusterName"])


@query("sink_scores_fitted")
def q_sink_scores_fitted(spark, d):
    """Scores of the boosted trees for the whole population."""
    return _written_whole(spark, d, "propensity_scores_fitted", P.propensity_scores(spark, d), ["CustomerID", "propensity", "label"])


@query("limit_bounds")
def q_limit_bounds(spark, d):
    """Per endpoint: the limits it takes, how many rows its largest limit
    returns of the table behind it, and how many of the four limits around the
    bounds it refuses."""
    tables = {"list_customers": _cf(spark, d), "top_clv": _cf(spark, d), "top_products": P.products(spark, d),
              "country_top": P.country(spark, d), "next_best_offers": P.rules_serving(spark, d)}
    out = None
    for endpoint, (low, high) in sv.LIMIT_BOUNDS.items():
        refused = 0
        for limit in (low - 1, low, high, high + 1):
            try:
                sv.check_limit(endpoint, limit)
            except ValueError:
                refused += 1
        t = tables[endpoint].limit(sv.check_limit(endpoint, high)).agg(F.count(F.lit(1)).alias("rows"))
        t = t.select(F.lit(endpoint).alias("endpoint"), F.lit(low).alias("low"), F.lit(high).alias("high"), "rows", F.lit(refused).alias("refused"))
        out = t if out is None else out.unionByName(t)
    return out


@query("clv_param_summary")
def q_clv_param_summary(spark, d):
    return q_bgnbd_fit(spark, d).unionByName(q_ggf_fit(spark, d))


def _documents(spark, d):
    """The revised draft as a chunked document, written once and read back."""
    return P.ws(spark, d).table("draft_documents", lambda: cp.draft_document(
        _revised(spark, d).withColumn("approval_id", F.lit(0))))


@query("json_draft")
def q_json_draft(spark, d):
    return cp.draft_heads(_documents(spark, d)).drop("approval_id")


@query("json_draft_candidates")
def q_json_draft_candidates(spark, d):
    return cp.draft_candidates(_documents(spark, d)).drop("approval_id")


@query("sink_campaign_csv")
def q_sink_campaign_csv(spark, d):
    path = _stage_path(spark, d, "campaign_csv")
    RT.write_csv(_revised(spark, d), path)
    return spark.read.option("header", True).schema(
        "customer_id string, segment string, predicted_clv double, discount double, offer string").csv(path)


# ---------------------------------------------------------------- cleaning steps
@query("clean_rename")
def q_clean_rename(spark, d):
    return clean.standardize_columns(P.raw(spark, d))


@query("clean_dates")
def q_clean_dates(spark, d):
    return clean.parse_dates(clean.standardize_columns(P.raw(spark, d)))


@query("clean_custid")
def q_clean_custid(spark, d):
    return clean.normalized(P.raw(spark, d))


@query("clean_dedup")
def q_clean_dedup(spark, d):
    return clean.normalized(P.raw(spark, d)).dropDuplicates()


@query("clean_total")
def q_clean_total(spark, d):
    return clean.add_total_price(clean.normalized(P.raw(spark, d)).dropDuplicates())


@query("is_cancel")
def q_is_cancel(spark, d):
    n = clean.normalized(P.raw(spark, d)).dropDuplicates()
    return n.groupBy(clean.is_cancellation().alias("is_cancel")).agg(F.count(F.lit(1)).alias("rows"))


@query("is_product")
def q_is_product(spark, d):
    n = clean.normalized(P.raw(spark, d)).dropDuplicates()
    return n.groupBy("StockCode").agg(F.first(clean.is_product_stockcode()).alias("is_product"))


@query("clean_filters")
def q_clean_filters(spark, d):
    return P.tx(spark, d).drop("TotalPrice")
