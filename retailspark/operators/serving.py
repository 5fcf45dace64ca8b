"""Customer-360 table and the serving / analytic queries on top of it.

Point lookups and top-k queries compile to filters and
``TakeOrderedAndProject``; per-key top-k (offers per product / customer) is
``row_number`` over a window partitioned by the key — every group is small
(rules per antecedent), so no task holds more than one key's rules.
Global ranks (deciles, discount tiers) use the exact distributed rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.labels import WIN_BACK_SEGMENTS, literal_map
from retailspark.functions.money import money_units
from retailspark.functions.rank import SortKey, with_global_rank

# fixed values: row-limit validation ranges of the serving endpoints
LIMIT_BOUNDS = {
    "list_customers": (1, 1000),
    "top_clv": (1, 200),
    "top_products": (1, 500),
    "country_top": (1, 100),
    "next_best_offers": (1, 20),
}

# fixed values: country name → ISO-3 code used by the map view
COUNTRY_ISO3 = {
    "United Kingdom": "GBR", "EIRE": "IRL", "Netherlands": "NLD", "Germany": "DEU",
    "France": "FRA", "Australia": "AUS", "Spain": "ESP", "Switzerland": "CHE",
    "Sweden": "SWE", "Denmark": "DNK", "Belgium": "BEL", "Portugal": "PRT", "Japan": "JPN",
    "Norway": "NOR", "Italy": "ITA", "Finland": "FIN", "Cyprus": "CYP", "Austria": "AUT",
    "Greece": "GRC", "Singapore": "SGP", "Israel": "ISR", "Poland": "POL",
    "United Arab Emirates": "ARE", "USA": "USA", "Iceland": "ISL", "Lithuania": "LTU",
    "Malta": "MLT", "Canada": "CAN", "Thailand": "THA", "RSA": "ZAF", "Lebanon": "LBN",
    "Brazil": "BRA", "Bahrain": "BHR", "Korea": "KOR", "Czech Republic": "CZE",
    "Saudi Arabia": "SAU", "Nigeria": "NGA",
}


def check_limit(endpoint: str, limit: int) -> int:
    lo, hi = LIMIT_BOUNDS[endpoint]
    if not isinstance(limit, int) or not lo <= limit <= hi:
        raise ValueError(f"{endpoint}: limit must be in [{lo}, {hi}], got {limit!r}")
    return limit


def customers_frame(segments: DataFrame, clv: DataFrame, propensity: DataFrame) -> DataFrame:
    seg = segments.select(
        F.col("CustomerID").alias("customer_id"), F.col("Recency").alias("recency"),
        F.col("Frequency").alias("frequency"), F.col("Monetary").alias("monetary"),
        F.col("RFM_Score").alias("rfm_score"), F.col("Segment").alias("segment"),
        F.col("Action").alias("action"), F.col("ClusterName").alias("cluster_name"))
    c = clv.select(F.col("CustomerID").alias("customer_id"), "predicted_clv", "prob_alive",
                   "predicted_purchases", "historical_clv", "clv_method")
    p = propensity.select(F.col("CustomerID").alias("customer_id"), "propensity")
    return seg.join(c, "customer_id", "left").join(p, "customer_id", "left")


def get_customer(customers: DataFrame, customer_id: str) -> DataFrame:
    return customers.filter(F.col("customer_id") == F.lit(customer_id))


def segment_summary(customers: DataFrame) -> DataFrame:
    g = customers.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(money_units(F.col("monetary"))).alias("_u"),
        F.avg("predicted_clv").alias("avg_predicted_clv"),
        F.avg("prob_alive").alias("avg_prob_alive"))
    return g.select("segment", "customers", (F.col("_u") / 10000.0).alias("total_revenue"),
                    (F.col("_u") / 10000.0 / F.col("customers")).alias("avg_monetary"),
                    F.round("avg_predicted_clv", 6).alias("avg_predicted_clv"),
                    F.round("avg_prob_alive", 6).alias("avg_prob_alive")) \
        .orderBy(F.desc("total_revenue"), "segment")


def top_clv(customers: DataFrame, limit: int = 20) -> DataFrame:
    check_limit("top_clv", limit)
    return (customers.select("customer_id", "segment", "predicted_clv", "prob_alive", "propensity")
            .orderBy(F.desc("predicted_clv"), "customer_id").limit(limit))


def offers_per_antecedent(rules: DataFrame, limit: int = 5) -> DataFrame:
    """Batch form of the single-product offer query: top ``limit`` rules by
    lift for every antecedent code text."""
    check_limit("next_best_offers", limit)
    w = Window.partitionBy("antecedents_codes").orderBy(F.desc("lift"), "consequents_codes")
    return (rules.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .select("antecedents_codes", "rank", "antecedents", "consequents", "consequents_codes",
                    "support", "confidence", "lift"))


def offers_for_customers(top_product: DataFrame, rules: DataFrame, limit: int = 5) -> DataFrame:
    """Top ``limit`` rules of each customer's product (one row per customer in
    ``top_product``): the rules are cut per antecedent before the join, so no
    customer meets more than ``limit`` of them."""
    best = offers_per_antecedent(rules, limit)
    return (top_product.join(best, top_product.stock_code == best.antecedents_codes)
            .select("customer_id", "rank", "antecedents", "consequents", "consequents_codes",
                    "support", "confidence", "lift"))


def win_back_candidates(customers: DataFrame) -> DataFrame:
    return (customers.filter(F.col("segment").isin(*WIN_BACK_SEGMENTS))
            .select("customer_id", "segment", "recency", "frequency", "monetary", "predicted_clv",
                    "prob_alive")
            .orderBy(F.desc("predicted_clv"), "customer_id"))


def customer_exists(customers: DataFrame, probe_ids: DataFrame) -> DataFrame:
    """probe (customer_id) ⊕ exists flag, one row per probe: one left join
    against the distinct ids."""
    known = customers.select("customer_id").distinct().withColumn("exists", F.lit(True))
    return probe_ids.join(known, "customer_id", "left") \
        .select("customer_id", F.coalesce(F.col("exists"), F.lit(False)).alias("exists"))


def list_customers(customers: DataFrame, limit: int = 100) -> DataFrame:
    check_limit("list_customers", limit)
    return (customers.select("customer_id", "segment", "recency", "frequency", "monetary",
                             "predicted_clv", "propensity")
            .orderBy(F.desc("monetary"), "customer_id").limit(limit))


def top_products(products: DataFrame, limit: int = 20) -> DataFrame:
    check_limit("top_products", limit)
    return products.orderBy(F.desc("revenue"), "stock_code").limit(limit)


def country_top(country: DataFrame, limit: int = 15) -> DataFrame:
    check_limit("country_top", limit)
    return country.orderBy(F.desc("revenue"), "country").limit(limit)


def product_overview(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("products"),
                        (F.sum(money_units(F.col("revenue"))) / 10000.0).alias("revenue"),
                        F.sum("quantity").alias("quantity"))


# ------------------------------------------------------------ analytic SQL
def segment_rollup(customers: DataFrame) -> DataFrame:
    g = customers.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(money_units(F.col("monetary"))).alias("_u"),
        F.avg("predicted_clv").alias("c"), F.avg("prob_alive").alias("a"))
    return g.select("segment", "customers", F.round(F.col("_u") / 10000.0, 0).alias("total_revenue"),
                    F.round("c", 2).alias("avg_predicted_clv"), F.round("a", 3).alias("avg_prob_alive")) \
        .orderBy(F.desc("total_revenue"), "segment")


def ntile_of_rank(rank_col: str, n: int, buckets: int):
    """SQL NTILE(b) from a 1-based rank: the first n mod b tiles get one extra row."""
    q, r = divmod(n, buckets)
    big = r * (q + 1)
    i = F.col(rank_col)
    if q == 0:
        return i.cast("int")
    return F.when(i <= big, F.floor((i - 1) / (q + 1)) + 1) \
        .otherwise(F.floor((i - big - 1) / q) + r + 1).cast("int")


def pareto_deciles(customers: DataFrame) -> DataFrame:
    ranked = with_global_rank(customers.select("customer_id", "predicted_clv"),
                              [SortKey("predicted_clv", False), SortKey("customer_id")], "_r")
    n = ranked.count()
    g = ranked.groupBy(ntile_of_rank("_r", n, 10).alias("decile")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(money_units(F.col("predicted_clv"))).alias("_u"))
    return g.select("decile", "customers", F.round(F.col("_u") / 10000.0, 0).alias("clv_in_decile"),
                    F.round(100.0 * F.col("_u") / F.sum("_u").over(Window.partitionBy()), 1)
                    .alias("pct_of_total_clv")).orderBy("decile")


def valuable_at_risk(customers: DataFrame) -> DataFrame:
    avg_clv = customers.select(F.avg("predicted_clv")).scalar()
    return (customers.filter((F.col("predicted_clv") > avg_clv) & (F.col("prob_alive") < 0.5))
            .select("customer_id", "segment", "predicted_clv", "prob_alive", "propensity")
            .orderBy(F.desc("predicted_clv"), "customer_id").limit(50))


def single_item_rules(rules: DataFrame) -> DataFrame:
    return (rules.filter(~F.col("antecedents_codes").contains(","))
            .select("antecedents", "consequents", "support", "confidence", "lift")
            .orderBy(F.desc("lift"), "antecedents", "consequents").limit(25))


def targeting(customers: DataFrame) -> DataFrame:
    return (customers.filter(F.col("propensity") > 0.7)
            .select("customer_id", "segment", "propensity", "predicted_clv")
            .orderBy(F.desc("predicted_clv"), "customer_id").limit(100))


def kpi_weighted(seg_summary: DataFrame) -> DataFrame:
    n = F.sum("customers")
    return seg_summary.agg(
        n.alias("total_customers"),
        (F.sum(money_units(F.coalesce(F.col("total_revenue"), F.lit(0.0)))) / 10000.0).alias("total_revenue"),
        F.round(F.sum(F.coalesce(F.col("avg_predicted_clv"), F.lit(0.0)) * F.col("customers"))
                / F.greatest(n, F.lit(1)), 6).alias("avg_clv"),
        F.round(F.sum(F.coalesce(F.col("avg_prob_alive"), F.lit(0.0)) * F.col("customers"))
                / F.greatest(n, F.lit(1)), 6).alias("avg_alive"))


def segment_revenue_share(seg_summary: DataFrame) -> DataFrame:
    u = money_units(F.col("total_revenue"))
    return seg_summary.select("segment", "total_revenue",
                              (u / F.sum(u).over(Window.partitionBy())).alias("revenue_share")) \
        .orderBy("total_revenue", "segment")


def peak_month(monthly: DataFrame) -> DataFrame:
    return monthly.agg(F.count(F.lit(1)).alias("months"),
                       F.max("revenue").alias("peak_revenue"),
                       F.min_by("month", F.struct(-F.col("revenue"), F.col("month"))).alias("peak_month"))


def monthly_long(monthly: DataFrame) -> DataFrame:
    return monthly.unpivot("month", ["orders", "customers"], "metric", "value")


def country_map(country: DataFrame, drop_uk: bool = False) -> DataFrame:
    c = country.filter(F.col("country") != "United Kingdom") if drop_uk else country
    iso = F.try_element_at(literal_map(COUNTRY_ISO3), F.col("country"))
    return c.withColumn("iso3", iso).filter(F.col("iso3").isNotNull())


def product_label(products: DataFrame, n: int = 15) -> DataFrame:
    return (products.orderBy(F.desc("revenue"), "stock_code").limit(n)
            .select("stock_code", "revenue",
                    F.concat(F.col("stock_code"), F.lit(" "),
                             F.substring(F.coalesce(F.col("description"), F.lit("")), 1, 22)).alias("label")))
