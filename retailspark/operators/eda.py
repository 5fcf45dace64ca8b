"""Exploratory summaries and the precomputed serving summaries.

All are grouped aggregations with map-side partial aggregation; distinct
counts use Spark's Expand-based distinct aggregation (one shuffle).  Money is
summed exactly (``functions.money``).  Shares are computed from integer money
units over the already-aggregated (small) result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.money import money_sum, money_units
from retailspark.functions.stats import describe


def dataset_overview(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count(F.lit(1)).alias("n_line_items"),
        F.count_distinct("CustomerID").alias("n_customers"),
        F.count_distinct("InvoiceNo").alias("n_invoices"),
        F.count_distinct("StockCode").alias("n_products"),
        F.count_distinct("Country").alias("n_countries"),
        F.min("InvoiceDate").alias("date_min"),
        F.max("InvoiceDate").alias("date_max"),
        money_sum("TotalPrice").alias("total_revenue"))


def _rev_orders_customers(g) -> DataFrame:
    return g.agg(F.sum(money_units(F.col("TotalPrice"))).alias("_units"),
                 F.count_distinct("InvoiceNo").alias("orders"),
                 F.count_distinct("CustomerID").alias("customers"))


def monthly_summary(tx: DataFrame) -> DataFrame:
    g = _rev_orders_customers(tx.groupBy(F.date_trunc("month", "InvoiceDate").alias("month")))
    return (g.select("month", (F.col("_units") / 10000.0).alias("revenue"), "orders", "customers",
                     (F.col("_units") / 10000.0 / F.col("orders")).alias("avg_order_value"))
            .orderBy("month"))


def country_summary(tx: DataFrame, top_n: int | None = None) -> DataFrame:
    """revenue_share uses every country's revenue, even when cut to top_n."""
    g = _rev_orders_customers(tx.groupBy("Country"))
    out = (g.select("Country", (F.col("_units") / 10000.0).alias("revenue"), "orders", "customers",
                    (F.col("_units") / F.sum("_units").over(Window.partitionBy()))
                    .alias("revenue_share"))
           .orderBy(F.desc("revenue"), "Country"))
    return out.limit(top_n) if top_n else out


def order_value_stats(tx: DataFrame) -> DataFrame:
    totals = tx.groupBy("InvoiceNo").agg(money_sum("TotalPrice").alias("v"))
    return describe(totals, "v", "order_value")


def customer_value_distribution(tx: DataFrame) -> DataFrame:
    spend = tx.groupBy("CustomerID").agg(money_sum("TotalPrice").alias("v"))
    return describe(spend, "v", "customer_spend")


def modal_by(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key → most common non-NULL value; ties → smallest; keys without one are
    absent.  Counted by (key, value) first, so that no buffer holds all the
    values of a hot key."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(out))


def product_descriptions(tx: DataFrame) -> DataFrame:
    """StockCode → modal description; products with only NULL text absent."""
    return modal_by(tx, "StockCode", "Description", "Description")


def top_products(tx: DataFrame, n: int = 20) -> DataFrame:
    g = tx.groupBy("StockCode").agg(money_sum("TotalPrice").alias("revenue"), F.sum("Quantity").alias("units"))
    top = g.orderBy(F.desc("revenue"), "StockCode").limit(n)
    names = modal_by(tx.join(F.broadcast(top.select("StockCode")), "StockCode", "left_semi"),  # n rows
                     "StockCode", "Description", "description")
    return (top.join(names, "StockCode", "left")
            .withColumn("description", F.coalesce("description", F.lit("")))
            .orderBy(F.desc("revenue"), "StockCode"))


# ---------------------------------------------------------- serving summaries
def build_products(tx: DataFrame) -> DataFrame:
    g = tx.groupBy("StockCode").agg(
        money_sum("TotalPrice").alias("revenue"),
        F.sum("Quantity").alias("quantity"),
        F.count_distinct("InvoiceNo").alias("orders"),
        F.count_distinct("CustomerID").alias("customers"))
    g = g.join(modal_by(tx, "StockCode", "Description", "description"), "StockCode", "left")
    return g.select(F.col("StockCode").alias("stock_code"), "description", "revenue",
                    "quantity", "orders", "customers")


def build_monthly(tx: DataFrame) -> DataFrame:
    g = _rev_orders_customers(tx.groupBy(F.date_format("InvoiceDate", "yyyy-MM").alias("month")))
    return g.select("month", (F.col("_units") / 10000.0).alias("revenue"), "orders", "customers")


def build_country(tx: DataFrame) -> DataFrame:
    g = _rev_orders_customers(tx.groupBy(F.col("Country").alias("country")))
    return g.select("country", (F.col("_units") / 10000.0).alias("revenue"), "orders", "customers")


def build_customer_top_product(tx: DataFrame) -> DataFrame:
    """Per customer the product with the highest revenue; ties → smallest code.

    Two aggregations, no window: (customer, product) sums, then one
    ``min_by`` per customer over the key (−revenue, code)."""
    per = (tx.filter(F.col("CustomerID").isNotNull())
           .groupBy("CustomerID", "StockCode")
           .agg(F.sum(money_units(F.col("TotalPrice"))).alias("_units")))
    best = per.groupBy("CustomerID").agg(
        F.min(F.struct((-F.col("_units")).alias("neg"), F.col("StockCode").alias("code")))
        .alias("b"))
    return best.select(F.col("CustomerID").alias("customer_id"),
                       F.col("b.code").alias("stock_code"),
                       (-F.col("b.neg") / 10000.0).alias("revenue"))
