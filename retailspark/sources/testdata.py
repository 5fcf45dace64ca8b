"""Adapter views over the driver's TPC-H-like tables.

``retail_raw`` projects lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation onto the
raw retail schema.  Every expression is a deterministic function of the
input row so the identical view can be written in DuckDB SQL for the oracles
(`retailspark.plans.oracles`).  The rules were chosen so every cleaning rule
fires (FIXTURES.md §B).

Scale notes: lines meet their part, then their order (shuffle on the order
key), whose buyer's columns are joined before that; part / customer / nation are dimension tables that AQE broadcasts only
when their *measured* size is under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stock_code(partkey: Column) -> Column:
    s = partkey.cast("string")
    padded = F.when(F.length(s) >= 5, s).otherwise(F.lpad(s, 5, "0"))
    suffix = (F.when(partkey % 3 == 0, F.lit("A"))
              .when(partkey % 3 == 1, F.lit(""))
              .otherwise(F.lit("BL")))
    return F.when(partkey % 97 == 0, F.lit("POST")).otherwise(F.concat(padded, suffix))


def retail_raw(spark: SparkSession, sf_dir: str, partitions: int | None = None, order_col: str | None = None) -> DataFrame:
    """Raw line items (schema of ``sources.retail.RAW_SCHEMA``).  ``partitions``:
    tasks that lines and orders meet in (default: Spark's choice).
    ``order_col``: name of a further column with the order key, by which the
    rows lie together then."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # what an order says of all its lines is worked out before it meets them
    ts = F.timestamp_add("MINUTE", (F.col("o_orderkey") * 37) % 1440, F.col("o_orderdate"))
    bought = (od.join(cu, od.o_custkey == cu.c_custkey, "left")
              .join(na, cu.c_nationkey == na.n_nationkey, "left")
              .select("o_orderkey", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("_date"),
                      F.when(F.col("o_custkey") % 11 == 0, F.lit(None).cast("string"))
                       .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("_buyer"),
                      "n_name"))
    # the part comes first: after the orders the lines need not move any more
    sold = li.join(pt, li.l_partkey == pt.p_partkey)
    if partitions:
        sold, bought = sold.repartition(partitions, "l_orderkey"), bought.repartition(partitions, "o_orderkey")
    j = sold.join(bought, sold.l_orderkey == bought.o_orderkey)
    qty = F.col("l_quantity").cast("bigint")
    raw = j.select(
        F.concat(F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 10 == 0),
                        F.lit("C")).otherwise(F.lit("")),
                 F.col("l_orderkey").cast("string")).alias("Invoice"),
        _stock_code(F.col("l_partkey")).alias("StockCode"),
        F.when(F.col("l_partkey") % 41 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("Description"),
        F.when(F.col("l_linenumber") == 7, -qty).otherwise(qty).alias("Quantity"),
        F.col("_date").alias("InvoiceDate"),
        F.when(F.col("l_partkey") % 53 == 0, F.lit(0.0))
         .otherwise(F.col("p_retailprice")).alias("Price"),
        F.col("_buyer").alias("Customer ID"),
        F.col("n_name").alias("Country"),
        *([F.col("l_orderkey").alias(order_col)] if order_col else []),
        # some lines occur twice; one pass emits the copies
        F.explode(F.array_repeat(F.lit(1), F.when((F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1), 2)
                                 .otherwise(1))).alias("_copy"),
    )
    return raw.drop("_copy")


def purchase_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from ``events``: several a day, with time of day."""
    ev = table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type") == "purchase")
            .select(F.col("user_id").cast("string").alias("CustomerID"),
                    F.col("event_id").cast("string").alias("InvoiceNo"),
                    F.col("ts").cast("timestamp_ntz").alias("InvoiceDate"),
                    F.col("value").alias("TotalPrice")))


def nation_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the buyer's nation as the customer: very heavy buyers."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return od.join(cu, od.o_custkey == cu.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("CustomerID"),
        F.col("o_orderkey").cast("string").alias("InvoiceNo"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("InvoiceDate"),
        F.col("o_totalprice").alias("TotalPrice"))


def basket_items(spark: SparkSession, sf_dir: str, attr: str = "p_type") -> DataFrame:
    """Distinct ``basket_lines``."""
    return basket_lines(spark, sf_dir, attr).distinct()


def basket_lines(spark: SparkSession, sf_dir: str, attr: str = "p_type") -> DataFrame:
    """(InvoiceNo, StockCode) of each line, with an order as basket and a part
    attribute as item (``p_type`` gives frequent triples, ``p_brand`` many pairs)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pt = table(spark, sf_dir, "part").select("p_partkey", attr)
    return (li.join(pt, li.l_partkey == pt.p_partkey)
            .select(F.col("l_orderkey").cast("string").alias("InvoiceNo"),
                    F.col(attr).alias("StockCode")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: user → human, assistant → ai, any other role as it is."""
    cv = table(spark, sf_dir, "conversations")
    role = F.col("role")
    return cv.select(
        F.col("conv_id").cast("string").alias("thread_id"),
        F.col("turn"),
        F.when(role == "user", F.lit("human")).when(role == "assistant", F.lit("ai")).otherwise(role).alias("role"),
        F.col("text").alias("content"))


#: The countries that the 25 nations of the test tables stand for, by n_nationkey.
COUNTRIES = ("United Kingdom", "EIRE", "Netherlands", "Germany", "France", "Australia", "Spain", "Switzerland",
             "Sweden", "Denmark", "Belgium", "Portugal", "Japan", "Norway", "Italy", "Finland", "Cyprus",
             "Austria", "Greece", "Singapore", "Unspecified", "European Community", "USA", "Canada", "Brazil")


def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_name → country (25 rows)."""
    names = F.array(*[F.lit(c) for c in COUNTRIES])
    na = table(spark, sf_dir, "nation")
    return na.select(F.col("n_name").alias("country"), F.element_at(names, (F.col("n_nationkey") % 25 + 1).cast("int")).alias("name"))


def decision_log(spark: SparkSession, sf_dir: str, approvals: int) -> DataFrame:
    """A review log from ``orders``: each order is one decision on approval
    (o_custkey mod ``approvals``); it leaves out its own customer and gives the
    next one 5 %."""
    od = table(spark, sf_dir, "orders")
    act = F.col("o_orderkey") % 5
    return od.select(
        (F.col("o_custkey") % approvals).alias("approval_id"),
        F.when(act == 0, "approved").when(act == 1, "rejected").otherwise("revised").alias("action"),
        F.concat(F.lit("r"), (F.col("o_orderkey") % 7).cast("string")).alias("reviewer"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("review_note"),
        F.timestamp_add("MINUTE", F.col("o_orderkey") % 1440, F.col("o_orderdate").cast("timestamp_ntz")).alias("decided_at"),
        F.array(F.col("o_custkey").cast("string")).alias("excluded"),
        F.create_map((F.col("o_custkey") + 1).cast("string"), F.lit(0.05)).alias("overrides"))
