"""RFM features and rule-based segmentation.

* ``compute_rfm`` — one ``groupBy(CustomerID)`` with partial aggregation.
* scores — 1..5 quantile bins of an *exact* global rank (pandas
  ``rank(method="first")`` + ``qcut``), NOT ``ntile``: bin = ceil((rank-1)·5/(n-1)).
  Ties are broken by CustomerID, ascending, for F, M and reversed R alike.
* segment / action — literal map lookups on the (R, FM) grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.functions.labels import action_of, segment_of
from retailspark.functions.money import SCALE, money_units
from retailspark.functions.rank import SortKey, with_global_rank

N_BINS = 5


def snapshot_date(tx: DataFrame) -> Column:
    """max(InvoiceDate) + 1 day, as an uncorrelated scalar subquery (runs once,
    its single value is inlined into the consuming plan)."""
    return tx.select(F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).scalar()


def floor_days(start: Column, end: Column) -> Column:
    """Whole days between two timestamps, flooring the exact gap
    (``datediff`` would compare calendar dates instead)."""
    return F.timestamp_diff("DAY", start, end).cast("int")


def customer_totals(tx: DataFrame) -> DataFrame:
    """CustomerID, _u (money units), n_orders (distinct invoices), first and
    last purchase: what RFM and the historical value both start from."""
    return tx.groupBy("CustomerID").agg(
        F.sum(money_units(F.col("TotalPrice"))).alias("_u"),
        F.count_distinct("InvoiceNo").alias("n_orders"),
        F.min("InvoiceDate").alias("first_purchase"),
        F.max("InvoiceDate").alias("last_purchase"))


def compute_rfm(tx: DataFrame, snapshot: Column | None = None, totals: DataFrame | None = None) -> DataFrame:
    """CustomerID, Recency (int days), Frequency (distinct invoices), Monetary.
    ``totals``: the ``customer_totals`` of ``tx``, if they are at hand."""
    snap = snapshot if snapshot is not None else snapshot_date(tx)
    g = customer_totals(tx) if totals is None else totals
    return g.select("CustomerID", floor_days(F.col("last_purchase"), snap).alias("Recency"),
                    F.col("n_orders").alias("Frequency"), (F.col("_u") / float(SCALE)).alias("Monetary"))


def quantile_bin(rank: Column, n: Column, n_bins: int = N_BINS) -> Column:
    """qcut of ranks 1..n into n_bins equal-width rank intervals."""
    rank, n = rank.cast("bigint"), n.cast("bigint")
    b = F.floor(((rank - 1) * n_bins + (n - 2)) / (n - 1))
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), b)).cast("int")


def score_rfm(rfm: DataFrame, n_bins: int = N_BINS, partitions: int | None = None) -> DataFrame:
    """Add R, F, M, FM, RFM_Score, Segment, Action.  The three ranks are made
    from narrow (key, id) frames and joined on the id."""
    df = rfm
    for column, ascending, rank in (("Recency", False, "_rr"), ("Frequency", True, "_rf"),
                                    ("Monetary", True, "_rm")):
        narrow = rfm.select("CustomerID", column)
        ranked = with_global_rank(narrow, [SortKey(column, ascending), SortKey("CustomerID")], rank, partitions)
        df = df.join(ranked.select("CustomerID", rank), "CustomerID")
    nn = F.lit(rfm.count()).cast("bigint")
    fm = F.bround((F.col("F") + F.col("M")) / 2.0, 0)
    out = (df.withColumn("R", quantile_bin(F.col("_rr"), nn, n_bins))
           .withColumn("F", quantile_bin(F.col("_rf"), nn, n_bins))
           .withColumn("M", quantile_bin(F.col("_rm"), nn, n_bins))
           .withColumn("FM", F.least(F.lit(n_bins), F.greatest(F.lit(1), fm)).cast("int"))
           .drop("_rr", "_rf", "_rm"))
    return (out.withColumn("RFM_Score", F.concat(F.col("R").cast("string"), F.col("F").cast("string"),
                                                 F.col("M").cast("string")))
            .withColumn("Segment", segment_of(F.col("R"), F.col("FM")))
            .withColumn("Action", action_of(F.col("Segment"))))


def share_of_total(units: str) -> Column:
    """Exact share: integer money units over their total (window over a small,
    already-aggregated frame)."""
    return F.col(units) / F.sum(units).over(Window.partitionBy())


def summarize_segments(scored: DataFrame, key: str = "Segment",
                       order: str = "total_revenue") -> DataFrame:
    """Per segment (≤ 11 rows): size, mean R/F/M, revenue and both shares."""
    g = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("Recency").alias("avg_recency"),
        F.avg("Frequency").alias("avg_frequency"),
        F.sum(money_units(F.col("Monetary"))).alias("_units"))
    return (g.select(
        key, "customers", "avg_recency", "avg_frequency",
        (F.col("_units") / 10000.0 / F.col("customers")).alias("avg_monetary"),
        (F.col("_units") / 10000.0).alias("total_revenue"),
        share_of_total("customers").alias("customer_share"),
        share_of_total("_units").alias("revenue_share"))
        .orderBy(F.desc(order), key))


def segment_actions(scored: DataFrame) -> DataFrame:
    return scored.select("Segment", "Action").distinct().orderBy("Segment")
