"""K-means over log-scaled, standardised RFM (Spark ML).

* features: log1p(R, F, M), standardised with the **population** std
  (Spark's StandardScaler uses the sample std) — the 6 moments come from one
  global aggregate; scaling is a projection.
* fit: Lloyd's algorithm with k-means++ seeding, best of ``n_init`` seeds
  by within-cluster sum of squares; all (k, seed) models of the sweep are
  fitted together, one pass over the data per iteration
  (``kmeans_batch``).
* silhouette: Spark's ``ClusteringEvaluator`` (squared Euclidean), exact and
  O(n·k) via per-cluster sums.  The plain-Euclidean silhouette has no such
  decomposition — it needs every pair of points — so it is not built.
* profile / names: groupBy cluster (k rows), medians across the k rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailspark.functions.money import money_units
from retailspark.operators.kmeans_batch import assign, fit_many

RANDOM_STATE = 42
N_INIT = 10
RFM_COLUMNS = ["Recency", "Frequency", "Monetary"]
K_RANGE = range(2, 11)


def scaled_features(rfm: DataFrame, id_col: str = "CustomerID") -> DataFrame:
    """id, z_Recency, z_Frequency, z_Monetary (log1p then population z-score)."""
    logged = rfm.select(id_col, *[F.log1p(F.col(c)).alias(c) for c in RFM_COLUMNS])
    m = logged.agg(*[F.avg(c).alias(f"mu_{c}") for c in RFM_COLUMNS],
                   *[F.stddev_pop(c).alias(f"sd_{c}") for c in RFM_COLUMNS]).first()
    cols = []
    for c in RFM_COLUMNS:
        sd = m[f"sd_{c}"] or 0.0
        z = (F.col(c) - F.lit(m[f"mu_{c}"])) / F.lit(sd) if sd > 0 else F.lit(0.0)
        cols.append(z.alias(f"z_{c}"))
    return logged.select(id_col, *cols)


def _vectors(feat: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"z_{c}" for c in RFM_COLUMNS], outputCol="features") \
        .transform(feat)


FEATURES = [f"z_{c}" for c in RFM_COLUMNS]


def fit_kmeans(feat: DataFrame, k: int, seed: int = RANDOM_STATE, n_init: int = N_INIT):
    """Best of n_init seeded fits (min within-cluster sum of squares):
    (centres, cost)."""
    cen, cost = fit_many(feat, "CustomerID", FEATURES, [(k, seed + i) for i in range(n_init)])
    b = int(np.argmin(cost))
    return cen[b], float(cost[b])


def silhouette(pred: DataFrame, label_col: str = "Cluster") -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol=label_col,
                               metricName="silhouette",
                               distanceMeasure="squaredEuclidean").evaluate(pred)


def sweep(feat: DataFrame, k_values=K_RANGE, seed: int = RANDOM_STATE, n_init: int = N_INIT):
    """Every (k, seed) model of the sweep is fitted together (one pass over
    the features per Lloyd iteration for all of them); per k the
    lowest-cost model is kept and scored.
    Returns ([(k, inertia, silhouette)], {k: centres})."""
    ks = list(k_values)
    tasks = [(k, seed + i) for k in ks for i in range(n_init)]
    cen, cost = fit_many(feat, "CustomerID", FEATURES, tasks)
    best = {}
    for (k, _), c, v in zip(tasks, cen, cost):
        if k not in best or v < best[k][1]:
            best[k] = (c, float(v))
    rows = []
    for k in ks:
        labelled = _vectors(assign(feat, FEATURES, best[k][0]))
        rows.append((int(k), best[k][1], float(silhouette(labelled)) if len(best[k][0]) else None))  # no rows: no silhouette
    return rows, {k: c for k, (c, _) in best.items()}


def evaluate_k_range(spark: SparkSession, feat: DataFrame, k_values=K_RANGE) -> DataFrame:
    rows, _ = sweep(feat, k_values)
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def choose_k(metrics: DataFrame, k_min: int = 3, k_max: int = 8) -> DataFrame:
    """Best silhouette within [k_min, k_max]; ties → smaller k."""
    return (metrics.filter((F.col("k") >= k_min) & (F.col("k") <= k_max))
            .orderBy(F.desc("silhouette"), "k").limit(1).select("k"))


def profile_clusters(df: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    g = df.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("Recency").alias("avg_recency"),
        F.avg("Frequency").alias("avg_frequency"),
        (F.sum(money_units(F.col("Monetary"))) / 10000.0 / F.count(F.lit(1))).alias("avg_monetary"),
        F.sum(money_units(F.col("Monetary"))).alias("_u"))
    w = Window.partitionBy()  # over k aggregated rows
    return g.select(cluster_col, "customers", "avg_recency", "avg_frequency", "avg_monetary",
                    (F.col("_u") / 10000.0).alias("total_revenue"),
                    (F.col("customers") / F.sum("customers").over(w)).alias("customer_share"),
                    (F.col("_u") / F.sum("_u").over(w)).alias("revenue_share"))


# fixed values: cluster labels by (mean spend at or above the median of the
# clusters, mean recency at or below it, mean frequency at or above it)
CLUSTER_NAMES = {
    (True, True, True): "High-Value Active",
    (True, True, False): "High-Value Active",
    (True, False, True): "High-Value Lapsing",
    (True, False, False): "High-Value Lapsing",
    (False, True, True): "Engaged Mid-Value",
    (False, True, False): "Recent Low-Value",
    (False, False, True): "Dormant Low-Value",
    (False, False, False): "Dormant Low-Value",
}


def name_clusters(profile: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """Cluster → ClusterName, looked up in ``CLUSTER_NAMES``; the medians are
    taken over the k profile rows."""
    names = profile.sparkSession.createDataFrame(
        [(*flags, name) for flags, name in CLUSTER_NAMES.items()],
        "_spends boolean, _recent boolean, _often boolean, ClusterName string")
    over = Window.partitionBy()
    placed = profile.select(
        cluster_col,
        (F.col("avg_monetary") >= F.median("avg_monetary").over(over)).alias("_spends"),
        (F.col("avg_recency") <= F.median("avg_recency").over(over)).alias("_recent"),
        (F.col("avg_frequency") >= F.median("avg_frequency").over(over)).alias("_often"))
    return placed.join(F.broadcast(names), ["_spends", "_recent", "_often"]).select(cluster_col, "ClusterName")  # 8 rows


def attach_clusters(spark: SparkSession, scored: DataFrame, feat: DataFrame | None = None,
                    swept=None, k: int | None = None) -> DataFrame:
    """scored ⊕ Cluster ⊕ ClusterName (k chosen by the silhouette sweep;
    ``swept`` = a precomputed ``sweep`` result)."""
    feat = feat if feat is not None else scaled_features(scored).cache()
    if k is None:
        rows, best = swept if swept is not None else sweep(feat)
        k = choose_k(spark.createDataFrame(rows, "k int, inertia double, silhouette double")).first()["k"]
        centers = best[k]
    else:
        centers, _ = fit_kmeans(feat, k)
    labels = assign(feat, FEATURES, centers).select("CustomerID", "Cluster")
    with_c = scored.join(labels, "CustomerID")
    names = name_clusters(profile_clusters(with_c))
    return with_c.join(F.broadcast(names), "Cluster")  # ≤ 10 rows
