"""Purchase propensity: leak-free snapshot features, a deterministic
stratified split, Spark ML models and exact evaluation metrics.

* features — conditional aggregates per (customer, invoice) and the distinct
  (customer, product) pairs, then ONE ``groupBy(CustomerID)`` over both;
  features see only rows ``<= cutoff``; the label is "bought in
  (cutoff, cutoff + horizon]"; customers with no history before the cutoff
  are excluded.
* split — per-class test share by the rank of md5(id ‖ seed) (exact class
  proportions, re-execution safe), ranks from ``functions.rank``.
* metrics — ROC-AUC from average ranks (Mann–Whitney), average precision as a
  step sum over distinct scores, Brier, quantile calibration bins — all from
  exact distributed ranks, no single-partition window, no binning
  approximation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.functions.money import money_units
from retailspark.functions.rank import SortKey, with_global_rank
from retailspark.functions.stats import exact_quantiles
from retailspark.operators import boosting
from retailspark.session import compact, on_workers

FEATURE_COLUMNS = ["recency_days", "frequency", "monetary", "tenure_days", "avg_order_value",
                   "avg_interpurchase_days", "distinct_products", "avg_basket_size",
                   "recency_over_tenure"]
LABEL_COLUMN = "label"
RANDOM_STATE = 42


def default_cutoff(tx: DataFrame, horizon_days: int = 90) -> Column:
    return tx.select(F.max("InvoiceDate") - F.expr(f"INTERVAL {int(horizon_days)} DAYS")).scalar()


def _days(a: Column, b: Column) -> Column:
    return F.timestamp_diff("DAY", a, b)


def build_training_table(tx: DataFrame, cutoff: Column, horizon_days: int = 90) -> DataFrame:
    d = F.col("InvoiceDate")
    past = d <= cutoff
    future = (d > cutoff) & (d <= cutoff + F.expr(f"INTERVAL {int(horizon_days)} DAYS"))
    # an invoice and a product count once for a customer: each has its own
    # grouping, so that no line is copied for every distinct count
    invoices = tx.groupBy("CustomerID", "InvoiceNo").agg(
        F.sum(F.when(past, money_units(F.col("TotalPrice")))).alias("_u"),
        F.min(F.when(past, d)).alias("_first"),
        F.max(F.when(past, d)).alias("_last"),
        F.count(F.when(past, F.lit(1))).alias("_lines"),
        F.max(F.when(future, F.lit(1)).otherwise(F.lit(0))).alias(LABEL_COLUMN))
    invoices = invoices.withColumn("_invoice", F.when(F.col("InvoiceNo").isNotNull() & (F.col("_lines") > 0), 1)).drop("InvoiceNo")
    products = tx.filter(past & F.col("StockCode").isNotNull()).select("CustomerID", "StockCode").distinct()
    products = products.select("CustomerID", F.lit(1).alias("_product"))
    g = invoices.unionByName(products, allowMissingColumns=True).groupBy("CustomerID").agg(
        F.count("_invoice").alias("frequency"),
        F.sum("_u").alias("_u"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.sum("_lines").alias("_lines"),
        F.count("_product").alias("distinct_products"),
        F.max(LABEL_COLUMN).alias(LABEL_COLUMN))
    g = g.filter(F.col("_lines") > 0)
    rec = _days(F.col("_last"), cutoff)
    ten = _days(F.col("_first"), cutoff)
    span = _days(F.col("_first"), F.col("_last"))
    monetary = F.col("_u") / 10000.0
    return g.select(
        "CustomerID",
        rec.cast("int").alias("recency_days"),
        "frequency",
        monetary.alias("monetary"),
        ten.cast("int").alias("tenure_days"),
        (monetary / F.col("frequency")).alias("avg_order_value"),
        F.when(F.col("frequency") > 1, span / (F.col("frequency") - 1))
         .otherwise(ten.cast("double")).alias("avg_interpurchase_days"),
        "distinct_products",
        (F.col("_lines") / F.col("frequency")).alias("avg_basket_size"),
        (rec / F.greatest(ten, F.lit(1))).alias("recency_over_tenure"),
        F.col(LABEL_COLUMN).cast("int").alias(LABEL_COLUMN))


def base_rate(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_customers"),
                     F.avg(LABEL_COLUMN).alias("positive_rate"))


def split_xy(table: DataFrame) -> DataFrame:
    return table.select("CustomerID", F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS])
                        .alias("features"), LABEL_COLUMN)


def train_test(table: DataFrame, test_size: float = 0.25, seed: int = RANDOM_STATE) -> DataFrame:
    """Adds ``is_test``: within each label class the ceil(test_size·n_class)
    rows with the smallest md5(id ‖ seed) form the test set."""
    h = F.md5(F.concat(F.col("CustomerID").cast("string"), F.lit(f"|{seed}")))
    keyed = table.withColumn("_h", h)
    counts = {r[0]: r[1] for r in keyed.groupBy(LABEL_COLUMN).count().collect()}  # ≤ 2 rows
    ranked = with_global_rank(keyed.select("CustomerID", LABEL_COLUMN, "_h"),
                              [SortKey(LABEL_COLUMN), SortKey("_h"), SortKey("CustomerID")], "_g")
    before, offsets, quota = 0, {}, {}
    for lab in sorted(counts):
        offsets[lab] = before
        quota[lab] = math.ceil(test_size * counts[lab])
        before += counts[lab]
    off = F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))])
    qmap = F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))])
    in_class = F.col("_g") - F.element_at(off, F.col(LABEL_COLUMN))
    flags = ranked.select("CustomerID", (in_class <= F.element_at(qmap, F.col(LABEL_COLUMN))).alias("is_test"))
    return table.join(flags, "CustomerID").select(*table.columns, "is_test")


# ------------------------------------------------------------------ models
def _standardise(train: DataFrame, other: list[DataFrame]):
    """Population z-scores fitted on the training rows (6·2 moments)."""
    m = train.agg(*[F.avg(c).alias(f"mu_{c}") for c in FEATURE_COLUMNS],
                  *[F.stddev_pop(c).alias(f"sd_{c}") for c in FEATURE_COLUMNS]).first()

    def tr(df):
        cols = []
        for c in FEATURE_COLUMNS:
            sd = m[f"sd_{c}"] or 0.0
            z = (F.col(c) - F.lit(m[f"mu_{c}"] or 0.0)) / F.lit(sd) if sd > 0 else F.lit(0.0)
            cols.append(z.alias(f"z_{c}"))
        return df.select("*", *cols)
    return tr(train), [tr(o) for o in other], m


def _assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


def fit_logistic(train: DataFrame, C: float = 1.0, max_iter: int = 1000):
    """Standardise (population std) + L2 logistic; sklearn's C·Σloss + ½‖w‖²
    equals Spark's mean loss + regParam·½‖w‖² with regParam = 1/(C·n)."""
    train = compact(train, "logistic_rows")
    n = train.count()
    ztrain, _, moments = _standardise(train, [])
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL_COLUMN, maxIter=max_iter,
                            regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
                            tol=1e-8)
    model = lr.fit(_assemble(ztrain, [f"z_{c}" for c in FEATURE_COLUMNS]))
    return {"kind": "logistic", "model": model, "moments": moments}


def fit_gbt(train: DataFrame, n_estimators: int = 300, learning_rate: float = 0.05,
            num_leaves: int = 31, subsample: float = 0.8, colsample: float = 0.8,
            seed: int = RANDOM_STATE, **params):
    """Leaf-wise boosted trees over histograms (``operators.boosting``), learned
    from all rows of ``train``."""
    model = boosting.fit(train.select("CustomerID", *FEATURE_COLUMNS, LABEL_COLUMN), FEATURE_COLUMNS, LABEL_COLUMN, "CustomerID",
                         n_estimators=n_estimators, learning_rate=learning_rate, num_leaves=num_leaves,
                         subsample=subsample, colsample=colsample, seed=seed, **params)
    return {"kind": "gbt", "model": model}


def predict_proba(fitted, df: DataFrame) -> DataFrame:
    """df ⊕ ``score`` (positive-class probability)."""
    if fitted["kind"] == "logistic":
        m = fitted["moments"]
        cols = []
        for c in FEATURE_COLUMNS:
            sd = m[f"sd_{c}"] or 0.0
            z = (F.col(c) - F.lit(m[f"mu_{c}"] or 0.0)) / F.lit(sd) if sd > 0 else F.lit(0.0)
            cols.append(z.alias(f"z_{c}"))
        vec = _assemble(df.select("*", *cols), [f"z_{c}" for c in FEATURE_COLUMNS])
    else:
        return boosting.scored(fitted["model"], df, FEATURE_COLUMNS)
    out = fitted["model"].transform(vec)
    return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


# ------------------------------------------------------------------ metrics
def roc_auc(scored: DataFrame, score: str = "score", label: str = LABEL_COLUMN,
            id_col: str = "CustomerID") -> DataFrame:
    """Mann–Whitney AUC with average ranks for tied scores."""
    r = with_global_rank(scored.select(score, label, id_col), [SortKey(score), SortKey(id_col)], "_r")
    per = r.groupBy(score).agg(((F.min("_r") + F.max("_r")) / 2.0).alias("avg_rank"),
                               F.sum(label).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    return per.agg(
        ((F.sum(F.col("avg_rank") * F.col("pos")) - F.sum("pos") * (F.sum("pos") + 1) / 2.0)
         / (F.sum("pos") * (F.sum("cnt") - F.sum("pos")))).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = LABEL_COLUMN,
                      id_col: str = "CustomerID") -> DataFrame:
    """AP = Σ over distinct thresholds (ΔTP / P) · precision.  The scores are
    ranked (and so written) once; positives are ranked from that table."""
    r_all = with_global_rank(scored.select(score, label, id_col), [SortKey(score, False), SortKey(id_col)], "_ra")
    at = r_all.groupBy(score).agg(F.max("_ra").alias("n_at"), F.sum(label).alias("pos_at"))
    pos = r_all.filter(F.col(label) == 1).select(score, id_col)
    r_pos = with_global_rank(pos, [SortKey(score, False), SortKey(id_col)], "_rp")
    n_pos = r_pos.count()
    tp = r_pos.groupBy(score).agg(F.max("_rp").alias("tp_at"))
    j = at.join(tp, score)
    return j.agg((F.sum(F.col("pos_at") / F.lit(float(n_pos or 1)) * (F.col("tp_at") / F.col("n_at"))))
                 .alias("pr_auc"))


def brier(scored: DataFrame, score: str = "score", label: str = LABEL_COLUMN) -> DataFrame:
    e = F.col(score) - F.col(label)
    return scored.agg(F.avg(e * e).alias("brier"), F.avg(label).alias("base_rate"),
                      F.count(F.lit(1)).alias("n_test"))


def calibration_table(scored: DataFrame, n_bins: int = 10, score: str = "score",
                      label: str = LABEL_COLUMN) -> DataFrame:
    """Quantile bins: edges = linear percentiles of the scores; bin = number
    of inner edges strictly below the score; empty bins dropped."""
    probs = [i / n_bins for i in range(1, n_bins)]
    q = exact_quantiles(scored, score, probs).first()
    inner = [q[f"q{i}"] for i in range(len(probs))]
    b = sum((F.col(score) > F.lit(e)).cast("int") for e in inner) if inner else F.lit(0)
    return (scored.groupBy(b.alias("bin"))
            .agg(F.avg(score).alias("mean_predicted"), F.avg(label).alias("fraction_positive"))
            .orderBy("bin"))


def linear_attribution(fitted, df: DataFrame) -> DataFrame:
    """Mean |w_j · (z_j − mean z_j)| per feature for the logistic model
    (exact linear Shapley values), descending."""
    w = fitted["model"].coefficients.toArray()
    m = fitted["moments"]
    z = []
    for c in FEATURE_COLUMNS:
        sd = m[f"sd_{c}"] or 0.0
        z.append(((F.col(c) - F.lit(m[f"mu_{c}"] or 0.0)) / F.lit(sd)) if sd > 0 else F.lit(0.0))
    zdf = df.select(*[zc.alias(f"z{i}") for i, zc in enumerate(z)])
    means = zdf.agg(*[F.avg(f"z{i}").alias(f"m{i}") for i in range(len(z))]).first()
    one = zdf.agg(*[F.avg(F.abs(F.lit(float(w[i])) * (F.col(f"z{i}") - F.lit(means[f"m{i}"]))))
                    .alias(f"a{i}") for i in range(len(z))])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs_attribution"))
                    for i, c in enumerate(FEATURE_COLUMNS)])
    return one.select(F.inline(arr)).orderBy(F.desc("mean_abs_attribution"), "feature")


# ------------------------------------------------------------------ tree attribution
class Leaf:
    """A leaf of one boosted tree: its weighted value and, for each feature on
    its path, the interval (low, high] that leads to it and the share of
    training rows that goes its way at the splits on that feature."""

    def __init__(self, value: float, rules: dict[int, tuple[float, float, float]]):
        self.value = value
        self.features = list(rules)
        self.low, self.high, self.share = (np.array([r[i] for r in rules.values()]) for i in range(3))


def tree_leaves(fitted) -> list[Leaf]:
    """All leaves of a fitted boosted-tree model.  The base margin is a leaf
    without rules."""
    out = [Leaf(fitted["model"].base, {})]
    for tree in fitted["model"].trees:
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            node, rules = todo.pop()
            j, at = tree.feature[node], tree.at[node]
            if j < 0:
                out.append(Leaf(tree.value[node], rules))
                continue
            low, high, share = rules.get(j, (-math.inf, math.inf, 1.0))
            for child, span in ((tree.left[node], (low, min(high, at))), (tree.right[node], (max(low, at), high))):
                todo.append((child, rules | {j: (*span, share * tree.rows[child] / tree.rows[node])}))
    return out


def shapley(leaves: list[Leaf], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, rows x features): exact Shapley values of the model's margin under
    the path-dependent expectation.  A leaf is a product over its features of
    "goes there" (known) or the training share (unknown), so each feature's
    value is a weighted sum over the sizes of the known sets, from the
    coefficients of a polynomial of degree at most the depth of the tree."""
    base, out = 0.0, np.zeros(x.shape)
    for leaf in leaves:
        base += leaf.value * float(np.prod(leaf.share))
        k = len(leaf.features)
        if not k:
            continue
        at = x[:, leaf.features]
        there = ((at > leaf.low) & (at <= leaf.high)).astype(float)
        weight = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
        for i, j in enumerate(leaf.features):
            coef = [np.ones(len(x))]
            for m in range(k):
                if m != i:
                    stay = [c * leaf.share[m] for c in coef] + [0.0]
                    step = [0.0] + [c * there[:, m] for c in coef]
                    coef = [a + b for a, b in zip(stay, step)]
            out[:, j] += leaf.value * (there[:, i] - leaf.share[i]) * sum(w * c for w, c in zip(weight, coef))
    return base, out


def tree_attribution_rows(fitted, df: DataFrame) -> DataFrame:
    """CustomerID, base, attributions (array by FEATURE_COLUMNS): base + their
    sum is the margin.  The leaves go to the tasks once; rows stay distributed."""
    leaves = df.sparkSession.sparkContext.broadcast(tree_leaves(fitted))  # a model of fixed size

    def run(batches):
        for pdf in batches:
            base, values = shapley(leaves.value, pdf[FEATURE_COLUMNS].to_numpy(dtype=float))
            yield pd.DataFrame({"CustomerID": pdf["CustomerID"], "base": base, "attributions": list(values)})

    cols = [F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS]
    return on_workers(df.select("CustomerID", *cols)).mapInPandas(run, "CustomerID string, base double, attributions array<double>")


def tree_attribution(fitted, df: DataFrame) -> DataFrame:
    """Mean absolute attribution of each feature over ``df``, descending."""
    rows = tree_attribution_rows(fitted, df)
    one = rows.agg(*[F.avg(F.abs(F.col("attributions")[i])).alias(f"a{i}") for i in range(len(FEATURE_COLUMNS))])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs_attribution"))
                    for i, c in enumerate(FEATURE_COLUMNS)])
    return one.select(F.inline(arr)).orderBy(F.desc("mean_abs_attribution"), "feature")
