"""Distribution statistics that stay exact at scale.

``percentile`` as an aggregate keeps every distinct value of a group in one
buffer; for a *global* describe over billions of invoices that is one task
holding everything.  Global quantiles are found by counting instead
(`functions.selection`) and interpolated linearly (pandas/NumPy "linear"
definition: h = (n-1)·p); medians of many groups use the distributed exact
rank (`functions.rank`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.functions.money import money_units
from retailspark.functions.rank import SortKey, with_global_rank
from retailspark.functions.selection import quantiles
from retailspark.session import stored

DESCRIBE_PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.99)


def _pct_label(p: float) -> str:
    s = f"{p * 100:.10g}"
    return f"{s}%"


def exact_quantiles(values: DataFrame, value_col: str, probs) -> DataFrame:
    """One row: column ``q{i}`` = linear-interpolated quantile probs[i] of the
    values that are not NULL; NULL if there are none."""
    probs = list(probs)
    rows = stored(values.select(value_col), "values")
    v = F.col(value_col)
    one = rows.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    found = quantiles(rows, value_col, probs, one["n"], one["low"], one["high"]) if one["n"] else [None] * len(probs)
    schema = ", ".join(f"q{i} double" for i in range(len(probs)))
    return values.sparkSession.createDataFrame([tuple(found)], schema)


def describe(values: DataFrame, value_col: str, out_col: str,
             percentiles=DESCRIBE_PERCENTILES) -> DataFrame:
    """pandas ``Series.describe`` of a money column as (stat, value) rows:
    count, mean (exact), std (sample, 6 dp), min, percentiles, max.  One
    aggregation over the written values, then the counting passes."""
    rows = stored(values.select(value_col), "values")
    v = F.col(value_col)
    one = rows.agg(F.count(v).alias("n"), (F.sum(money_units(v)) / 10000.0 / F.count(v)).alias("mean"),
                   F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    found = quantiles(rows, value_col, percentiles, one["n"], one["low"], one["high"]) if one["n"] else \
        [None] * len(percentiles)
    stats = ([("count", float(one["n"])), ("mean", one["mean"]), ("std", one["std"]), ("min", one["low"])]
             + [(_pct_label(p), q) for p, q in zip(percentiles, found)] + [("max", one["high"])])
    return values.sparkSession.createDataFrame([(i, name, x) for i, (name, x) in enumerate(stats)],
                                               f"stat_no int, stat string, {out_col} double")


def group_medians(df: DataFrame, group: str, value_col: str, tie_col: str, out: str) -> DataFrame:
    """Median of each group's non-NULL values (the mean of the middle two),
    from exact ranks over (group, value): no group's values meet in one buffer.
    A group without a value has the median NULL."""
    rows = df.filter(F.col(value_col).isNotNull()).select(group, value_col, tie_col)
    ranked = with_global_rank(rows, [SortKey(group), SortKey(value_col), SortKey(tie_col)], "_r")
    spans = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    mid = F.col("_lo") + F.col("_hi")  # twice the middle rank
    hit = ranked.join(spans, F.col(group).eqNullSafe(F.col("_g"))).filter(
        (F.col("_r") == F.floor(mid / 2)) | (F.col("_r") == F.ceil(mid / 2)))
    found = hit.groupBy("_g").agg(F.avg(value_col).alias(out))
    return df.select(group).distinct().join(found, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, out)
