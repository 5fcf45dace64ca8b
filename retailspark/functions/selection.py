"""Exact order statistics by counting, without sorting.

``order_statistics`` finds the values at given ranks of a column that may have
any number of rows.  A pass counts the rows of each of ``buckets`` equal slices
of the range that is left around a rank, with the least and the greatest value
of each slice; the slice in which the rank falls, from its least to its
greatest value, is the range of the next pass.  All ranks share the passes.  A
range of one value is that rank's answer, so ties of any size end at once.

Nothing is ordered, range-partitioned or written, and no buffer grows with the
rows: a task holds ``buckets`` counters a range, and so many rows come to the
driver.  Each pass narrows a range at least by the factor ``buckets``; a slice
of few values ends sooner, as it is cut at values that occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


@dataclass(frozen=True)
class Span:
    """The values from ``low`` to ``high``, of which ``before`` rows come first,
    and the (0-based) ranks that fall there."""

    low: float
    high: float
    before: int
    ranks: tuple[int, ...]

    def holds(self, value: Column) -> Column:
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    def bucket(self, value: Column, buckets: int) -> Column:
        """Rises with the value; the least one has 0 and the greatest the last."""
        part = (value - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.least(F.floor(part * F.lit(float(buckets))), F.lit(buckets - 1)).cast("int")


def _narrowed(span: Span, counted: list) -> list[Span]:
    """The spans of the next pass, from one span's (bucket, n, low, high) rows."""
    out, before, ranks = [], span.before, list(span.ranks)
    for row in sorted(counted, key=lambda r: r["bucket"]):
        inside = tuple(r for r in ranks if before <= r < before + row["n"])
        if inside:
            out.append(Span(row["low"], row["high"], before, inside))
        before += row["n"]
    return out


def order_statistics(values: DataFrame, column: str, ranks: Iterable[int], low: float, high: float,
                     buckets: int = BUCKETS) -> dict[int, float]:
    """{rank: value} for 0-based ``ranks`` in ascending order of ``column``.

    NULLs have no rank.  ``low`` and ``high`` are the column's least and
    greatest value; all are finite.  Every pass reads ``values``: have it
    written or cached if it is costly.  A rank outside the rows is an error.
    """
    wanted = tuple(sorted(set(ranks)))
    if not wanted:
        return {}
    if not (math.isfinite(low) and math.isfinite(high) and math.isfinite(high - low)):
        raise ValueError(f"order statistics of {column} need finite values, its range is {low} to {high}")
    value = F.col(column).cast("double")
    found: dict[int, float] = {}
    live = [Span(float(low), float(high), 0, wanted)]
    while True:
        found |= {r: s.low for s in live if s.low == s.high for r in s.ranks}
        live = [s for s in live if s.low < s.high]
        if not live:
            break
        span = F.coalesce(*[F.when(s.holds(value), F.lit(i)) for i, s in enumerate(live)])
        bucket = F.coalesce(*[F.when(s.holds(value), s.bucket(value, buckets)) for s in live])
        counted = (values.select(span.alias("span"), bucket.alias("bucket"), value.alias("value"))
                   .filter(F.col("span").isNotNull()).groupBy("span", "bucket")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
                   .collect())  # at most ``buckets`` rows a span, a span a rank
        live = [n for i, s in enumerate(live) for n in _narrowed(s, [r for r in counted if r["span"] == i])]
    if missing := [r for r in wanted if r not in found]:
        raise ValueError(f"no rows at ranks {missing} of {column}")
    return found


def quantiles(values: DataFrame, column: str, probs: Iterable[float], n: int, low: float, high: float) -> list[float]:
    """Linear-interpolated quantiles (position (n - 1) p) of the ``n`` values of
    ``column`` that are not NULL."""
    probs = list(probs)
    at = [((n - 1) * p, int((n - 1) * p)) for p in probs]
    found = order_statistics(values, column, {r for _, i in at for r in (i, min(i + 1, n - 1))}, low, high)
    return [found[i] + (h - i) * (found[min(i + 1, n - 1)] - found[i]) for h, i in at]
