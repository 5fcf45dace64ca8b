"""Money arithmetic.

Floating-point sums depend on summation order, which differs between tasks
and engines.  Money is therefore summed as an exact 64-bit integer count of
1/10,000 units (``floor(x*1e4 + 0.5)``, plain arithmetic inside codegen) and
converted back to double once.  The SQL text twin is ``money_sum_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10000


def money_units(c: Column) -> Column:
    return F.floor(c * SCALE + 0.5).cast("bigint")


def money_sum(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(money_units(c)) / float(SCALE)


def money_avg(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(money_units(c)) / float(SCALE) / F.count(c)


def money_sum_sql(expr: str) -> str:
    return f"(SUM(CAST(floor(({expr}) * 10000 + 0.5) AS BIGINT)) / 10000.0)"


def money_avg_sql(expr: str) -> str:
    return f"(SUM(CAST(floor(({expr}) * 10000 + 0.5) AS BIGINT)) / 10000.0 / COUNT({expr}))"
