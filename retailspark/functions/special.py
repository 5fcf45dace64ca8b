"""Gauss hypergeometric series as native Column expressions (no Python worker).

``hyp2f1_many`` sums ₂F₁(a, b; c; z_i) for several z that share a, b, c in one
pass over the series.  How many terms it takes is never guessed:
``terms_needed`` runs the scalar series on the driver at the worst case and
returns the length at which the rest is below a tolerance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
TOLERANCE = 1e-15


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def terms_needed(a: float, b: float, c: float, z: float, tol: float = TOLERANCE,
                 most: int = 1_000_000) -> int:
    """Terms after which the rest of the series is below ``tol`` of the sum,
    for 0 ≤ z < 1.  From there on the ratio of terms tends to z from either
    side, so the rest is bounded by a geometric series of the larger of the
    last ratio and z.  A larger c (a, b ≥ −1 fixed) needs no more terms."""
    if not 0 <= z < 1:
        raise ValueError(f"the series needs 0 <= z < 1, got {z}")
    t = s = 1.0
    for n in range(most):
        if c + n == 0:
            return n + 2
        ratio = (a + n) * (b + n) / ((c + n) * (n + 1)) * z
        t *= ratio
        s += t
        bound = max(abs(ratio), z)
        # the signs of a + n and b + n must have settled
        if n > abs(a) + abs(b) and bound < 1 and abs(t) * bound / (1 - bound) <= tol * max(abs(s), 1.0):
            return n + 2
    raise ValueError(f"2F1({a}, {b}; {c}; {z}) does not converge within {most} terms")


def hyp2f1_many(a, b, c, zs: list, n_terms: int) -> Column:
    """Struct s0, s1, ... of ₂F₁(a, b; c; z_i), ``n_terms`` terms each.  A pole
    (c + n = 0) gives NULL, which callers treat like NaN."""
    a, b, c = _c(a), _c(b), _c(c)
    zs = [_c(z) for z in zs]

    def ratio(nd):
        return F.try_divide((a + nd) * (b + nd), (c + nd) * (nd + 1.0))

    # A step reads the term and the ratio that the step before left: written
    # out, they would be worked out anew for every sum and every z.
    init = F.struct(ratio(F.lit(0.0)).alias("r"), *[F.lit(1.0).alias(f"t{i}") for i in range(len(zs))],
                    *[F.lit(0.0).alias(f"s{i}") for i in range(len(zs))])

    def step(acc, n):
        return F.struct(ratio(n.cast("double") + 1.0).alias("r"),
                        *[(acc[f"t{i}"] * acc["r"] * z).alias(f"t{i}") for i, z in enumerate(zs)],
                        *[(acc[f"s{i}"] + acc[f"t{i}"]).alias(f"s{i}") for i in range(len(zs))])

    return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, n_terms - 1))), init, step)
