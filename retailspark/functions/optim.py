"""Driver-side quasi-Newton step for the distributed likelihood fits.

The driver only ever holds the parameter vector (3-4 numbers), the gradient
and a 4×4 inverse-Hessian estimate; every objective/gradient evaluation is
one Spark aggregation job over the (pre-grouped) data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def bfgs(fg: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray,
         max_iter: int = 200, gtol: float = 1e-7, ftol: float = 1e-13,
         max_step: float = 10.0) -> tuple[np.ndarray, float, int, bool]:
    """(x, f, iterations, converged).  Converged: the gradient fell below
    ``gtol`` or a step below ``ftol`` (relative) was accepted; a failed line
    search or ``max_iter`` steps without either is not."""
    x = np.asarray(x0, dtype=float)
    f, g = fg(x)
    if not np.isfinite(f):
        raise ValueError("objective is not finite at the starting point")
    n = len(x)
    H = np.eye(n)
    it, converged = 0, False
    for it in range(1, max_iter + 1):
        p = -H @ g
        if g @ p >= 0:
            H = np.eye(n)
            p = -g
        norm = np.max(np.abs(p))
        if norm > max_step:
            p = p * (max_step / norm)
        step, accepted = 1.0, False
        while step > 1e-12:
            xn = x + step * p
            fn, gn = fg(xn)
            if np.isfinite(fn) and np.all(np.isfinite(gn)) and fn <= f + 1e-4 * step * (g @ p):
                accepted = True
                break
            step *= 0.5
        if not accepted:
            break
        s, y = xn - x, gn - g
        sy = s @ y
        if sy > 1e-14:
            rho = 1.0 / sy
            eye = np.eye(n)
            H = (eye - rho * np.outer(s, y)) @ H @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        fold = f
        x, f, g = xn, fn, gn
        if np.max(np.abs(g)) < gtol or abs(fold - f) <= ftol * (1 + abs(f)):
            converged = True
            break
    return x, f, it, converged
