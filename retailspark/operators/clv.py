"""Historical and probabilistic customer lifetime value.

* ``historical_clv`` / ``build_summary`` / ``calibration_holdout`` —
  grouped aggregations.  The summary works on *days*: (customer, day) totals
  first, then per customer; the first day is excluded from the repeat-spend
  mean.
* ``fit_bgnbd`` / ``fit_gamma_gamma`` — maximum likelihood as a distributed
  aggregation: the per-customer data are first collapsed to distinct
  (x, t_x, T) resp. (x, m) with counts and checkpointed; each optimiser
  step is one aggregation job returning the mean log-likelihood and its
  gradient.  Time is rescaled by 10 / max(T) while fitting (α is scaled
  back afterwards) and the ridge penalty 0.001·Σθ² acts on the fitted-scale
  parameters — the convention of the widely used open-source fitter.
* predictions — closed forms as native columns (``functions.special``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.functions.money import money_units
from retailspark.functions.optim import bfgs
from retailspark.session import compact
from retailspark.functions.special import HALF_LOG_2PI, hyp2f1_many, terms_needed
from retailspark.operators.rfm import customer_totals

DAYS_PER_MONTH = 365.25 / 12
DEFAULT_PENALIZER = 0.001
CLV_MONTH_DAYS = 30  # month length of the discounted-CLV sum for daily data
FIXED_BG = (0.67, 64.0, 0.5, 1.2)   # (r, alpha, a, b) used by fixed-parameter views
FIXED_GG = (6.0, 3.0, 100.0)        # (p, q, v)


def floor_days(start: Column, end: Column) -> Column:
    return F.timestamp_diff("DAY", start, end)


# ------------------------------------------------------------------ historical
def historical_clv(tx: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``totals``: the ``customer_totals`` of ``tx``, if they are at hand."""
    g = customer_totals(tx) if totals is None else totals
    rev = F.col("_u") / 10000.0
    tenure = floor_days(F.col("first_purchase"), F.col("last_purchase")).cast("int")
    return g.select(
        "CustomerID", rev.alias("total_revenue"), "n_orders", "first_purchase", "last_purchase",
        (rev / F.col("n_orders")).alias("avg_order_value"),
        tenure.alias("tenure_days"),
        (rev / F.greatest(tenure, F.lit(1)) * 365).alias("annual_value"))


# ------------------------------------------------------------------ summary
def _day(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def build_summary(tx: DataFrame, observation_end: Column | None = None) -> DataFrame:
    """CustomerID, frequency (repeat days), recency, T (days), monetary_value
    (mean of repeat-day totals, 0 for one-day customers)."""
    obs = observation_end if observation_end is not None else tx.select(F.max("InvoiceDate")).scalar()
    obs_day = _day(obs)
    daily = (tx.select("CustomerID", _day(F.col("InvoiceDate")).alias("day"),
                       money_units(F.col("TotalPrice")).alias("u"))
             .filter(F.col("day") <= obs_day)
             .groupBy("CustomerID", "day").agg(F.sum("u").alias("u")))
    per = daily.groupBy("CustomerID").agg(
        F.min("day").alias("first"), F.max("day").alias("last"),
        F.count(F.lit(1)).alias("n_days"), F.sum("u").alias("u_all"),
        F.min_by("u", "day").alias("u_first"))
    freq = F.col("n_days") - 1
    return per.select(
        "CustomerID",
        freq.cast("double").alias("frequency"),
        floor_days(F.col("first"), F.col("last")).cast("double").alias("recency"),
        floor_days(F.col("first"), obs_day).cast("double").alias("T"),
        F.when(freq > 0, (F.col("u_all") - F.col("u_first")) / 10000.0 / freq)
         .otherwise(F.lit(0.0)).alias("monetary_value"))


def eligible(summary_cols=None) -> Column:
    return (F.col("frequency") > 0) & (F.col("monetary_value") > 0)


def frequency_monetary_correlation(summary: DataFrame) -> DataFrame:
    return (summary.filter(eligible())
            .agg(F.round(F.corr("frequency", "monetary_value"), 9).alias("correlation")))


# ------------------------------------------------------------------ BG/NBD
@dataclass(frozen=True)
class BGNBD:
    r: float
    alpha: float
    a: float
    b: float

    def as_tuple(self):
        return (self.r, self.alpha, self.a, self.b)


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float

    def as_tuple(self):
        return (self.p, self.q, self.v)


@dataclass
class FitResult:
    params: object
    names: tuple
    coef: np.ndarray
    se: np.ndarray
    neg_ll: float
    n_iter: int
    n: int
    converged: bool

    def summary_rows(self):
        return [(nm, float(c), float(s), float(c - 1.96 * s), float(c + 1.96 * s), self.converged)
                for nm, c, s in zip(self.names, self.coef, self.se)]


# The likelihood terms are emitted as SQL text (one ``F.expr`` call) rather
# than composed Column by Column: each optimiser step rebuilds them with new
# parameter values, and SQL text avoids hundreds of driver→JVM calls per step.
def _range_sums_sql(x: str, terms: dict) -> str:
    """Struct of Σ_{i=0}^{x-1} term(i) for several terms in one pass (x=0 → 0;
    guarded because sequence(0, -1) is [0, -1], not empty)."""
    zero = ", ".join(f"0D AS {k}" for k in terms)
    zero_struct = "named_struct(" + ", ".join(f"'{k}', 0D" for k in terms) + ")"
    step = ", ".join(f"acc.{k} + ({fn('CAST(i AS DOUBLE)')}) AS {k}" for k, fn in terms.items())
    return (f"CASE WHEN CAST({x} AS INT) <= 0 THEN {zero_struct} "
            f"ELSE aggregate(sequence(0, CAST({x} AS INT) - 1), struct({zero}), "
            f"(acc, i) -> struct({step})) END")


def _bgnbd_ll_grad(params, x: str = "x", t: str = "rec", T: str = "age") -> list[Column]:
    r, alpha, a, b = (repr(float(v)) for v in params)
    la = repr(math.log(float(params[1])))
    sums = _range_sums_sql(x, {
        "lr": lambda i: f"ln({r} + {i})",
        "lb": lambda i: f"ln({b} + {i}) - ln({a} + {b} + {i})",
        "gr": lambda i: f"1D / ({r} + {i})",
        "gab": lambda i: f"1D / ({a} + {b} + {i})",
        "gb": lambda i: f"1D / ({b} + {i})",
    })
    a3 = f"(-({r} + {x}) * ln({alpha} + {T}))"
    a4 = f"(ln({a}) - ln({b} + greatest({x}, 1D) - 1D) - ({r} + {x}) * ln({alpha} + {t}))"
    m = f"(CASE WHEN {x} > 0 THEN greatest({a3}, {a4}) ELSE {a3} END)"
    e3 = f"exp({a3} - {m})"
    e4 = f"(CASE WHEN {x} > 0 THEN exp({a4} - {m}) ELSE 0D END)"
    w4 = f"({e4} / ({e3} + {e4}))"
    w3 = f"({e3} / ({e3} + {e4}))"
    ll = f"(S.lr + {r} * {la} + S.lb + ln({e3} + {e4}) + {m})"
    dr = f"(S.gr + {la} - {w3} * ln({alpha} + {T}) - {w4} * ln({alpha} + {t}))"
    dal = f"({r} / {alpha} - {w3} * ({r} + {x}) / ({alpha} + {T}) - {w4} * ({r} + {x}) / ({alpha} + {t}))"
    da = f"(-S.gab + {w4} / {a})"
    db = f"(S.gb - S.gab - CASE WHEN {x} > 0 THEN {w4} / ({b} + {x} - 1D) ELSE 0D END)"
    return [(sums, [e for e in (ll, dr, dal, da, db)])]


def _lgamma_sql(z: str) -> str:
    w = f"({z} + 8D)"
    series = (f"(1D / (12D * {w}) - 1D / (360D * pow({w}, 3)) + 1D / (1260D * pow({w}, 5))"
              f" - 1D / (1680D * pow({w}, 7)))")
    shift = " + ".join(f"ln({z} + {i}D)" for i in range(8))
    return f"(({w} - 0.5D) * ln({w}) - {w} + {HALF_LOG_2PI!r} + {series} - ({shift}))"


def _digamma_sql(z: str) -> str:
    w = f"({z} + 8D)"
    iw2 = f"(1D / ({w} * {w}))"
    series = (f"(ln({w}) - 0.5D / {w} - {iw2} * (1D / 12 - {iw2} * (1D / 120 - {iw2} * "
              f"(1D / 252 - {iw2} * (1D / 240 - {iw2} / 132)))))")
    shift = " + ".join(f"1D / ({z} + {i}D)" for i in range(8))
    return f"({series} - ({shift}))"


def _gg_ll_grad(params, x: str = "x", m: str = "m") -> list[Column]:
    p, q, v = (float(z) for z in params)
    px = f"({x} * {p!r})"
    pxq = f"({px} + {q!r})"
    xm_v = f"({x} * {m} + {v!r})"
    ll = (f"({_lgamma_sql(pxq)} - {_lgamma_sql(px)} - {math.lgamma(q)!r} + {q * math.log(v)!r}"
          f" + ({px} - 1D) * ln({m}) + {px} * ln({x}) - {pxq} * ln({xm_v}))")
    dpq = _digamma_sql(pxq)
    dp = f"({x} * {dpq} - {x} * {_digamma_sql(px)} + {x} * ln({m}) + {x} * ln({x}) - {x} * ln({xm_v}))"
    dq = f"({dpq} - {_digamma_scalar(q)!r} + {math.log(v)!r} - ln({xm_v}))"
    dv = f"({q / v!r} - {pxq} / {xm_v})"
    return [(None, [ll, dp, dq, dv])]


def _digamma_scalar(z: float) -> float:
    acc = 0.0
    while z < 8:
        acc -= 1.0 / z
        z += 1
    iz2 = 1.0 / (z * z)
    return acc + math.log(z) - 0.5 / z - iz2 * (1 / 12 - iz2 * (1 / 120 - iz2 * (1 / 252 - iz2 * (1 / 240 - iz2 / 132))))


def _fit(grouped: DataFrame, make_terms, names, penalizer: float, x0) -> FitResult:
    """Minimise mean negative log-likelihood + penalty·Σθ² over θ = exp(φ).

    ``evaluate`` computes the weighted sums for several parameter vectors in
    ONE aggregation job (the Hessian's 2k gradient probes cost one job)."""
    n_total = grouped.agg(F.sum("n")).first()[0]

    def evaluate(thetas):
        pre, cols = [], []
        for j, th in enumerate(thetas):
            for sums, terms in make_terms(th):
                if sums is not None:
                    pre.append(F.expr(sums).alias(f"S{j}"))
                cols += [F.sum(F.expr(f"n * {t}".replace("S.", f"S{j}."))).alias(f"s{j}_{i}")
                         for i, t in enumerate(terms)]
        row = grouped.select("*", *pre).agg(*cols).first()
        width = len(cols) // len(thetas)
        out = []
        for j in range(len(thetas)):
            vals = [row[j * width + i] for i in range(width)]
            out.append(np.array([np.nan if v is None else v for v in vals], dtype=float) / n_total)
        return out

    def fg(phi: np.ndarray):
        theta = np.exp(phi)
        if not np.all(np.isfinite(theta)) or np.any(theta <= 0):
            return np.inf, np.full_like(phi, np.nan)
        vals = evaluate([theta])[0]
        f = -vals[0] + penalizer * np.sum(theta ** 2)
        g = theta * (-vals[1:] + 2 * penalizer * theta)
        return float(f), g

    phi, f, it, converged = bfgs(fg, np.log(np.asarray(x0, dtype=float)), gtol=1e-6, ftol=1e-10)
    theta = np.exp(phi)
    # standard errors: inverse Hessian of the total negative log-likelihood,
    # central differences of the analytic gradient in log-parameters, mapped
    # back with the delta method (se_θ = θ·se_φ)
    k = len(theta)
    h = 1e-4
    probes = []
    for j in range(k):
        for sign in (1, -1):
            pj = phi.copy()
            pj[j] += sign * h
            probes.append(pj)
    vals = evaluate([np.exp(pj) for pj in probes])
    hess = np.zeros((k, k))
    for j in range(k):
        gp = -np.exp(probes[2 * j]) * vals[2 * j][1:] * n_total
        gm = -np.exp(probes[2 * j + 1]) * vals[2 * j + 1][1:] * n_total
        hess[:, j] = (gp - gm) / (2 * h)
    hess = (hess + hess.T) / 2
    try:
        se = theta * np.sqrt(np.abs(np.diag(np.linalg.inv(hess))))
    except np.linalg.LinAlgError:
        se = np.full(k, np.nan)
    return FitResult(params=None, names=names, coef=theta, se=se, neg_ll=f, n_iter=it,
                     n=int(n_total), converged=converged)


def fit_bgnbd(summary: DataFrame, penalizer: float = DEFAULT_PENALIZER,
              freq_col="frequency", rec_col="recency", T_col="T") -> FitResult:
    max_T = summary.agg(F.max(T_col)).first()[0]
    scale = 10.0 / max_T if max_T else 1.0
    # column names differ beyond case: Spark resolves names case-insensitively
    grouped = (summary.groupBy(F.col(freq_col).alias("x"), (F.col(rec_col) * scale).alias("rec"),
                               (F.col(T_col) * scale).alias("age"))
               .agg(F.count(F.lit(1)).alias("n")))
    grouped = compact(grouped, "bgnbd_groups")

    def terms(th):
        return _bgnbd_ll_grad(th)

    res = _fit(grouped, terms, ("r", "alpha", "a", "b"), penalizer, [1.0, 1.0, 1.0, 1.0])
    coef, se = res.coef.copy(), res.se.copy()
    coef[1] /= scale
    se[1] /= scale
    res.coef, res.se = coef, se
    res.params = BGNBD(*coef)
    return res


def fit_gamma_gamma(summary: DataFrame, penalizer: float = DEFAULT_PENALIZER) -> FitResult:
    grouped = (summary.filter(eligible())
               .groupBy(F.col("frequency").alias("x"), F.col("monetary_value").alias("m"))
               .agg(F.count(F.lit(1)).alias("n")))
    grouped = compact(grouped, "gg_groups")

    def terms(th):
        return _gg_ll_grad(th)

    res = _fit(grouped, terms, ("p", "q", "v"), penalizer, [1.0, 1.0, 1.0])
    res.params = GammaGamma(*res.coef)
    return res


def param_summary(spark, res: FitResult, model: str) -> DataFrame:
    return spark.createDataFrame(
        [(model, *row) for row in res.summary_rows()],
        "model string, param string, coef double, se double, lower_95 double, upper_95 double, converged boolean")


# ------------------------------------------------------------------ predictions
# The textbook closed form of the expected purchases has a 2F1(r+x, b+x; a+b+x-1; z)
# with z = t / (alpha+T+t), whose terms grow before they fall when x is large and
# then cancel against a power of the same size.  Euler's transformation
#     2F1(p, q; c; z) = (1-z)^(c-p-q) 2F1(c-p, c-q; c; z)
# takes x out of both numerator parameters and out of the power:
#     ((alpha+T)/(alpha+T+t))^(r+x) 2F1(r+x, b+x; a+b+x-1; z)
#       = (1-z)^(a-1) 2F1(a+b-1-r, a-1; a+b+x-1; z).
def _terms(ts: list[float], bg: BGNBD) -> int:
    """Series length for any x >= 0 and T >= 0: z is at most t / (alpha + t),
    and the series is longest for the smallest c, at x = 0 or 1."""
    r, alpha, a, b = bg.as_tuple()
    z = max(t / (alpha + t) for t in ts)
    return max(terms_needed(a + b - 1 - r, a - 1, a + b + x - 1, z) for x in (0, 1))


def _expected_from_series(t: float, bg: BGNBD, x: Column, tx: Column, T: Column, f21: Column) -> Column:
    r, alpha, a, b = bg.as_tuple()
    a1 = F.try_divide(a + b + x - 1.0, F.lit(a - 1.0))
    a2 = F.pow(F.try_divide(alpha + T, alpha + T + t), F.lit(a - 1.0)) * f21
    den = 1.0 + F.when(x > 0, F.try_divide(F.lit(a), b + x - 1.0)
                       * F.pow(F.try_divide(alpha + T, alpha + tx), r + x)).otherwise(F.lit(0.0))
    return F.try_divide(a1 * (1.0 - a2), den)


def expected_purchases(t: float, bg: BGNBD, x: Column, tx: Column, T: Column) -> Column:
    """E[# purchases in (T, T+t]] given (x, t_x, T)."""
    return expected_purchases_many([t], bg, x, tx, T)[0]


def expected_purchases_many(ts: list[float], bg: BGNBD, x: Column, tx: Column, T: Column) -> list[Column]:
    """E[# purchases] for several horizons; the 2F1 series of all horizons
    share one pass (they differ only in z)."""
    r, alpha, a, b = bg.as_tuple()
    ts = [float(t) for t in ts]
    zs = [F.try_divide(F.lit(t), alpha + T + t) for t in ts]
    series = hyp2f1_many(a + b - 1.0 - r, a - 1.0, a + b + x - 1.0, zs, _terms(ts, bg))
    return [_expected_from_series(t, bg, x, tx, T, series[f"s{i}"]) for i, t in enumerate(ts)]


def prob_alive(bg: BGNBD, x: Column, tx: Column, T: Column) -> Column:
    r, alpha, a, b = bg.as_tuple()
    log_div = ((r + x) * F.log(F.try_divide(alpha + T, alpha + tx))
               + F.log(F.try_divide(F.lit(a), b + F.greatest(x, F.lit(1.0)) - 1.0)))
    return F.when(x == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), 1.0 + F.exp(log_div)))


def expected_avg_value(gg: GammaGamma, x: Column, m: Column) -> Column:
    p, q, v = gg.as_tuple()
    return F.try_divide(p * (v + x * m), p * x + q - 1.0)


def _clean(c: Column) -> Column:
    """NaN/NULL → 0, then clip at 0."""
    return F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def _checked(purchases: Column) -> Column:
    """An expected count is never negative but for rounding: anything else
    is a fault in the series and stops the job instead of becoming 0."""
    fault = F.raise_error(F.concat(F.lit("negative expected purchases: "), purchases.cast("string"))).cast("double")
    return F.when(purchases < -1e-6, fault).otherwise(_clean(purchases))


def predict(summary: DataFrame, bg: BGNBD, gg: GammaGamma, horizon_months: int = 3,
            discount_rate: float = 0.01) -> DataFrame:
    """Purchases, P(alive), value and discounted CLV of every customer.  CLV
    below 0 (an expected order value below 0, possible when p·x + q < 1) and
    what cannot be computed count as 0."""
    x, tx, T, m = F.col("frequency"), F.col("recency"), F.col("T"), F.col("monetary_value")
    elig = eligible()
    avg_val = expected_avg_value(gg, x, m)
    pop_avg = (summary.filter(elig).select(F.avg(expected_avg_value(gg, x, m))).scalar())
    horizons = [horizon_months * DAYS_PER_MONTH] + [k * CLV_MONTH_DAYS for k in range(1, horizon_months + 1)]
    summary = summary.withColumn("_ey", F.struct(*[
        e.alias(f"e{i}") for i, e in enumerate(expected_purchases_many(horizons, bg, x, tx, T))]))
    purchases = F.col("_ey.e0")
    clv = None
    prev = F.lit(0.0)
    for k in range(1, horizon_months + 1):
        cur = F.col(f"_ey.e{k}")
        term = avg_val * (cur - prev) / float((1 + discount_rate) ** k)
        clv = term if clv is None else clv + term
        prev = cur
    pa = prob_alive(bg, x, tx, T)
    out = summary.select(
        "CustomerID",
        purchases.alias("_purch"), pa.alias("prob_alive"),
        F.when(elig, avg_val).otherwise(pop_avg).alias("_avg"),
        F.when(elig, F.lit("bg_nbd_gamma_gamma")).otherwise(F.lit("fallback_pop_mean")).alias("clv_method"),
        F.when(elig, clv).otherwise(purchases * pop_avg).alias("_clv"))
    return out.select(
        "CustomerID",
        _checked(F.col("_purch")).alias("predicted_purchases"),
        "prob_alive",
        F.coalesce(F.nanvl(F.col("_avg"), F.lit(None)), pop_avg).alias("predicted_avg_value"),
        "clv_method",
        _clean(F.col("_clv")).alias("predicted_clv"))


# ------------------------------------------------------------------ holdout
def calibration_holdout(tx: DataFrame, calibration_end: Column, observation_end: Column) -> DataFrame:
    """Calibration summary (≤ cal_end) ⟕ distinct holdout purchase days in
    (cal_end, obs_end], missing → 0."""
    cal = build_summary(tx.filter(F.col("InvoiceDate") <= calibration_end), calibration_end)
    cal = cal.select("CustomerID", F.col("frequency").alias("frequency_cal"),
                     F.col("recency").alias("recency_cal"), F.col("T").alias("T_cal"))
    hold = (tx.filter((F.col("InvoiceDate") > calibration_end) & (F.col("InvoiceDate") <= observation_end))
            .groupBy("CustomerID")
            .agg(F.count_distinct(_day(F.col("InvoiceDate"))).cast("double").alias("frequency_holdout")))
    duration = F.timestamp_diff("DAY", _day(calibration_end), _day(observation_end)).cast("double")
    return (cal.join(hold, "CustomerID", "left")
            .select("CustomerID", "frequency_cal", "recency_cal", "T_cal",
                    F.coalesce(F.col("frequency_holdout"), F.lit(0.0)).alias("frequency_holdout"),
                    duration.alias("duration_holdout")))


def holdout_metrics(cal_holdout: DataFrame, bg: BGNBD, holdout_days: int) -> DataFrame:
    pred = expected_purchases(float(holdout_days), bg, F.col("frequency_cal"),
                              F.col("recency_cal"), F.col("T_cal"))
    d = cal_holdout.select(pred.alias("p"), F.col("frequency_holdout").alias("y"))
    err = F.col("p") - F.col("y")
    return d.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.lit(int(holdout_days)).alias("holdout_days"),
        F.round(F.avg(F.abs(err)), 9).alias("mae"),
        F.round(F.sqrt(F.avg(err * err)), 9).alias("rmse"),
        F.round(F.corr("p", "y"), 9).alias("correlation"),
        F.sum("y").alias("actual_total_purchases"),
        F.round(F.sum("p"), 6).alias("predicted_total_purchases"))
