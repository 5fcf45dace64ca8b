"""Many K-means models fitted together (the k sweep × restarts).

Fitting each (k, seed) separately costs one pass over the data per Lloyd
iteration *per model* — 90 models × ~20 iterations in the k = 2..10, 10-seed
sweep.  Here every pass serves all models at once:

* seeding — k-means++ for every model in parallel: each pass picks the next
  centre of every model by weighted sampling (exponential clocks
  −ln(u)/D², u a hash of (row, seed, step), so the choice is deterministic
  and independent of partitioning); max(k) passes in total;
* Lloyd — one ``mapInPandas`` pass assigns every row to its nearest centre
  under every model and emits per-(model, cluster) partial sums
  (≤ Σk rows per task), combined by one small ``groupBy``.

Only centres (Σk × d numbers) travel to the tasks and back.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.session import compact, on_workers

MASK64 = (1 << 64) - 1


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 finaliser of (h xor salt) → uniform (0, 1)."""
    with np.errstate(over="ignore"):
        z = (h ^ np.uint64(salt & MASK64)) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53) + 0.5 / float(1 << 53)


def _prepare(feat: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    return feat.select(F.xxhash64(F.col(id_col)).alias("_h"), *[F.col(c).cast("double") for c in cols])


def _seed_step(data: DataFrame, cols, models, centers, step: int) -> dict:
    """Next centre for every model that still needs one."""
    active = [(m, seed) for m, (k, seed) in enumerate(models) if len(centers[m]) < k and len(centers[m]) == step]
    if not active:
        return {}
    cur = {m: np.array(centers[m]) for m, _ in active}

    def part(it):
        for pdf in it:
            x = pdf[cols].to_numpy()
            h = pdf["_h"].to_numpy().astype(np.int64).view(np.uint64)
            out = []
            for m, seed in active:
                u = _mix(h, seed * 1_000_003 + step)
                if step == 0:
                    key = u
                else:
                    c = cur[m]
                    d2 = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1).min(1)
                    with np.errstate(divide="ignore"):
                        key = np.where(d2 > 0, -np.log(u) / d2, np.inf)
                i = int(np.argmin(key))
                if np.isfinite(key[i]):
                    out.append((m, float(key[i]), *x[i].tolist()))
            if out:
                yield pd.DataFrame(out, columns=["m", "key", *cols])

    schema = "m int, key double, " + ", ".join(f"{c} double" for c in cols)
    best = (on_workers(data).mapInPandas(part, schema)
            .groupBy("m").agg(F.min(F.struct("key", *cols)).alias("b")).collect())
    return {r["m"]: [r["b"][c] for c in cols] for r in best}


def _lloyd_pass(data: DataFrame, cols, centers: list[np.ndarray], active=None, costs: bool = True):
    """Partial sums for the models in ``active`` (default: all), and their costs
    if they are asked for."""
    sizes = [len(c) for c in centers]
    active = list(range(len(centers))) if active is None else list(active)

    flat = np.concatenate([centers[m] for m in active])  # converged models take no part
    begin = dict(zip(active, np.cumsum([0, *(sizes[m] for m in active)]).tolist()))

    def part(it):
        acc_s = [np.zeros((k, len(cols))) for k in sizes]
        acc_n = [np.zeros(k) for k in sizes]
        acc_c = np.zeros(len(sizes))
        for pdf in it:
            x = pdf[cols].to_numpy()
            # |x|² is the same for every centre: one product ranks them all
            half = x @ flat.T - (flat ** 2).sum(1) / 2
            for m in active:
                c = centers[m]
                lab = half[:, begin[m]:begin[m] + len(c)].argmax(1)
                if costs:
                    acc_c[m] += ((x - c[lab]) ** 2).sum()
                for i in range(len(cols)):
                    acc_s[m][:, i] += np.bincount(lab, x[:, i], minlength=len(c))
                acc_n[m] += np.bincount(lab, minlength=len(c))
        rows = []
        for m in active:
            for j in range(sizes[m]):
                rows.append((m, j, float(acc_n[m][j]), *acc_s[m][j].tolist(),
                             float(acc_c[m]) if j == 0 else 0.0))
        yield pd.DataFrame(rows, columns=["m", "j", "n", *cols, "cost"])

    schema = "m int, j int, n double, " + ", ".join(f"{c} double" for c in cols) + ", cost double"
    agg = (on_workers(data).mapInPandas(part, schema).groupBy("m", "j")
           .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols], F.sum("cost").alias("cost"))
           .collect())
    sums = [np.zeros((k, len(cols))) for k in sizes]
    counts = [np.zeros(k) for k in sizes]
    cost = np.zeros(len(sizes))
    for r in agg:
        sums[r["m"]][r["j"]] = [r[c] for c in cols]
        counts[r["m"]][r["j"]] = r["n"]
        cost[r["m"]] += r["cost"]
    return sums, counts, cost


def fit_many(feat: DataFrame, id_col: str, cols: list[str], models: list[tuple[int, int]],
             max_iter: int = 300, tol: float = 1e-4):
    """Fit K-means for every (k, seed); returns ([centers], [cost]) where cost
    is the within-cluster sum of squares of the final centres.  A model has
    converged when its total squared centre shift is ≤ tol × the mean
    feature variance; one that has not after ``max_iter`` passes is warned of.
    Without rows a model has no centres and no cost."""
    data = compact(_prepare(feat, id_col, cols), "kmeans_rows").cache()
    var = data.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    tol_abs = tol * float(np.mean([var[c] or 0.0 for c in cols]))
    if not data.limit(1).count():
        return [np.zeros((0, len(cols)))] * len(models), np.zeros(len(models))
    centers: list[list] = [[] for _ in models]
    for step in range(max(k for k, _ in models)):
        for m, c in _seed_step(data, cols, models, centers, step).items():
            centers[m].append(c)
    cen = [np.array(c, dtype=float) for c in centers]
    done = np.zeros(len(models), dtype=bool)
    for _ in range(max_iter):
        active = [m for m in range(len(models)) if not done[m]]
        sums, counts, _ = _lloyd_pass(data, cols, cen, active, costs=False)
        for m in active:
            new = cen[m].copy()
            nz = counts[m] > 0
            new[nz] = sums[m][nz] / counts[m][nz][:, None]
            shift = float(((new - cen[m]) ** 2).sum())
            cen[m] = new
            if shift <= tol_abs:
                done[m] = True
        if done.all():
            break
    if not done.all():
        warnings.warn(f"{int((~done).sum())} of {len(models)} K-means models moved still after {max_iter} passes", stacklevel=2)
    _, _, cost = _lloyd_pass(data, cols, cen)
    data.unpersist()
    return cen, cost


def assign(feat: DataFrame, cols: list[str], centers: np.ndarray, out_col: str = "Cluster") -> DataFrame:
    """Nearest-centre label as a native expression (k ≤ 10 literal centres);
    null without centres."""
    if not len(centers):
        return feat.withColumn(out_col, F.lit(None).cast("int"))
    d = [sum((F.col(c) - F.lit(float(centers[j][i]))) ** 2 for i, c in enumerate(cols))
         for j in range(len(centers))]
    best = F.lit(0)
    best_d = d[0]
    for j in range(1, len(d)):
        best = F.when(d[j] < best_d, F.lit(j)).otherwise(best)
        best_d = F.least(best_d, d[j])
    return feat.withColumn(out_col, best.cast("int"))
