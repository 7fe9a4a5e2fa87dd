"""The largest eigenvalues of symmetric and Hermitian matrices by Lanczos' method over tables.

The basis is a table, each step one product with the matrix and two sweeps of orthogonalisation against all of it; only
the tridiagonal matrix lies on the driver. From one starting vector each eigenvalue is found once, however often it
occurs: its vector is then the starting vector's part in the eigenspace.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import product
from stratum.operators.structure import indices
from stratum.plans.krylov import STEP, combined, norms, scaled, weights
from stratum.sources.store import Table, drop, stored


def as_real(cooz: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A Hermitian (mid, i, j, re, im) as a symmetric matrix of twice the size, [re, -im; im, re], of the same eigenvalues."""
    n = meta.select("mid", F.col("nrows").alias("n"))
    parts = F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("re").alias("v")), F.struct((F.col("i") + F.col("n")).alias("i"), (F.col("j") + F.col("n")).alias("j"), F.col("re").alias("v")),
        F.struct(F.col("i").alias("i"), (F.col("j") + F.col("n")).alias("j"), (-F.col("im")).alias("v")), F.struct((F.col("i") + F.col("n")).alias("i"), F.col("j").alias("j"), F.col("im").alias("v")),
    )
    double = cooz.join(n, "mid").select("mid", F.explode(parts).alias("e")).select("mid", "e.*").where("v <> 0")
    return double, meta.select("mid", (2 * F.col("nrows")).alias("nrows"), (2 * F.col("ncols")).alias("ncols"))


def largest(coo: DataFrame, meta: DataFrame, many: int = 10, tol: float = 1e-9, most: int = 300, vectors: bool = False, start: DataFrame | None = None) -> tuple[dict[str, list[float]], DataFrame | None]:
    """The ``many`` eigenvalues of largest magnitude for each matrix, from the largest on, and their unit vectors (mid, k, i, x).

    Steps are taken until the residuals of all of them are under ``tol`` times the largest magnitude, the space is used
    up, or there are ``most``. The starting vector is ``start`` (mid, i, x), or else pseudo-random.
    """
    spark = coo.sparkSession
    coo = stored(coo.select("mid", "i", "j", F.col("v").cast("double").alias("v")))
    if start is None:
        start = indices(meta).select("mid", "i", (F.xxhash64("i", F.lit(1)) / F.lit(2.0**63)).alias("x"))
    start = stored(start)
    size = norms(start)
    basis = Table(spark, STEP)
    basis.add(scaled(start, {m: 1 / s if s else 0.0 for m, s in size.items()}, 0))
    alpha, beta = {m: [] for m in size}, {m: [] for m in size}
    active = {m for m, s in size.items() if s}
    for k in range(most):
        v = basis.read().where(F.col("step") == k)
        w = stored(product.multiply(coo, v.select("mid", "i", "x"), meta))
        before = norms(w)
        for sweep in range(2):
            own = basis.read().join(w.select("mid", "i", F.col("x").alias("w")), ["mid", "i"]).groupBy("mid", "step").agg(F.sum(F.col("x") * F.col("w")).alias("c")).collect()
            found = {m: [0.0] * (k + 1) for m in size}
            for row in own:  # a number for each step
                found[row["mid"]][row["step"]] = row["c"]
            for m in active:
                alpha[m] += [found[m][k]] if not sweep else []
                alpha[m][k] += found[m][k] if sweep else 0.0
            full, w = w, combined(w, basis.read(), weights(spark, found), -1)
            drop(full)
        after = norms(w)
        for m in sorted(active):
            beta[m].append(after[m] if after[m] > 1e-12 * before[m] else 0.0)
            values, inner = _tridiagonal(alpha[m], beta[m])
            top = np.argsort(-abs(values))[:many]
            if not beta[m][-1] or (len(values) >= many and (beta[m][-1] * abs(inner[-1, top]) <= tol * abs(values[top[0]])).all()):
                active.discard(m)
        if not active:
            break
        basis.add(scaled(w, {m: 1 / beta[m][k] if m in active else 0.0 for m in size}, k + 1))
    out, parts = {}, []
    for m in sorted(size):
        values, inner = _tridiagonal(alpha[m], beta[m])
        top = np.argsort(-abs(values), kind="stable")[:many]
        out[m] = values[top].tolist()
        parts += [(m, k, s, float(inner[s, t])) for k, t in enumerate(top) for s in range(len(values))]
    if not vectors:
        return out, None
    table = F.broadcast(spark.createDataFrame(parts, "mid string, k int, step int, c double"))
    ritz = basis.read().join(table, ["mid", "step"]).groupBy("mid", "k", "i").agg(F.sum(F.col("c") * F.col("x")).alias("x"))
    return out, ritz


def _tridiagonal(alpha: list[float], beta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    off = np.diag(beta[: len(alpha) - 1], 1) if len(alpha) > 1 else np.zeros((len(alpha),) * 2)
    return np.linalg.eigh(np.diag(alpha) + off + off.T)
