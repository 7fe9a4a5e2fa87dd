"""Factorise and solve many systems at once: a grouped map by matrix, factors kept as a table.

A factor table has one row per matrix and level: (mid, level, n, m, stats, blob), the blob being the level's blocks.
Systems are independent: each is one group, handled by one task, and any number of them runs in parallel. One system
has to fit one task; for a matrix too large for that the relational operators (products, scalings, Schur complements,
level-set solves) are the way.
"""

from __future__ import annotations

import pickle
from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.kernels import apply, dense, factor, ordering
from stratum.operators import product
from stratum.types import BadPreconditioner, Params, SizeMismatch

FACTORS = "mid string, level int, n long, m long, nnz long, nnz_ef long, rank long, seconds double, stats array<long>, blob binary"
SOLUTION = "mid string, k int, i long, re double, im double"


def _complex(coo: DataFrame) -> DataFrame:
    if "v" in coo.columns:
        return coo.select(F.col("mid").alias("mid"), "i", "j", F.col("v").cast("double").alias("re"), F.lit(None).cast("double").alias("im"))
    return coo.select(F.col("mid").alias("mid"), "i", "j", "re", "im")


def _vectors(b: DataFrame) -> DataFrame:
    k = F.col("k").cast("int") if "k" in b.columns else F.lit(0)
    if "x" in b.columns:
        return b.select(F.col("mid").alias("mid"), k.alias("k"), "i", F.col("x").cast("double").alias("re"), F.lit(None).cast("double").alias("im"))
    return b.select(F.col("mid").alias("mid"), k.alias("k"), "i", "re", "im")


def _values(frame: pd.DataFrame) -> np.ndarray:
    re, im = frame["re"].to_numpy(float), frame["im"].to_numpy(float)
    return re if np.isnan(im).all() else re + 1j * np.nan_to_num(im)


def _sparse(frame: pd.DataFrame, n: int | None = None) -> apply.Sparse:
    frame = frame.sort_values(["i", "j"])
    i, j = frame["i"].to_numpy(np.int64), frame["j"].to_numpy(np.int64)
    size = int(max(i.max(initial=-1), j.max(initial=-1))) + 1
    return apply.Sparse(size if n is None else max(n, size), i, j, _values(frame))


def _dense_vectors(frame: pd.DataFrame, n: int) -> tuple[list[int], np.ndarray]:
    ks = sorted(frame["k"].unique().tolist())
    values = _values(frame)
    out = np.zeros((n, len(ks)), values.dtype)
    if len(frame) and frame["i"].max() >= n:
        raise SizeMismatch("a vector is longer than its matrix")
    out[frame["i"].to_numpy(), np.searchsorted(ks, frame["k"].to_numpy())] = values
    return ks, out


def _rows(mid: str, ks: list[int], x: np.ndarray) -> pd.DataFrame:
    n = len(x)
    return pd.DataFrame({"mid": mid, "k": np.repeat(np.array(ks, np.int32), n), "i": np.tile(np.arange(n), len(ks)), "re": x.real.T.reshape(-1), "im": (x.imag if np.iscomplexobj(x) else np.zeros_like(x)).T.reshape(-1)})


def _count(level: factor.Level) -> int:
    return sum(len(r) for r in level.L) + sum(len(r) for r in level.U) + level.m


def _filter(null_space):
    """A filter of vectors: of the places (first, end), or the user's own function of an array."""
    if null_space is None or callable(null_space):
        return null_space
    return lambda z: apply.null_filter(z, *null_space)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.complex64 if np.iscomplexobj(x) else np.float32)


def factor_frame(mid: str, a: apply.Sparse, params: Params, solver=None) -> pd.DataFrame:
    levels, stats = factor.factorize(a.rows(), params, solver)
    if params.single:
        for f in levels:
            narrow = lambda x: np.complex64(x) if isinstance(x, complex) else np.float32(x)
            for name in ("L", "U", "E", "F"):
                setattr(f, name, [{j: narrow(v).item() for j, v in row.items()} for row in getattr(f, name)])
            f.d = _narrow(f.d).astype(f.d.dtype)
            for name, value in list(vars(f.solver).items()) if f.solver is not None else ():
                if isinstance(value, np.ndarray) and value.dtype.kind in "fc":
                    setattr(f.solver, name, _narrow(value))
            if f.dense is not None:
                f.dense = _narrow(f.dense)
    out = []
    for at, f in enumerate(levels):
        last = at == len(levels) - 1
        rest = f.n - f.m
        rank = f.solver.rank if last and rest else 0
        out.append((mid, at + 1, f.n, f.m, _count(f) + (rest * rest if last else 0), sum(map(len, f.E)) + sum(map(len, f.F)), rank, f.seconds, stats if last else [0] * 6, pickle.dumps(f)))
    return pd.DataFrame(out, columns=["mid", "level", "n", "m", "nnz", "nnz_ef", "rank", "seconds", "stats", "blob"])


def _levels(frame: pd.DataFrame) -> list[factor.Level]:
    if not len(frame):
        raise BadPreconditioner("no factors for this matrix")
    return [pickle.loads(x) for x in frame.sort_values("level")["blob"]]  # noqa: S301: written by factor_frame


class Preconditioner:
    """Factors of the matrices in ``coo``, or of their sparsifiers, kept as a stored table.

    ``solver`` makes the last block's solver of an array: ``rank``, ``solve`` and ``multiply`` as in ``kernels.dense``.
    ``null_space`` of the methods is a pair (first, end) whose mean is taken off, or a function of an array.
    """

    def __init__(self, spark: SparkSession, coo: DataFrame, params: Params = Params(), sparsifier: DataFrame | None = None, solver=None):
        self.spark, self.params, self.solver = spark, params, solver
        self.matrix = _complex(coo)
        self.factors: DataFrame | None = None
        self.refactorize(sparsifier if sparsifier is not None else coo)

    def refactorize(self, coo: DataFrame, params: Params | None = None) -> Preconditioner:
        params, solver = params or self.params, self.solver

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return factor_frame(frame["mid"].iloc[0], _sparse(frame), params, solver)

        self.params = params
        self.factors = _complex(coo).groupBy("mid").applyInPandas(run, FACTORS).checkpoint()
        return self

    def update(self, coo: DataFrame) -> Preconditioner:
        """The matrix that residuals use, with the factors kept."""
        self.matrix = _complex(coo)
        return self

    def _apply(self, b: DataFrame, work) -> DataFrame:
        if self.factors is None:
            raise BadPreconditioner("not factorised")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(right):
                return pd.DataFrame({"mid": [], "k": [], "i": [], "re": [], "im": []})
            levels = _levels(left)
            ks, x = _dense_vectors(right, levels[0].n)
            return _rows(right["mid"].iloc[0], ks, work(levels, x))

        return self.factors.groupBy("mid").cogroup(_vectors(b).groupBy("mid")).applyInPandas(run, SOLUTION)

    def solve(self, b: DataFrame, trans: bool = False, rank: int = 0, null_space=None) -> DataFrame:
        """M^-1 b for each vector (mid[, k], i, x)."""

        after = _filter(null_space)

        def work(levels, x):
            out = apply.solve(levels, x, trans, rank)
            return after(out) if after else out

        return self._apply(b, work)

    def multiply(self, x: DataFrame, trans: bool = False, rank: int = 0) -> DataFrame:
        return self._apply(x, lambda levels, v: apply.multiply(levels, v, trans, rank))

    def _with_matrix(self, b: DataFrame, work, schema: str) -> DataFrame:
        """Matrix, factors and vectors of a system meet in one group."""
        none = lambda t: F.lit(None).cast(t)
        a = self.matrix.select("mid", F.lit("A").alias("part"), "i", "j", "re", "im", none("int").alias("level"), none("binary").alias("blob"))
        v = _vectors(b).select("mid", F.lit("b"), "i", F.col("k").cast("long"), "re", "im", none("int"), none("binary"))
        f = self.factors.select("mid", F.lit("f"), none("long"), none("long"), none("double"), none("double"), "level", "blob")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            levels = _levels(frame[frame["part"] == "f"])
            a = frame[frame["part"] == "A"].astype({"i": "int64", "j": "int64"})
            b = frame[frame["part"] == "b"].astype({"i": "int64", "j": "int64"}).rename(columns={"j": "k"})
            ks, x = _dense_vectors(b, levels[0].n)
            return work(frame["mid"].iloc[0], _sparse(a, levels[0].n), levels, ks, x)

        return a.union(v).union(f).groupBy("mid").applyInPandas(run, schema)

    def refine(self, b: DataFrame, steps: int, bounds: tuple[float, float] | None = None, trans: bool = False, rank: int = -1, null_space=None) -> DataFrame:
        """(mid, k, i, re, im, steps, flag): iterative refinement with the matrix."""
        after = _filter(null_space)

        def work(mid, a, levels, ks, x):
            out = []
            for n, k in enumerate(ks):
                y, did, flag = apply.refine(a, levels, x[:, n], steps, bounds, trans, rank, after)
                out.append(_rows(mid, [k], y[:, None]).assign(steps=did, flag=flag))
            return pd.concat(out)

        return self._with_matrix(b, work, f"{SOLUTION}, steps int, flag int")

    def gmres(self, b: DataFrame, rtol: float = 1e-6, restart: int = 30, maxit: int = 500, flexible: bool = False, null_space=None) -> DataFrame:
        """(mid, k, i, re, im, flag, iterations, relres, products)."""
        after = _filter(null_space)

        def work(mid, a, levels, ks, x):
            out = []
            for n, k in enumerate(ks):
                y, flag, count, rel, products = apply.gmres(a, levels, x[:, n], rtol, restart, maxit, flexible, after)
                out.append(_rows(mid, [k], y[:, None]).assign(flag=flag, iterations=count, relres=rel, products=products))
            return pd.concat(out)

        return self._with_matrix(b, work, f"{SOLUTION}, flag int, iterations int, relres double, products int")

    def fgmres(self, b: DataFrame, **more) -> DataFrame:
        return self.gmres(b, flexible=True, **more)

    def apply(self, op: str, b: DataFrame, steps: int = 1, bounds: tuple[float, float] | None = None, rank: int = 0) -> DataFrame:
        """S, SH: solve (refined with more than one step); M, MH: multiply. The rank holds for all."""
        trans = op.endswith("H")
        if op[0] == "M":
            return self.multiply(b, trans, rank)
        if steps > 1 or bounds is not None:
            return self.refine(b, steps, bounds, trans, rank)
        return self.solve(b, trans, rank)

    def export(self) -> DataFrame:
        """(mid, level, part, i, j, re, im): all blocks, scalings and permutations of the factors as entries."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for mid, level, blob in zip(frame["mid"], frame["level"], frame["blob"]):
                f = pickle.loads(blob)  # noqa: S301: written by factor_frame
                for part in ("L", "U", "E", "F"):
                    i, j, v, _ = apply._arrays(f, part)
                    out.append(pd.DataFrame({"part": part, "i": i, "j": j, "re": v.real, "im": v.imag}).assign(mid=mid, level=level))
                for part in ("s", "t", "p", "q", "d"):
                    v = np.asarray(getattr(f, part))
                    out.append(pd.DataFrame({"part": part, "i": np.arange(len(v)), "j": 0, "re": v.real.astype(float), "im": v.imag.astype(float)}).assign(mid=mid, level=level))
                if f.dense is not None:
                    i, j = np.indices(f.dense.shape).reshape(2, -1)
                    v = f.dense.reshape(-1)
                    out.append(pd.DataFrame({"part": "dense", "i": i, "j": j, "re": v.real, "im": v.imag}).assign(mid=mid, level=level))
            return pd.concat(out)[["mid", "level", "part", "i", "j", "re", "im"]]

        return self.factors.groupBy("mid").applyInPandas(run, "mid string, level int, part string, i long, j long, re double, im double")

    def timings(self) -> DataFrame:
        """(mid, level, seconds): what each level took to make."""
        return self.factors.select("mid", "level", "seconds")

    def stats(self) -> DataFrame:
        """Per matrix: levels (a dense block counts as one), entries, sizes and rank of the last Schur complement, counts."""
        last = F.max(F.struct("level", "n", "m", "rank", "stats"))
        found = self.factors.groupBy("mid").agg(F.max("n").alias("nrows"), F.max("level").alias("levels"), F.sum("nnz").alias("nnz"), F.sum("nnz_ef").alias("nnz_ef"), last.alias("z"))
        schur = F.col("z.n") - F.col("z.m")
        counts = [F.col("z.stats")[k].alias(n) for k, n in enumerate(("deferred", "dynamic", "by_diagonal", "by_condition", "dropped", "dropped_space"))]
        return found.select("mid", "nrows", (F.col("levels") + F.when(schur > 0, 1).otherwise(0)).alias("levels"), "nnz", "nnz_ef", schur.alias("schur_size"), F.col("z.rank").alias("schur_rank"), (F.col("nrows") - (schur - F.col("z.rank"))).alias("rank"), *counts)


def operator_residual(a, x: DataFrame, b: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """b - A x where A is a table of entries or a function from vectors to vectors."""
    y = a(x) if callable(a) else product.multiply(a, x, meta)
    return b.join(y.select("mid", "i", F.col("x").alias("y")), ["mid", "i"]).select("mid", "i", (F.col("x") - F.col("y")).alias("x"))


def solve_iteratively(spark: SparkSession, a, preconditioner: Preconditioner, b: DataFrame, steps: int = 16, bound: float = 1e-10) -> DataFrame:
    """Refinement by whole-table steps: products are relational plans, the solves grouped maps.

    For a matrix that only exists as an operator, or many vectors; each step's vector is checkpointed.
    """
    x = preconditioner.solve(b).select("mid", "i", F.col("re").alias("x")).checkpoint()
    sizes = b.groupBy("mid").agg(F.sum(F.col("x") * F.col("x")).alias("bb"))
    for _ in range(steps):
        r = operator_residual(a, x, b).checkpoint()
        rest = r.groupBy("mid").agg(F.sum(F.col("x") * F.col("x")).alias("rr")).join(sizes, "mid").agg(F.max(F.col("rr") / F.col("bb"))).first()[0]
        if rest is None or rest <= bound * bound:
            break
        more = preconditioner.solve(r).select("mid", "i", F.col("re").alias("dx"))
        x = x.join(more, ["mid", "i"]).select("mid", "i", (F.col("x") + F.col("dx")).alias("x")).checkpoint()
    return x


def matchings(coo: DataFrame) -> DataFrame:
    """(mid, i, j, s, t): the column matched to each row, the row's and that column's scaling."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a = _sparse(frame)
        cols, s, t, _ = ordering.match(a.rows())
        return pd.DataFrame({"mid": frame["mid"].iloc[0], "i": np.arange(a.n), "j": cols, "s": s, "t": [t[j] for j in cols]})

    return _complex(coo).groupBy("mid").applyInPandas(run, "mid string, i long, j long, s double, t double")


def orderings(coo: DataFrame, kind: str) -> DataFrame:
    """(mid, i, p): a minimum-degree (amd) or reverse Cuthill-McKee (rcm) order."""
    order = ordering.minimum_degree if kind == "amd" else ordering.cuthill_mckee

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = order(ordering.pattern(_sparse(frame).rows()))
        return pd.DataFrame({"mid": frame["mid"].iloc[0], "i": np.arange(len(p)), "p": p})

    return _complex(coo).groupBy("mid").applyInPandas(run, "mid string, i long, p long")


def dense_solve(coo: DataFrame, b: DataFrame, kind: str, rank: int = 0) -> DataFrame:
    """(mid, k, i, re, im, rank): by qrcp (its rank by 2-norms, or as qrcp1 by 1-norms), lup or syeig."""
    solver = {"qrcp": dense.QRCP, "qrcp1": partial(dense.QRCP, rank_norm=1), "lup": dense.LUP, "syeig": dense.SYEIG}[kind]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = _sparse(left, int(right["i"].max()) + 1 if len(right) else None)
        found = solver(factor.to_dense(a.rows(), a.n))
        ks, x = _dense_vectors(right, a.n)
        return _rows(left["mid"].iloc[0], ks, found.solve(x, rank)).assign(rank=found.rank)

    return _complex(coo).groupBy("mid").cogroup(_vectors(b).groupBy("mid")).applyInPandas(run, f"{SOLUTION}, rank int")


def single_precision(params: Params) -> Params:
    return replace(params, single=1)
