"""Queries of the kernels: orderings, factorisations and solves of small systems, and their SQL where the answer is known.

Right sides are A times a vector of small whole numbers, so that solutions are known; they are rounded to 6 places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratum.operators import product, structure
from stratum.plans import preconditioner as pre
from stratum.plans.relational import query, _FD, _NN
from stratum.sources import tables
from stratum.types import Dense, Params, Pivot, Reorder

SMALL = Params(dense_thres=20, c_d=1.0, rho=1e-3)
_KNOWN = "SELECT 'FD12' AS mid, i, ((i % 7) + 1)::DOUBLE AS x FROM (SELECT unnest(range(0, 144)) AS i)"
_KNOWN_ALL = "SELECT 'FD' || g AS mid, i, ((i % 7) + 1)::DOUBLE AS x FROM (VALUES (6), (9), (12)) v(g), unnest(range(0, g * g)) u(i)"


def _system(spark, side=12, wind=0.3):
    a, meta = tables.stencil(spark, side, wind)
    x = tables.vector(meta, F.col("i") % 7 + 1)
    return a, meta, product.multiply(a, x, meta)


def _several(spark):
    parts = [_system(spark, g) for g in (6, 9, 12)]
    out = parts[0]
    for p in parts[1:]:
        out = tuple(u.union(v) for u, v in zip(out, p))
    return out


def _rounded(x):
    return x.select("mid", "i", F.round("re", 6).alias("x"))


@query("matching", _FD, "SELECT 'FD8' AS mid, CAST(64 AS BIGINT) AS matched, TRUE AS at_most_one, TRUE AS one_on_matching")
def matching(spark, d):
    """Scaled entries are at most 1, those of the matching 1, and every column is matched."""
    a, _ = tables.stencil(spark, 8, 0.3)
    found = pre.matchings(a)
    scaled = a.join(found.select("mid", "i", "s", F.col("j").alias("own")), ["mid", "i"]).join(found.select("mid", "j", "t"), ["mid", "j"])
    size = F.abs("v") * F.col("s") * F.col("t")
    return scaled.groupBy("mid").agg(F.countDistinct(F.when(F.col("j") == F.col("own"), F.col("j"))).alias("matched"), (F.max(size) <= 1 + 1e-9).alias("at_most_one"), F.min(F.when(F.col("j") == F.col("own"), size >= 1 - 1e-9)).alias("one_on_matching"))


def _order_check(p):
    return p.groupBy("mid").agg(F.countDistinct("p").alias("n"), F.min("p").alias("least"), F.max("p").alias("most"))


@query("amd", "", "SELECT 'FD12' AS mid, CAST(144 AS BIGINT) AS n, CAST(0 AS BIGINT) AS least, CAST(143 AS BIGINT) AS most")
def amd(spark, d):
    return _order_check(pre.orderings(_system(spark)[0], "amd"))


@query("rcm", "", "SELECT 'FD12' AS mid, CAST(144 AS BIGINT) AS n, CAST(0 AS BIGINT) AS least, CAST(143 AS BIGINT) AS most")
def rcm(spark, d):
    return _order_check(pre.orderings(_system(spark)[0], "rcm"))


def _solved(spark, params, **more):
    a, _, b = _system(spark)
    return _rounded(pre.Preconditioner(spark, a, params).gmres(b, rtol=1e-11, **more))


@query("solve_unsymmetric", "", _KNOWN)
def solve_unsymmetric(spark, d):
    return _solved(spark, SMALL)


@query("solve_pivoting", "", _KNOWN)
def solve_pivoting(spark, d):
    return _solved(spark, Params(dense_thres=20, c_d=1.0, pivot=Pivot.ON))


@query("solve_no_pivoting", "", _KNOWN)
def solve_no_pivoting(spark, d):
    return _solved(spark, Params(dense_thres=20, c_d=1.0, pivot=Pivot.OFF))


@query("solve_rcm", "", _KNOWN)
def solve_rcm(spark, d):
    return _solved(spark, Params(dense_thres=20, c_d=1.0, reorder=Reorder.RCM))


@query("solve_lup", "", _KNOWN)
def solve_lup(spark, d):
    return _solved(spark, Params(dense_thres=20, c_d=1.0, dense=Dense.LUP))


@query("solve_symmetric", "", _KNOWN)
def solve_symmetric(spark, d):
    a, _, b = _system(spark, wind=0.0)
    return _rounded(pre.Preconditioner(spark, a, Params(dense_thres=20, c_d=1.0, is_symm=1, spd=1)).gmres(b, rtol=1e-11))


@query("solve_single", "", _KNOWN)
def solve_single(spark, d):
    """Factors in single precision, the iteration in double."""
    return _solved(spark, pre.single_precision(SMALL))


@query("fgmres", "", _KNOWN_ALL)
def fgmres(spark, d):
    """Several systems at once, one group each."""
    a, _, b = _several(spark)
    return _rounded(pre.Preconditioner(spark, a, SMALL).fgmres(b, rtol=1e-11))


@query("refine_fixed", "", _KNOWN)
def refine_fixed(spark, d):
    a, _, b = _system(spark)
    return _rounded(pre.Preconditioner(spark, a, SMALL).refine(b, 6))


@query("refine_bounded", "", "SELECT 'FD12' AS mid, 0 AS flag, CAST(144 AS BIGINT) AS n, TRUE AS right_solution")
def refine_bounded(spark, d):
    a, _, b = _system(spark)
    x = pre.Preconditioner(spark, a, SMALL).refine(b, 16, (1e-8, 1.0))
    return x.groupBy("mid", "flag").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("re") - (F.col("i") % 7 + 1))) < 1e-5).alias("right_solution"))


@query("refine_relational", "", _KNOWN)
def refine_relational(spark, d):
    """The matrix as a function on tables: products are joins, only the solves are kernels."""
    a, meta, b = _system(spark)
    m = pre.Preconditioner(spark, a, SMALL)
    x = pre.solve_iteratively(spark, lambda v: product.multiply(a, v, meta), m, b)
    return x.select("mid", "i", F.round("x", 6).alias("x"))


@query("solve_round_trip", "", _KNOWN)
def solve_round_trip(spark, d):
    """M (M^-1 x) = x."""
    a, meta, _ = _system(spark)
    m = pre.Preconditioner(spark, a, SMALL)
    y = m.solve(tables.vector(meta, F.col("i") % 7 + 1))
    return _rounded(m.multiply(y.select("mid", "i", F.col("re").alias("x"))))


@query("solve_round_trip_h", "", _KNOWN)
def solve_round_trip_h(spark, d):
    """M^H (M^-H x) = x, through the operator names."""
    a, meta, _ = _system(spark)
    m = pre.Preconditioner(spark, a, SMALL)
    y = m.apply("SH", tables.vector(meta, F.col("i") % 7 + 1))
    return _rounded(m.apply("MH", y.select("mid", "i", F.col("re").alias("x"))))


@query("solve_mrhs", "", "SELECT 'FD12' AS mid, k, i, ((i % (k + 3)) + 1)::DOUBLE AS x FROM (VALUES (0), (1), (2)) v(k), (SELECT unnest(range(0, 144)) AS i)")
def solve_mrhs(spark, d):
    """Several right sides: each column as if alone."""
    a, meta, _ = _system(spark)
    ks = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    x = structure.indices(meta).select("mid", ks, "i").select("mid", "k", "i", (F.col("i") % (F.col("k") + 3) + 1).cast("double").alias("x"))
    found = pre.Preconditioner(spark, a, SMALL).gmres(product.multiply_many(a, x, meta), rtol=1e-11)
    return found.select("mid", "k", "i", F.round("re", 6).alias("x"))


@query("solve_complex", "", "SELECT 'Z' AS mid, i, ((i % 5) + 1)::DOUBLE AS re, ((i % 3) - 1)::DOUBLE AS im FROM (SELECT unnest(range(0, 100)) AS i)")
def solve_complex(spark, d):
    a, meta = tables.stencil(spark, 10, 0.2, "Z")
    z = a.select("mid", "i", "j", F.col("v").alias("re"), F.when(F.col("i") == F.col("j"), 0.5).otherwise(0.1).alias("im"))
    x = structure.indices(meta).select("mid", "i", (F.col("i") % 5 + 1).cast("double").alias("re"), (F.col("i") % 3 - 1).cast("double").alias("im"))
    b = product.multiply_complex(z, x, meta)
    found = pre.Preconditioner(spark, z, SMALL).gmres(b, rtol=1e-11)
    return found.select("mid", "i", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query("solve_singular", "", "SELECT 'LAP' AS mid, i, (i - 9.5)::DOUBLE AS x FROM (SELECT unnest(range(0, 20)) AS i)")
def solve_singular(spark, d):
    return _path(spark, (0, -1))


@query("solve_singular_user", "", "SELECT 'LAP' AS mid, i, (i - 9.5)::DOUBLE AS x FROM (SELECT unnest(range(0, 20)) AS i)")
def solve_singular_user(spark, d):
    """The null space taken off by the user's own function."""
    return _path(spark, lambda x: x - x.mean(axis=0))


def _path(spark, null_space):
    """A path's Laplacian: constant null space, filtered; the solution of zero mean is known."""
    i = spark.range(20).select(F.lit("LAP").alias("mid"), F.col("id").alias("i"))
    ends = (F.col("i") == 0) | (F.col("i") == 19)
    arms = F.array(F.struct(F.lit(0).alias("d"), F.when(ends, 1.0).otherwise(2.0).alias("v")), F.struct(F.lit(1).alias("d"), F.lit(-1.0).alias("v")), F.struct(F.lit(-1).alias("d"), F.lit(-1.0).alias("v")))
    a = i.select("mid", "i", F.explode(arms).alias("e")).select("mid", "i", (F.col("i") + F.col("e.d")).alias("j"), F.col("e.v").alias("v")).where("j between 0 and 19")
    b = i.select("mid", "i", F.when(F.col("i") == 0, -1.0).when(F.col("i") == 19, 1.0).otherwise(0.0).alias("x"))
    found = pre.Preconditioner(spark, a, Params()).solve(b, null_space=null_space)
    return _rounded(found)


class Inverse:
    """A dense solver of a user: the block's inverse."""

    def __init__(self, a):
        self.a, self.inverse, self.rank = a, np.linalg.inv(a), len(a)

    def solve(self, b, rank=0, trans=False):
        return (self.inverse.conj().T if trans else self.inverse) @ b

    def multiply(self, x, rank=0, trans=False):
        return (self.a.conj().T if trans else self.a) @ x


@query("solve_user_dense", "", _KNOWN)
def solve_user_dense(spark, d):
    """M (M^-1 x) = x with the user's solver for the last block."""
    a, meta, _ = _system(spark)
    m = pre.Preconditioner(spark, a, SMALL, solver=Inverse)
    y = m.solve(tables.vector(meta, F.col("i") % 7 + 1))
    return _rounded(m.multiply(y.select("mid", "i", F.col("re").alias("x"))))


@query("sparsifier", "", _KNOWN)
def sparsifier(spark, d):
    """Factors of a simpler matrix precondition another."""
    a, _, b = _system(spark, wind=0.3)
    s = tables.stencil(spark, 12, 0.0)[0]
    return _rounded(pre.Preconditioner(spark, a, SMALL, sparsifier=s).gmres(b, rtol=1e-11, restart=60))


@query("update_refactorize", "", _KNOWN)
def update_refactorize(spark, d):
    """The matrix of the residuals is replaced, then the factors."""
    a, _, b = _system(spark, wind=0.3)
    m = pre.Preconditioner(spark, tables.stencil(spark, 12, 0.0)[0], SMALL)
    return _rounded(m.update(a).refactorize(a, SMALL.with_droptol(1e-6)).gmres(b, rtol=1e-11))


@query("factor_stats", "", "SELECT 'FD12' AS mid, CAST(144 AS BIGINT) AS nrows, TRUE AS several_levels, TRUE AS entries, TRUE AS full_rank, TRUE AS counted")
def factor_stats(spark, d):
    found = pre.Preconditioner(spark, _system(spark)[0], SMALL).stats()
    return found.select("mid", "nrows", (F.col("levels") >= 2).alias("several_levels"), (F.col("nnz") > 0).alias("entries"), (F.col("rank") == F.col("nrows")).alias("full_rank"), (F.col("deferred") == F.col("by_diagonal") + F.col("by_condition")).alias("counted"))


def _dense(spark, d, kind):
    """Nations by nations with 50000 more on the diagonal, made symmetric for eigenvalues."""
    a, meta = tables.nations(spark, d)
    if kind == "syeig":
        a = structure.assemble(a.union(structure.transpose(a)))
    extra = structure.indices(meta).select("mid", "i", F.col("i").alias("j"), F.lit(50000.0).alias("v"))
    a = structure.assemble(a.union(extra))
    b = product.multiply(a, tables.vector(meta, F.col("i") % 7 + 1), meta)
    return pre.dense_solve(a, b, kind).select("mid", "i", F.round("re", 6).alias("x"), "rank")


_DENSE = "SELECT 'NN' AS mid, i, ((i % 7) + 1)::DOUBLE AS x, 25 AS rank FROM (SELECT unnest(range(0, 25)) AS i)"


@query("qrcp", "", _DENSE)
def qrcp(spark, d):
    return _dense(spark, d, "qrcp")


@query("lup", "", _DENSE)
def lup(spark, d):
    return _dense(spark, d, "lup")


@query("syeig", "", _DENSE)
def syeig(spark, d):
    return _dense(spark, d, "syeig")


_RANK_TWO = "SELECT 'NN' AS mid, CAST(2 AS INT) AS rank, TRUE AS least_squares"


@query("qrcp_rank", _NN, _RANK_TWO)
def qrcp_rank(spark, d):
    return _rank_two(spark, d, "qrcp")


@query("qrcp_rank_1norm", _NN, _RANK_TWO)
def qrcp_rank_1norm(spark, d):
    return _rank_two(spark, d, "qrcp1")


def _rank_two(spark, d, kind):
    """A rank-two matrix: the rank is found and the solution fits."""
    meta = tables.nations(spark, d)[1]
    ij = structure.indices(meta).join(structure.indices(meta).select("mid", F.col("i").alias("j")), "mid")
    a = ij.select("mid", "i", "j", ((F.col("i") + 1) * (F.col("j") + 2) + F.col("i") * F.col("i") * F.col("j")).cast("double").alias("v"))
    b = product.multiply(a, tables.vector(meta, F.col("i") % 7 + 1), meta)
    x = pre.dense_solve(a, b, kind)
    r = product.norms(product.residual(a, x.select("mid", "i", F.col("re").alias("x")), b, meta)).select("mid", F.col("norm2").alias("rest"))
    fits = r.join(product.norms(b).select("mid", F.col("norm2").alias("all")), "mid").select("mid", (F.col("rest") < 1e-8 * F.col("all")).alias("least_squares"))
    return x.select("mid", "rank").distinct().join(fits, "mid")


@query("export_factors", "", "SELECT 'FD12' AS mid, part, CAST(144 AS BIGINT) AS n FROM (VALUES ('s'), ('t'), ('p'), ('q')) v(part)")
def export_factors(spark, d):
    """The first level's scalings and permutations, as tables."""
    parts = pre.Preconditioner(spark, _system(spark)[0], SMALL).export()
    return parts.where("level = 1 and part in ('s', 't', 'p', 'q')").groupBy("mid", "part").agg(F.countDistinct("i").alias("n"))


#: One level without dropping and deferral: a complete factorisation.
EXACT = Params(tau_L=0.0, tau_U=0.0, alpha_L=1e9, alpha_U=1e9, kappa=1e9, kappa_d=1e9, rf_par=0, dense_thres=1, c_d=0.0)
_WIND = "SELECT 'FD12' AS mid, i, (y + dy) * 12 + x + dx AS j, v FROM (SELECT i, i % 12 AS x, i // 12 AS y FROM (SELECT unnest(range(0, 144)) AS i)), (VALUES (0, 0, 4.0::DOUBLE), (1, 0, -0.7::DOUBLE), (-1, 0, -1.3::DOUBLE), (0, 1, -1.0::DOUBLE), (0, -1, -1.0::DOUBLE)) e(dx, dy, v) WHERE x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 11"


def _rebuilt(spark, params):
    """The matrix from its exported factors: (I + L) D (I + U), unscaled and put back in its order."""
    parts = pre.Preconditioner(spark, _system(spark)[0], params).export().where("level = 1").select("part", "i", "j", "re").checkpoint()
    part = lambda name: parts.where(F.col("part") == name)
    d = part("d").select(F.col("i").alias("k"), F.col("re").alias("d"))
    low = part("L").select("i", F.col("j").alias("k"), F.col("re").alias("l")).union(d.select(F.col("k").alias("i"), "k", F.lit(1.0)))
    up = part("U").select(F.col("i").alias("k"), "j", F.col("re").alias("u")).union(d.select("k", F.col("k").alias("j"), F.lit(1.0)))
    block = low.join(d, "k").join(up, "k").groupBy("i", "j").agg(F.sum(F.col("l") * F.col("d") * F.col("u")).alias("v"))
    place = lambda order, at, scale: part(order).select(F.col("i").alias(at), F.col("re").cast("long").alias(f"old_{at}")).join(part(scale).select(F.col("i").alias(f"old_{at}"), F.col("re").alias(scale)), f"old_{at}")
    found = block.join(place("p", "i", "s"), "i").join(place("q", "j", "t"), "j").select(F.lit("FD12").alias("mid"), F.col("old_i").alias("i"), F.col("old_j").alias("j"), F.round(F.col("v") / (F.col("s") * F.col("t")), 6).alias("v"))
    return found.where("v <> 0")


@query("factors_rebuild", "", _WIND)
def factors_rebuild(spark, d):
    return _rebuilt(spark, EXACT)


@query("factors_rebuild_pivoting", "", _WIND)
def factors_rebuild_pivoting(spark, d):
    return _rebuilt(spark, EXACT.with_value("pivot", "on"))


@query("factors_rebuild_rcm", "", _WIND)
def factors_rebuild_rcm(spark, d):
    return _rebuilt(spark, EXACT.with_value("reorder", "rcm"))


@query("solve_rank", "", "SELECT 'NN' AS mid, CAST(25 AS BIGINT) AS n, TRUE AS differs")
def solve_rank(spark, d):
    """An explicit rank truncates the dense block's solve."""
    a, meta = tables.nations(spark, d)
    extra = structure.indices(meta).select("mid", "i", F.col("i").alias("j"), (F.col("i") * 1000 + 50000).cast("double").alias("v"))
    m = pre.Preconditioner(spark, structure.assemble(a.union(extra)), Params(no_pre=1, tau_L=0.0, kappa=1.0001, kappa_d=1.0, rf_par=0))
    b = tables.vector(meta, F.col("i") % 7 + 1)
    whole, part = m.solve(b), m.solve(b, rank=3).select(F.col("i").alias("place"), F.col("re").alias("other"))
    both = whole.join(part, F.col("i") == F.col("place"))
    return both.groupBy("mid").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("re") - F.col("other"))) > 0).alias("differs"))
