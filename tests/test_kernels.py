"""Kernels against dense algebra, with fixed seeds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.kernels import apply, dense, factor, ordering
from stratum.types import BadInput, Dense, Params, Pivot, Reorder

SMALL = dict(dense_thres=10, c_d=1.0, rho=1e-3)


def stencil(side, wind=0.0):
    at = [((y * side + x), (y + dy) * side + x + dx, v) for y in range(side) for x in range(side) for dx, dy, v in ((0, 0, 4.0), (1, 0, -1 + wind), (-1, 0, -1 - wind), (0, 1, -1.0), (0, -1, -1.0)) if 0 <= x + dx < side and 0 <= y + dy < side]
    i, j, v = zip(*at)
    return apply.Sparse(side * side, np.array(i), np.array(j), np.array(v))


def random(n, share, seed, is_complex=False):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < share) * rng.standard_normal((n, n))
    if is_complex:
        a = a * (1 + 1j * rng.standard_normal((n, n)))
    a[np.arange(n), rng.permutation(n)] += 3 * 10 ** rng.uniform(-2, 2, n)
    i, j = np.nonzero(a)
    return apply.Sparse(n, i, j, a[i, j]), a


MODES = [Params(**SMALL), Params(**SMALL, pivot=Pivot.ON), Params(**SMALL, pivot=Pivot.OFF), Params(**SMALL, reorder=Reorder.RCM), Params(**SMALL, reorder=Reorder.OFF), Params(**SMALL, dense=Dense.LUP), Params(**SMALL, no_pre=1), Params(**SMALL, pre_scale=1), Params(**SMALL, pre_scale=2)]


@pytest.mark.parametrize("params", MODES, ids=range(len(MODES)))
@pytest.mark.parametrize("is_complex", [False, True])
def test_round_trip_and_adjoint(params, is_complex):
    a, _ = random(60, 0.06, 3, is_complex)
    levels, _ = factor.factorize(a.rows(), params)
    rng = np.random.default_rng(5)
    b, y = rng.standard_normal(60), rng.standard_normal(60)
    for trans in (False, True):
        x = apply.solve(levels, b, trans)
        assert np.linalg.norm(apply.multiply(levels, x, trans) - b) <= 1e-9 * np.linalg.norm(b)
    left, right = np.vdot(y, apply.solve(levels, b)), np.vdot(apply.solve(levels, y, True), b)
    assert abs(left - right) <= 1e-8 * abs(left)


@pytest.mark.parametrize("pivot", [Pivot.OFF, Pivot.ON, Pivot.AUTO])
def test_exact_without_dropping(pivot):
    a = stencil(12, 0.3)
    params = Params(tau_L=0, tau_U=0, alpha_L=1e9, alpha_U=1e9, dense_thres=8, c_d=0.1, rho=1e9, pivot=pivot)
    levels, _ = factor.factorize(a.rows(), params)
    b = np.random.default_rng(1).standard_normal(144)
    assert np.linalg.norm(a.times(apply.solve(levels, b)) - b) <= 1e-9 * np.linalg.norm(b)


def test_symmetric_mode():
    a = stencil(12)
    levels, _ = factor.factorize(a.rows(), Params(**SMALL, is_symm=1, spd=1))
    b = np.ones(144)
    x, flag, _, rel, _ = apply.gmres(a, levels, b)
    assert flag == 0 and rel <= 1e-6
    assert np.linalg.norm(a.times(x) - b) <= 1e-6 * 12


def test_several_right_sides_are_columns():
    a, _ = random(50, 0.08, 7)
    levels, _ = factor.factorize(a.rows(), Params(**SMALL))
    b = np.random.default_rng(2).standard_normal((50, 3))
    together = apply.solve(levels, b)
    for k in range(3):
        assert np.allclose(together[:, k], apply.solve(levels, b[:, k]))


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000))
def test_matching(n, seed):
    a, m = random(n, 0.2, seed)
    cols, s, t, complete = ordering.match(a.rows())
    scaled = abs(np.array(s)[:, None] * m * np.array(t)[None, :])
    assert complete and sorted(cols) == list(range(n))
    assert scaled.max() <= 1 + 1e-9
    assert scaled[np.arange(n), cols].min() >= 1 - 1e-9


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 60), st.integers(0, 10_000))
def test_orderings_are_permutations(n, seed):
    near = ordering.pattern(random(n, 0.1, seed)[0].rows())
    for order in (ordering.minimum_degree(near), ordering.cuthill_mckee(near)):
        ordering.check_order(order, n)


def test_structurally_singular():
    rows = [{0: 1.0}, {0: 2.0}, {2: 1.0}]
    cols, _, _, complete = ordering.match(rows)
    assert not complete and sorted(cols) == [0, 1, 2]
    levels, _ = factor.factorize(rows, Params())
    last = levels[-1]
    assert 3 - (last.n - last.m - last.solver.rank) == 2


@pytest.mark.parametrize("kind", [dense.QRCP, dense.LUP])
@pytest.mark.parametrize("is_complex", [False, True])
def test_dense_solvers(kind, is_complex):
    _, a = random(20, 0.9, 11, is_complex)
    b = np.random.default_rng(3).standard_normal((20, 2))
    f = kind(a)
    assert np.allclose(f.solve(b), np.linalg.solve(a, b))
    assert np.allclose(f.solve(b, trans=True), np.linalg.solve(a.conj().T, b))
    assert np.allclose(f.multiply(b), a @ b)
    assert np.allclose(f.multiply(b, trans=True), a.conj().T @ b)


def test_rank_and_least_squares():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 7)) @ rng.standard_normal((7, 30))
    f = dense.QRCP(a)
    b = a @ rng.standard_normal(30)
    assert f.rank == 7 and np.linalg.norm(a @ f.solve(b) - b) <= 1e-9 * np.linalg.norm(b)


@pytest.mark.parametrize("spd", [-1, 0, 1])
def test_eigenvalues(spd):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((10, 10)))
    w = np.array([5, 4, 3, 2, 1, -1, -2, -3, 0, 0.0])
    f = dense.SYEIG((q * w) @ q.T, spd=spd)
    assert f.rank == {0: 8, 1: 5, -1: 3}[spd]
    kept = w[w * spd > 0] if spd else w[w != 0]
    assert np.allclose(sorted(f.w[: f.rank]), sorted(kept))


def test_refinement_bounds_and_null_filter():
    a = stencil(10, 0.3)
    levels, _ = factor.factorize(a.rows(), Params(**SMALL))
    x, steps, flag = apply.refine(a, levels, np.ones(100), 16, (1e-10, 1.0))
    assert flag == 0 and steps <= 16 and np.linalg.norm(a.times(x) - 1) <= 1e-9
    assert apply.refine(a, levels, np.zeros(100), 4, (1e-6, 1.0))[1:] == (0, 0)
    assert abs(apply.null_filter(np.arange(10.0), 2, 6)[2:6].mean()) < 1e-12


def test_parameters():
    p = Params().with_droptol(1e-2).with_alpha(3).with_kappa(5)
    assert (p.tau_L, p.alpha_U, p.kappa_d) == (1e-2, 3, 5)
    assert Params().with_value("pivot", "on").pivot is Pivot.ON
    with pytest.raises(BadInput):
        Params().with_value("nothing", 1)
    deep = Params(kappa=9.0).at_level(2)
    assert deep.kappa == 3.0 and deep.tau_L == pytest.approx(1e-5) and deep.alpha_L == 20
    with pytest.raises(BadInput):
        factor.factorize([{5: 1.0}], Params())
    with pytest.raises(BadInput):
        factor.factorize([{0: float("nan")}], Params())


def test_matrix_market_parts(spark, tmp_path):
    """Parts in the order of their names, size lines in any form, complex vectors, a wrong count."""
    from pyspark.sql import functions as F

    from stratum.sources import matrix_market
    from stratum.types import BadInput

    x = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 7 % 1000).cast("double").alias("x"))
    matrix_market.write_vector(x, f"{tmp_path}/v", per_file=97)
    assert len(list((tmp_path / "v").glob("part-*"))) > 4
    assert sorted((r["i"], r["x"]) for r in matrix_market.read_vector(spark, f"{tmp_path}/v", "V").collect()) == [(i, i * 7 % 1000) for i in range(1000)]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a").write_text("%%MatrixMarket matrix coordinate real general\n% note\n\n")
    (tmp_path / "two" / "b").write_text("+7 07 3\n1 1 0.5\n% between\n7 7 3\n")
    (tmp_path / "two" / "c").write_text("2 3 4\n" + "\n" * 50)
    entries, sizes = matrix_market.read(spark, f"{tmp_path}/two", "A")
    assert sorted((r["i"], r["j"], r["v"]) for r in entries.collect()) == [(0, 0, 0.5), (1, 2, 4.0), (6, 6, 3.0)] and sizes.first()["nrows"] == 7
    (tmp_path / "h.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 1 0\n2 1 3 4\n")
    entries, _ = matrix_market.read(spark, f"{tmp_path}/h.mtx", "H")
    assert sorted((r["i"], r["j"], r["re"], r["im"]) for r in entries.collect()) == [(0, 0, 1.0, 0.0), (0, 1, 3.0, -4.0), (1, 0, 3.0, 4.0)]
    (tmp_path / "short.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 1\n2 1 3\n")
    for path, words in (("short.mtx", "declared"), ("two/b", "no|not"), ("two/c", "no|not")):
        with pytest.raises(BadInput):
            matrix_market.read(spark, f"{tmp_path}/{path}", "S")


def test_triangular_cycle(spark):
    from stratum.operators import triangular
    from stratum.types import BadInput

    ring = spark.createDataFrame([("T", k, (k + 1) % 3, 0.5) for k in range(3)], "mid string, i long, j long, v double")
    with pytest.raises(BadInput):
        triangular.levels(ring, spark.range(3).selectExpr("'T' AS mid", "id AS i"))


def test_lup_of_a_singular_block():
    from stratum.kernels.dense import LUP

    a = np.array([[2.0, 1, 1], [4, 2, 2], [1, 0, 3]])
    a[:, 2] = a[:, 0] + a[:, 1]
    found = LUP(a)
    x = found.solve(a @ np.array([1.0, 2.0, 0.0]))
    assert found.rank < 3 and np.isfinite(x).all() and np.isfinite(found.solve(np.ones(3), trans=True)).all()


def test_indices_beyond_one_run(spark):
    from stratum.operators import structure

    sizes = spark.createDataFrame([("A", 200_001), ("B", 1), ("C", 0)], "mid string, nrows long")
    found = structure.indices(sizes).groupBy("mid").agg({"i": "sum", "*": "count"}).collect()
    assert {(r["mid"], r["count(1)"], r["sum(i)"]) for r in found} == {("A", 200_001, 200_000 * 200_001 // 2), ("B", 1, 0)}


def test_orders_save_fill_and_bandwidth():
    """Minimum degree leaves less fill than the natural order, Cuthill-McKee a bandwidth of about a side."""
    side = 16
    near = ordering.pattern(stencil(side).rows())

    def fill(order):
        left, count = [set(x) - {i} for i, x in enumerate(near)], 0
        for k in order:
            count += len(left[k])
            for x in left[k]:
                left[x] |= left[k]
                left[x] -= {x, k}
        return count

    natural, amd = fill(range(side * side)), fill(ordering.minimum_degree(near))
    assert amd < 0.75 * natural
    order = ordering.cuthill_mckee(near)
    at = {k: p for p, k in enumerate(order)}
    assert max(abs(at[i] - at[j]) for i, x in enumerate(near) for j in x) <= side + 2


def test_counts_of_deferrals():
    """All deferrals are the rows not factorised, level by level; an abandoned level counts nothing."""
    for params in (Params(**SMALL), Params(**SMALL, pivot=Pivot.ON), Params(**SMALL, kappa=1.0, kappa_d=1.0)):
        levels, stats = factor.factorize(random(60, 0.06, 7)[0].rows(), params)
        assert stats[0] == sum(f.n - f.m for f in levels) >= stats[1] == stats[2] + stats[3]


def test_rank_by_1_norm():
    rng = np.random.default_rng(2)
    for n, r in ((12, 12), (12, 5), (12, 1), (3, 0)):
        a = rng.standard_normal((n, r)) @ rng.standard_normal((r, n))
        assert dense.QRCP(a, rank_norm=1).rank == r == dense.QRCP(a).rank
    graded = np.diag([1.0, 1e-4, 1e-8, 1e-12])
    assert dense.QRCP(graded, 1e6, rank_norm=1).rank == 2 and dense.QRCP(graded, 1e10, rank_norm=1).rank == 3


def test_tiny_pivots():
    """Entries are divided by a pivot whose reciprocal is beyond a double's range."""
    rows = [{0: 1e-310, 1: 2e-310}, {0: 3e-310, 1: 1.0}]
    params = Params(no_pre=1, kappa=1e9, kappa_d=float("inf"), tau_L=0, tau_U=0, pivot=Pivot.OFF, rf_par=0)
    level, *_ = factor.factor_level(rows, params, 1, None, [0] * 6, False)
    assert level.m == 2 and level.U[0] == {1: pytest.approx(2.0, rel=1e-3)} and level.L[1] == {0: pytest.approx(3.0, rel=1e-3)}


def test_options_as_text(caplog):
    from stratum.types import Verbose

    params = Params(tau_L=1e-7, verbose=Verbose.INFO | Verbose.FAC, reorder=Reorder.RCM, pivot=Pivot.ON, dense=Dense.LUP, rank_norm=1)
    assert Params.read(params.text()) == params and Params.read(Params().text()) == Params()
    assert "reorder" in str(params) and "rcm" in str(params)
    with caplog.at_level("INFO", "stratum"):
        factor.factorize(stencil(6).rows(), Params(**SMALL))
        assert not caplog.records
        levels, _ = factor.factorize(stencil(6).rows(), Params(**SMALL, verbose=Verbose.FAC))
    assert len(caplog.records) >= len(levels) - 1 and all(f.seconds > 0 for f in levels)


def test_single_keeps_the_dense_block_single():
    import pickle

    from stratum.plans import preconditioner

    frame = preconditioner.factor_frame("A", stencil(8), Params(**SMALL, single=1))
    last = pickle.loads(frame["blob"].iloc[-1])
    assert last.dense.dtype == np.float32 and last.solver.r.dtype == np.float32
    assert (frame["seconds"] > 0).all()
