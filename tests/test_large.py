"""Algorithms on tables against dense algebra and the kernels, on small matrices cut into many parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.kernels import apply, ordering
from stratum.operators import dissection, graphs, matching, numbering, triangular
from stratum.plans import elimination, estimates, krylov, spectrum, tallqr
from stratum.types import BadInput

SMALL = "/root/testdata/sf0.001"


def coo(spark, a, mid="A"):
    i, j = np.nonzero(a)
    v = a[i, j]
    if np.iscomplexobj(a):
        return spark.createDataFrame([(mid, int(x), int(y), float(z.real), float(z.imag)) for x, y, z in zip(i, j, v)], "mid string, i long, j long, re double, im double")
    return spark.createDataFrame([(mid, int(x), int(y), float(z)) for x, y, z in zip(i, j, v)], "mid string, i long, j long, v double")


def vec(spark, x, mid="A"):
    if np.iscomplexobj(x):
        return spark.createDataFrame([(mid, k, float(v.real), float(v.imag)) for k, v in enumerate(x)], "mid string, i long, re double, im double")
    return spark.createDataFrame([(mid, k, float(v)) for k, v in enumerate(x)], "mid string, i long, x double")


def back(df, n, mid="A"):
    out = np.zeros(n, complex if "re" in df.columns else float)
    for r in df.where(F.col("mid") == mid).collect():
        out[r["i"]] = complex(r["re"], r["im"]) if "re" in df.columns else r["x"]
    return out


def grid(side, wind=0.3):
    a = np.zeros((side * side,) * 2)
    for x in range(side):
        for y in range(side):
            for dx, dy, v in ((0, 0, 4.0), (1, 0, -1 + wind), (-1, 0, -1 - wind), (0, 1, -1.0), (0, -1, -1.0)):
                if 0 <= x + dx < side and 0 <= y + dy < side:
                    a[y * side + x, (y + dy) * side + x + dx] = v
    return a


def test_running(spark):
    draw = np.random.default_rng(0)
    rows = [(m, int(k), int(draw.integers(5))) for m in ("a", "b") for k in draw.permutation(200)] + [("c", 7, 3)]
    df = spark.createDataFrame(rows, "mid string, i long, w long").repartition(7)
    got = {(r["mid"], r["i"]): r["at"] for r in numbering.running(df, ["i"], F.col("w")).collect()}
    ranks = {(r["mid"], r["i"]): r["at"] for r in numbering.running(df, ["w", "i"]).collect()}
    for m in ("a", "b", "c"):
        own = sorted((i, w) for k, i, w in rows if k == m)
        assert [got[m, i] for i, _ in own] == np.cumsum([0, *(w for _, w in own)])[:-1].tolist()
        assert [ranks[m, i] for i, _ in sorted(own, key=lambda r: (r[1], r[0]))] == list(range(len(own)))
    assert numbering.running(df.where("false"), ["i"]).count() == 0


@pytest.mark.parametrize("kind", ["lower", "upper", "shuffled", "complex"])
def test_triangular(spark, kind):
    draw = np.random.default_rng(1)
    n = 40
    a = np.tril((draw.random((n, n)) < 0.2) * draw.standard_normal((n, n)) / 3, -1)
    a = a.T.copy() if kind == "upper" else a
    if kind == "shuffled":
        p = draw.permutation(n)
        a = a[np.ix_(p, p)]
    a = a * (1 + 0.5j) if kind == "complex" else a
    y = draw.standard_normal(n) * (1 - 2j if kind == "complex" else 1)
    strict = coo(spark, a)
    assert np.allclose(back(triangular.solve(strict, vec(spark, y), 30), n), np.linalg.solve(np.eye(n) + a, y))
    assert np.allclose(back(triangular.solve_t(strict, vec(spark, y), 1 << 20), n), np.linalg.solve(np.eye(n) + a.conj().T, y))


def test_triangular_of_several(spark):
    """Two matrices and two right sides at once; a diagonal matrix; none."""
    draw = np.random.default_rng(2)
    a, b = (np.tril(draw.standard_normal((n, n)) / 9, -1) for n in (20, 9))
    strict = coo(spark, a).union(coo(spark, b, "B"))
    ys = {(m, k): draw.standard_normal(n) for m, n in (("A", 20), ("B", 9)) for k in (0, 40)}
    y = spark.createDataFrame([(m, k, i, float(v)) for (m, k), x in ys.items() for i, v in enumerate(x)], "mid string, k int, i long, x double")
    got = triangular.solve(strict, y, 25)
    for (m, k), x in ys.items():
        t = a if m == "A" else b
        assert np.allclose(back(got.where(F.col("k") == k), len(t), m), np.linalg.solve(np.eye(len(t)) + t, x))
    assert np.allclose(back(triangular.solve(strict.where("false"), vec(spark, np.arange(4.0))), 4), np.arange(4))
    assert triangular.solve(strict, y.where("false")).count() == 0


def test_triangular_cycle(spark):
    with pytest.raises(BadInput):
        triangular.solve(coo(spark, np.array([[0, 1.0], [1.0, 0]])), vec(spark, np.ones(2)))


@pytest.mark.parametrize("is_complex", [False, True])
def test_auction(spark, is_complex):
    draw = np.random.default_rng(3)
    n, epsilon = 25, 0.02
    a = (draw.random((n, n)) < 0.2) * draw.standard_normal((n, n)) * 10.0 ** draw.uniform(-3, 3, (n, n))
    a[np.arange(n), draw.permutation(n)] += 1.0
    a = a * (1 + 2j) if is_complex else a
    rows = matching.auction(coo(spark, a), (0.5, epsilon)).collect()
    i, j, s, t = (np.array([r[c] for r in rows]) for c in ("i", "j", "s", "t"))
    assert sorted(i.tolist()) == sorted(j.tolist()) == list(range(n))
    rowscale, colscale = np.zeros(n), np.zeros(n)
    rowscale[i], colscale[j] = s, t
    scaled = rowscale[:, None] * abs(a) * colscale
    assert scaled.max() <= 1 + 1e-9 and scaled[i, j].min() >= np.exp(-epsilon) - 1e-9
    x, y = np.nonzero(a)
    best = ordering.match(apply.Sparse(n, x, y, a[x, y]).rows())[0]
    assert np.log(abs(a[i, j])).sum() >= np.log(abs(a[np.arange(n), best])).sum() - n * epsilon - 1e-9


def test_auction_in_many_tasks(spark, monkeypatch):
    """Two parts without a common column are one round's work, however many bids they take; tasks that share columns, and rows
    that no task takes, agree in the end."""
    draw = np.random.default_rng(4)
    a = np.zeros((24, 24))
    a[:12, :12], a[12:, 12:] = draw.integers(1, 4, (2, 12, 12))
    written = []
    for entries, whole in ((144, 200), (30, 40), (30, 5)):
        monkeypatch.setattr(matching, "ENTRIES", entries)
        monkeypatch.setattr(matching, "WHOLE", whole)
        monkeypatch.setattr(matching, "drop", lambda *t: written.append(entries))
        rows = matching.auction(coo(spark, a), (0.02,)).collect()
        i, j, s, t = (np.array([r[c] for r in rows]) for c in ("i", "j", "s", "t"))
        assert sorted(i.tolist()) == sorted(j.tolist()) == list(range(24))
        scaled = s[:, None] * a[i][:, j] * t
        assert scaled.max() <= 1 + 1e-9 and np.diag(scaled).min() >= np.exp(-0.02) - 1e-9
    assert written.count(144) == 2


def test_auction_of_a_singular_matrix(spark):
    """Two rows with one column: one of them stays without."""
    a = np.array([[1.0, 0, 0], [5.0, 0, 0], [0, 1.0, 2.0]])
    rows = {r["i"]: r["j"] for r in matching.auction(coo(spark, a), rounds=12).collect()}
    assert sorted(map(str, rows.values())) == ["0", "2", "None"] and rows[2] == 2


def test_levels_without_dropping(spark):
    """All pivots and what is left are exact, so that one application solves the system."""
    a = grid(5)
    m = elimination.Levels(coo(spark, a), elimination.Rules(rest=7, tau=0.0, alpha=0.0, degree=1000, share=0.0))
    b = np.random.default_rng(4).standard_normal(25)
    assert np.allclose(back(m.solve(vec(spark, b)), 25), np.linalg.solve(a, b))
    stats = m.stats()
    assert len(stats) > 1 and stats[0]["rows"] == 25 and m.left == stats[-1]["rows"] - stats[-1]["eliminated"] <= 7 and m.fill() > 1
    near = {(i, j) for i, j in zip(*np.nonzero(a)) if i != j}
    own = [r["i"] for r in m.levels[0].pivots.collect()]
    assert not near & {(i, j) for i in own for j in own}


def test_levels_that_cannot_be(spark):
    with pytest.raises(BadInput):
        elimination.Levels(coo(spark, np.array([[0, 1.0], [1.0, 0]])), elimination.Rules(rest=1))


def test_fgmres(spark):
    """Several systems, one with a zero right side, and restarts; then with levels that drop, in fewer steps."""
    a, c = grid(4), grid(3, 0.0)
    entries = coo(spark, a).union(coo(spark, c, "C")).union(coo(spark, np.eye(3), "Z"))
    meta = spark.createDataFrame([("A", 16, 16), ("C", 9, 9), ("Z", 3, 3)], "mid string, nrows long, ncols long")
    x = np.random.default_rng(5).standard_normal(16)
    b = vec(spark, a @ x).union(vec(spark, c @ np.ones(9), "C")).union(vec(spark, np.zeros(3), "Z"))
    found = krylov.fgmres(entries, b, meta, rtol=1e-4, restart=5)
    assert np.allclose(back(found.x, 16), x, atol=1e-2) and np.allclose(back(found.x, 9, "C"), 1, atol=1e-2) and not back(found.x, 3, "Z").any()
    assert max(found.relative.values()) <= 1e-4 and found.steps["A"] > 5 and found.steps["C"] == 3 and found.steps["Z"] == 0
    m = elimination.Levels(coo(spark, a), elimination.Rules(rest=10, tau=0.02, alpha=2.0))
    one = krylov.fgmres(coo(spark, a), vec(spark, a @ x), meta.where("mid = 'A'"), m.solve, rtol=1e-4)
    assert np.allclose(back(one.x, 16), x, atol=1e-2) and one.steps["A"] < found.steps["A"]


def test_cuthill_mckee(spark):
    """The kernel's order exactly, with several components, single nodes and several matrices."""
    draw = np.random.default_rng(6)
    n = 36
    a = np.zeros((n, n))
    for first, end, share in ((0, 18, 0.12), (18, 30, 0.3)):
        a[first:end, first:end] = draw.random((end - first,) * 2) < share
    a[range(n), range(n)] = 1.0
    p = draw.permutation(n)
    a, b = a[np.ix_(p, p)], np.eye(7, k=1) + np.eye(7)
    entries = coo(spark, a).union(coo(spark, b, "B"))
    got = graphs.cuthill_mckee(entries)
    for mid, m in (("A", a), ("B", b)):
        i, j = np.nonzero(m)
        own = {r["i"]: r["p"] for r in got.where(F.col("mid") == mid).collect()}
        order = ordering.cuthill_mckee(ordering.pattern(apply.Sparse(len(m), i, j, m[i, j]).rows()))
        assert [own[k] for k in range(len(m))] == order
    widths = {r["mid"]: r["bandwidth"] for r in graphs.bandwidth(entries, got).collect()}
    assert widths["B"] == 1


@pytest.mark.parametrize("columns", [512, 6])
def test_tall_qr(spark, monkeypatch, columns):
    """Many blocks of rows; a rank that is less than the columns, which take part in a tournament in the second case."""
    monkeypatch.setattr(tallqr, "BYTES", 2_000)
    monkeypatch.setattr(tallqr, "FAN", 2)
    draw = np.random.default_rng(7)
    a, c = draw.standard_normal((70, 4)) @ draw.standard_normal((4, 14)), draw.standard_normal((30, 3))
    a[:, 5] = 0
    b, e = draw.standard_normal(70), c @ np.array([1.0, 2.0, 3.0])
    found = tallqr.least_squares(coo(spark, a).union(coo(spark, c, "C")), vec(spark, b).union(vec(spark, e, "C")), columns).collect()
    x = {(r["mid"], r["i"]): r["x"] for r in found}
    assert {(r["mid"], r["rank"]) for r in found} == {("A", 4), ("C", 3)} and len(x) == 13 + 3
    assert np.allclose([x["C", k] for k in range(3)], [1, 2, 3])
    mine = np.linalg.norm(a @ [x.get(("A", k), 0.0) for k in range(14)] - b)
    right = np.linalg.norm(a @ np.linalg.lstsq(a, b, rcond=None)[0] - b)
    assert abs(mine - right) < 1e-9 and all(abs(r["rest"] - right) < 1e-9 for r in found if r["mid"] == "A")


def test_spectrum(spark):
    """The leading eigenvalues of a symmetric and of a Hermitian matrix, and vectors; a space that is used up."""
    draw = np.random.default_rng(8)
    a = draw.standard_normal((24, 24))
    a = a + a.T
    h = draw.standard_normal((10, 10)) + 1j * draw.standard_normal((10, 10))
    h = h + h.conj().T
    meta = spark.createDataFrame([("A", 24, 24), ("I", 4, 4)], "mid string, nrows long, ncols long")
    values, vectors = spectrum.largest(coo(spark, a).union(coo(spark, 3 * np.eye(4), "I")), meta, 5, vectors=True)
    right = np.linalg.eigvalsh(a)
    assert np.allclose(values["A"], right[np.argsort(-abs(right))][:5], rtol=1e-8) and np.allclose(values["I"], [3.0])
    for k, value in enumerate(values["A"]):
        x = back(vectors.where(F.col("k") == k), 24)
        assert abs(np.linalg.norm(x) - 1) < 1e-9 and np.linalg.norm(a @ x - value * x) < 1e-6
    double, sizes = spectrum.as_real(coo(spark, h), spark.createDataFrame([("A", 10, 10)], "mid string, nrows long, ncols long"))
    found, _ = spectrum.largest(double, sizes, 3)
    right = np.linalg.eigvalsh(h)
    assert np.allclose(found["A"], right[np.argsort(-abs(right))][:3], rtol=1e-8)


def test_spectrum_of_equal_blocks(spark):
    """From ones on, blocks of one eigenvalue have equal parts in its vector, as the power method's."""
    a = np.kron(np.eye(2), np.ones((3, 3)) - np.eye(3))
    meta = spark.createDataFrame([("A", 6, 6)], "mid string, nrows long, ncols long")
    values, vectors = spectrum.largest(coo(spark, a), meta, 1, vectors=True, start=vec(spark, np.ones(6)))
    assert np.allclose(values["A"], [2.0]) and np.allclose(back(vectors, 6), back(vectors, 6)[0]) and abs(np.linalg.norm(back(vectors, 6)) - 1) < 1e-12


@pytest.mark.parametrize("read", [lambda s, d, t: t.part_supplier(s, d)[0], lambda s, d, t: t.sharing(s, d)])
def test_tasks_of_lines_do_not_grow(spark, monkeypatch, read):
    """More lines are dealt over more tasks, with the same entries."""
    from conftest import SMALL
    from stratum.sources import tables

    right = {(r["i"], r["j"]): r["v"] for r in read(spark, SMALL, tables).collect()}
    monkeypatch.setattr(tables, "LINES", 200)
    lines = tables.table(spark, SMALL, "lineitem")
    assert tables.dealt(lines, "l_orderkey").rdd.getNumPartitions() >= lines.count() / 200
    assert {(r["i"], r["j"]): r["v"] for r in read(spark, SMALL, tables).collect()} == right


def test_inverse_norm(spark):
    draw = np.random.default_rng(9)
    mats = {"A": np.tril(draw.standard_normal((20, 20)), -1), "B": -np.tril(np.ones((8, 8)), -1), "C": np.zeros((3, 3))}
    entries = coo(spark, mats["A"]).union(coo(spark, mats["B"], "B"))
    nodes = spark.createDataFrame([(m, k) for m, t in mats.items() for k in range(len(t))], "mid string, i long")
    got = {r["mid"]: r["norm"] for r in estimates.triangle_inverse_norm1(entries, nodes, 40).collect()}
    for m, t in mats.items():
        right = np.linalg.norm(np.linalg.inv(np.eye(len(t)) + t), 1)
        assert right / 3 <= got[m] <= right * (1 + 1e-9)


def fill(near, order):
    """Entries under the diagonal of the factor, by merging each column into its parent."""
    at = np.argsort(order)
    columns = [set() for _ in order]
    for i, j in near:
        if at[j] > at[i]:
            columns[at[i]].add(int(at[j]))
    for k, own in enumerate(columns):
        if own:
            parent = min(own)
            columns[parent] |= own - {parent}
    return sum(map(len, columns))


def test_nested_dissection(spark, monkeypatch):
    """A grid, a star, a ring and loose nodes at once: whole orders, no edge across a separator, less fill than the grid's natural order."""
    monkeypatch.setattr(dissection, "COARSE", 60)
    a = grid(20)
    star, ring, loose = np.eye(90), np.eye(90) + np.roll(np.eye(90), 1, axis=1), np.eye(90)
    star[0] = star[:, 0] = 1
    table = coo(spark, a).union(coo(spark, star, "S")).union(coo(spark, ring, "R")).union(coo(spark, loose, "L"))
    near = graphs.neighbours(table)
    nodes = dissection.stored(table.select("mid", "i").distinct())
    parts = dissection.dissected(near, nodes, 40)
    assert dissection.crossing(near, parts).count() == 0
    inside = parts.where("not endswith(part, '2')").groupBy("mid", "part").count()
    assert inside.agg(F.max("count")).first()[0] <= 40
    found = {}
    for r in dissection.ordered(near, parts, 40).collect():
        found.setdefault(r["mid"], {})[r["i"]] = r["p"]
    for m, n in (("A", 400), ("S", 90), ("R", 90), ("L", 90)):
        assert sorted(found[m]) == sorted(found[m].values()) == list(range(n))
    edges = [(r["i"], r["j"]) for r in near.where("mid = 'A'").collect()]
    assert fill(edges, [found["A"][k] for k in range(400)]) < 0.75 * fill(edges, list(range(400)))
    assert dissection.nested_dissection(table.where("false")).count() == 0


def test_components_are_packed_on_two_sides(spark, monkeypatch):
    """Components that balance are not cut; of others only the largest is, between the rest. Loose nodes are halved, not peeled off."""
    import pandas as pd

    def sides(sizes):
        first = np.cumsum([0, *sizes[:-1]])
        path = [(a + k, a + k + 1) for a, n in zip(first, sizes) for k in range(n - 1)]
        edges = pd.DataFrame(path + [(j, i) for i, j in path], columns=["i", "j"]).assign(w=1.0)
        nodes = pd.DataFrame({"mid": "A", "part": "", "i": range(sum(sizes)), "p": 1.0})
        return [dissection._fiedler(nodes, edges)["x"].to_numpy()[a : a + n] for a, n in zip(first, sizes)]

    found = sides([10, 9, 3, 2, 1, 1])
    assert all(len(set(x)) == 1 for x in found) and sum(len(x) * x[0] for x in found) == 0
    large, *others = sides([20, 3, 2, 1])
    assert (abs(large) <= 0.5).all() and (large > 0).sum() == 10 and len({x[0] for x in others}) == 2
    monkeypatch.setattr(dissection, "COARSE", 60)
    nodes = spark.range(130).select(F.lit("L").alias("mid"), F.col("id").alias("i"))
    parts = dissection.dissected(coo(spark, np.eye(2)).select("mid", "i", "j").where("i <> j"), dissection.stored(nodes), 40)
    assert parts.count() == 130 and parts.agg(F.max(F.length("part"))).first()[0] <= 3


def test_products_of_runs_and_of_heavy_inner_indices(spark, monkeypatch):
    """Runs of a few inner indices, rows at a time, and an index with too many products for a task, give the same sums."""
    from stratum.operators import product

    rng = np.random.default_rng(5)
    dense = np.where(rng.random((30, 40)) < 0.2, rng.integers(1, 9, (30, 40)), 0).astype(float)
    dense[:, 7] = 1.0
    other = np.where(rng.random((40, 25)) < 0.2, rng.integers(-4, 5, (40, 25)), 0).astype(float)
    other[7] = 2.0
    table = lambda m: spark.createDataFrame([("A", int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "mid string, i long, j long, v double")
    monkeypatch.setattr(product, "BLOCK", 300)
    monkeypatch.setattr(product, "CHUNK", 40)
    got = np.zeros((30, 25))
    found = product.matmul(table(dense), table(other)).collect()
    for row in found:
        got[row["i"], row["j"]] = row["v"]
    assert len(found) == np.count_nonzero((dense != 0).astype(int) @ (other != 0).astype(int))
    assert (got == dense @ other).all()
    assert len(list(product._products(table(dense).toPandas().rename(columns={"j": "k"}), table(other).toPandas().rename(columns={"i": "k"})))) > 1


def test_vector_of_over_a_thousand_files(spark, tmp_path):
    """A writer's files c1000 and on come after its c999."""
    from stratum.sources import matrix_market

    x = spark.range(0, 1030, 1, 1).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    matrix_market.write_vector(x, f"{tmp_path}/v", per_file=1)
    assert [r["x"] for r in matrix_market.read_vector(spark, f"{tmp_path}/v", "P").orderBy("i").collect()] == list(range(1030))


def test_deferred_places_without_entries(spark):
    """Row 1 is empty: it is deferred, or has no place."""
    from stratum.operators import structure

    placed, meta = coo(spark, np.diag([1.0, 0, 3, 4])), spark.createDataFrame([("A", 4, 4)], "mid string, nrows long, ncols long")
    found = lambda **k: [(r["i"], r["p"]) for r in structure.defer_tiny(placed, meta, 3, 1e-3, **k).orderBy("i").collect()]
    assert found() == [(0, 0), (1, 2), (2, 1), (3, 3)]
    assert found(empty=False) == [(0, 0), (1, 2), (3, 3)]


def test_sweeps_evaluate_the_matrix_once(spark):
    """The entries' plan, which may be a costly join, runs once for all sweeps."""
    from stratum.operators import scaling

    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for frame in batches:
            seen.add(len(frame))
            yield frame

    a = coo(spark, np.array([[1.0, 8, 0], [2, 4, 3], [0, 5, 100]]))
    meta = spark.createDataFrame([("A", 3, 3)], "mid string, nrows long, ncols long")
    s, t = scaling.iterative(a.mapInPandas(rows, a.schema), meta)
    assert s.count() == t.count() == 3 and seen.value == a.count()


def test_least_squares_of_parts(spark):
    """More columns than a triangle may have, in parts without a common row: all of them are solved for."""
    draw = np.random.default_rng(6)
    a = np.zeros((30, 11))
    a[:14, :5], a[14:29, 5:] = draw.standard_normal((14, 5)), draw.standard_normal((15, 6))
    b = draw.standard_normal(30)
    rows = tallqr.least_squares(coo(spark, a), vec(spark, b), columns=6).orderBy("i").collect()
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.allclose([r["x"] for r in rows], want) and {r["rank"] for r in rows} == {11}
    assert np.allclose([r["rest"] for r in rows], np.linalg.norm(b - a @ want))


def test_deferral_looks_at_all_positions(spark):
    """The query's positions are all there, and no tiny diagonal lies before another one, from 60 on too."""
    from stratum.plans import relational

    placed, meta = relational._placed(spark, SMALL)
    n, found = meta.first()["nrows"], {r["i"]: r["p"] for r in relational.QUERIES["defer_tiny_diags"](spark, SMALL).collect()}
    a = np.zeros((n, n))
    for r in placed.collect():
        a[r["i"], r["j"]] = abs(r["v"])
    tiny = np.diag(a) <= 1e-3 * np.maximum(a.max(axis=0), a.max(axis=1))
    assert n > 60 and [found[k] for k in range(n)] == sorted(range(n), key=lambda p: (tiny[p], p))


def test_validity_joins_no_places(spark):
    """What meets the sizes is a row of each matrix: with few matrices a join by matrix would put all places into few tasks."""
    from stratum.operators import structure

    a = spark.createDataFrame([("A", 0, 0, 1.0), ("A", 0, 0, 2.0), ("B", 0, 2, 1.0), ("C", -1, 0, 1.0), ("D", 1, 1, float("inf")), ("E", 1, 1, 1.0)], "mid string, i long, j long, v double")
    meta = spark.createDataFrame([(m, 2, 2) for m in "ABCDEF"], "mid string, nrows long, ncols long")
    found = structure.validity(a, meta)
    rows = {r["mid"]: tuple(r)[1:] for r in found.collect()}
    assert rows == {"A": (False, True, True, 2), "B": (True, False, True, 1), "C": (True, False, True, 1), "D": (True, True, False, 1), "E": (True, True, True, 1), "F": (True, True, True, 0)}
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


@pytest.mark.parametrize("kind", ["full", "dependent", "near"])
def test_least_squares_of_one_wide_part(spark, kind):
    """More columns than a triangle may have, all of one part: none is left out, but those that depend on others."""
    draw = np.random.default_rng(9)
    a = (draw.random((60, 14)) < 0.5) * draw.standard_normal((60, 14))
    if kind == "dependent":
        a[:, [4, 12]] = a[:, [0, 1]] + a[:, [2, 3]]
    if kind == "near":
        a[:, 7] = a[:, 2] + 1e-6 * draw.standard_normal(60)
    b = draw.standard_normal(60) if kind != "near" else a @ np.ones(14)
    rows = tallqr.least_squares(coo(spark, a), vec(spark, b), columns=6).orderBy("i").collect()
    x, want = np.array([r["x"] for r in rows]), np.linalg.lstsq(a, b, rcond=1e-10)[0]
    assert len(x) == 14 and {r["rank"] for r in rows} == {12 if kind == "dependent" else 14}
    rest = np.linalg.norm(b - a @ want)
    assert abs(np.linalg.norm(b - a @ x) - rest) < 1e-9 and all(abs(r["rest"] - rest) < 1e-9 for r in rows)
    assert kind == "dependent" or np.allclose(x, want, atol=1e-7)


def test_portions_are_bounded(spark, monkeypatch):
    """Blocks of a large triangle hold what a task may hold, not a share of the triangle."""
    monkeypatch.setattr(triangular, "ENTRIES", 50)
    strict = coo(spark, np.tril(np.ones((40, 40)), -1))
    assert triangular.portion(strict, 8) == 50 and triangular.portion(strict.where("i < 12"), 3) == 22
    y = np.arange(40.0)
    found = back(triangular.solve(strict, vec(spark, y), triangular.portion(strict, 8)), 40)
    assert np.allclose(found, np.linalg.solve(np.tril(np.ones((40, 40))), y))


def test_products_are_held_in_bounded_chunks():
    """A task's products at once: a row of each chunk, or CHUNK of them."""
    import pandas as pd

    from stratum.operators import product

    rows, ks = np.divmod(np.arange(3000 * 40), 40)
    left, right = pd.DataFrame({"i": rows, "k": ks, "v": 1.0}), pd.DataFrame({"k": np.repeat(np.arange(40), 50), "j": np.tile(np.arange(50), 40), "v": 2.0})
    parts = list(product._products(left, right))
    assert max(40 * 50 * p["i"].nunique() for p in parts) <= 1 << 20 and sum(len(p) for p in parts) == 3000 * 50
    assert all((p["v"] == 80).all() for p in parts)
