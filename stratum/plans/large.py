"""Queries of the algorithms that work on tables of any size, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.operators import dissection, graphs, matching, product, structure, triangular
from stratum.plans import elimination, estimates, krylov, spectrum, tallqr
from stratum.plans.relational import _PP, _PS, query
from stratum.sources import data_source, store, tables
from stratum.sources.store import stored

#: The suppliers' Gram matrix, each row over twice its sum: strict triangles of it have row sums under a half.
_GRAM = _PS + ", G AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM A a JOIN A b ON a.i = b.i GROUP BY a.j, b.j), W AS (SELECT i, sum(v) AS w FROM G GROUP BY i), H AS MATERIALIZED (SELECT i, j, v / (2 * w) AS v FROM G JOIN W USING (i))"


def _gram(spark, d, triangle):
    """The entries of the scaled Gram matrix for which ``triangle`` holds, stored."""
    a, meta = tables.part_supplier(spark, d)
    a = stored(a)
    g = stored(product.matmul(structure.transpose(a), a))
    store.drop(a)
    w = g.groupBy("mid", "i").agg(F.sum("v").alias("w"))
    kept = stored(g.where(triangle).join(w, ["mid", "i"]).select("mid", "i", "j", (F.col("v") / (2 * F.col("w"))).alias("v")))
    store.drop(g)
    return kept, meta


def _triangle_sql(upper: bool, transposed: bool, ks: tuple[int, ...] = ()) -> tuple[str, str]:
    """(base, query): substitution row by row, over a list of the values so far. Rows of an upper triangle count from the last."""
    lower = upper == transposed  # of what is solved
    i, j = ("j", "i") if transposed else ("i", "j")
    at = (lambda c: c) if lower else (lambda c: f"(nc - 1 - {c})")
    side = "(i % (k + 3) + 1)" if ks else "(i % 7 + 1)"
    sides = ", ".join(f"({k})" for k in ks or (0,))
    triangle = f"T AS MATERIALIZED (SELECT {at(i)} AS i, {at(j)} AS j, v FROM H, S WHERE i {'<' if upper else '>'} j)"
    rows = f"D AS MATERIALIZED (SELECT r.j AS o, {at('r.j')} AS i, list(coalesce(v, 0) ORDER BY c.j) FILTER (c.j < r.j) AS w FROM C r CROSS JOIN C c CROSS JOIN S LEFT JOIN T ON T.i = r.j AND T.j = c.j GROUP BY r.j, nc)"
    start = f"SELECT k, o, i, [CAST({side} AS DOUBLE)] AS xs FROM D, (VALUES {sides}) K(k) WHERE o = 0"
    step = f"SELECT k, D.o, D.i, list_append(xs, {side.replace('i %', 'D.i %')} - list_inner_product(w, xs)) FROM X JOIN D ON D.o = X.o + 1"
    base = f"RECURSIVE {_GRAM}, {triangle}, {rows}, X AS ({start} UNION ALL {step})"
    return base, f"SELECT 'PS' AS mid, {'k, ' * bool(ks)}i, round(xs[-1], 9) AS x FROM X"


def _triangular(name: str, upper: bool, transposed: bool, ks: tuple[int, ...] = ()) -> None:
    @query(name, *_triangle_sql(upper, transposed, ks))
    def run(spark, d):
        strict, meta = _gram(spark, d, "i < j" if upper else "i > j")
        y = structure.indices(meta, "ncols")
        if ks:
            y = y.select("mid", F.explode(F.array(*map(F.lit, ks))).alias("k"), "i")
        y = y.withColumn("x", (F.col("i") % (F.col("k") + 3 if ks else F.lit(7)) + 1).cast("double"))
        # About eight blocks of a small table, so that some of its rows wait for those of another task too; more of a large one.
        solve = triangular.solve_t if transposed else triangular.solve
        return solve(strict, y, triangular.portion(strict, 8)).withColumn("x", F.round("x", 9))

    run.__doc__ = f"{'Upper' if upper else 'Lower'} triangle of the suppliers' Gram matrix{', transposed' if transposed else ''}{', several right sides' if ks else ''}."


_triangular("trisolve_lower", False, False)
_triangular("trisolve_upper", True, False)
_triangular("trisolve_lower_t", False, True)
_triangular("trisolve_upper_t", True, True)
_triangular("trisolve_mrhs", False, False, (0, 1, 2))
_triangular("trisolve_mrhs_t", False, True, (0, 1))


_COMPLEX = f"RECURSIVE {_GRAM}, D AS MATERIALIZED (SELECT r.j AS i, list(coalesce(v, 0) ORDER BY c.j) FILTER (c.j < r.j) AS w, list(coalesce(v, 0) * (r.j % 3 - c.j % 3) ORDER BY c.j) FILTER (c.j < r.j) AS z FROM C r CROSS JOIN C c LEFT JOIN H ON H.i = r.j AND H.j = c.j GROUP BY r.j), X AS (SELECT i, [1.0::DOUBLE] AS xr, [0.0::DOUBLE] AS xi FROM D WHERE i = 0 UNION ALL SELECT D.i, list_append(xr, D.i % 7 + 1 - list_inner_product(w, xr) + list_inner_product(z, xi)), list_append(xi, D.i % 2 - list_inner_product(w, xi) - list_inner_product(z, xr)) FROM X JOIN D ON D.i = X.i + 1)"
_SOLVED = "SELECT 'PS' AS mid, i, round(xr[-1], 9) AS re, round(xi[-1], 9) AS im FROM X"


def _complex_triangle(spark, d):
    g, meta = _gram(spark, d, "i > j")
    strict = g.select("mid", "i", "j", F.col("v").alias("re"), (F.col("v") * (F.col("i") % 3 - F.col("j") % 3)).alias("im"))
    y = structure.indices(meta, "ncols").select("mid", "i", (F.col("i") % 7 + 1).cast("double").alias("re"), (F.col("i") % 2).cast("double").alias("im"))
    return strict, y


def _rounded(x):
    return x.select("mid", "i", *(F.round(c, 9).alias(c) for c in ("re", "im")))


@query("trisolve_complex", _COMPLEX, _SOLVED)
def trisolve_complex(spark, d):
    strict, y = _complex_triangle(spark, d)
    return _rounded(triangular.solve(strict, y, triangular.portion(strict, 8)))


@query("trisolve_complex_h", _COMPLEX, _SOLVED)
def trisolve_complex_h(spark, d):
    """The adjoint of the triangle's adjoint, an upper one, is solved like the triangle."""
    strict, y = _complex_triangle(spark, d)
    upper = structure.transpose_conjugate(strict)
    return _rounded(triangular.solve_t(upper, y, triangular.portion(strict, 8)))


_SS = "E AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), A AS MATERIALIZED (SELECT a.s AS i, b.s AS j, CAST(count(*) AS DOUBLE) AS v FROM E a JOIN E b ON a.o = b.o AND a.s <> b.s GROUP BY a.s, b.s)"
EPSILON = 0.05


@query("auction_matching", _SS, "SELECT 'SS' AS mid, count(DISTINCT i) AS nrows, count(DISTINCT j) AS matched, TRUE AS at_most_one, TRUE AS near_one_on_matching, TRUE AS proved FROM A")
def auction_matching(spark, d):
    """Suppliers matched by shared orders. The scalings are a dual solution: they prove the product to be the largest,
    but for a factor of exp(n * EPSILON)."""
    a = stored(tables.sharing(spark, d))
    found = stored(matching.auction(a, (EPSILON,)))
    sizes = matching.scaled_sizes(a, found.where("j is not null"))
    own = sizes.join(found.select("mid", "i", "j", F.lit(True).alias("own")), ["mid", "i", "j"], "left")
    seen = own.groupBy("mid").agg(
        F.countDistinct("i").alias("nrows"), F.countDistinct(F.when(F.col("own"), F.col("j"))).alias("matched"), (F.max("size") <= 1 + 1e-9).alias("at_most_one"),
        (F.min(F.when(F.col("own"), F.col("size"))) >= F.exp(F.lit(-EPSILON)) - 1e-9).alias("near_one_on_matching"), F.sum(F.when(F.col("own"), F.log("v"))).alias("mine"),
    )
    most = found.groupBy("mid").agg((-F.sum(F.log("s")) - F.sum(F.log("t"))).alias("most"), F.count("*").alias("n"))
    return seen.join(most, "mid").select("mid", "nrows", "matched", "at_most_one", "near_one_on_matching", (F.col("mine") >= F.col("most") - EPSILON * F.col("n") - 1e-6).alias("proved"))


@query("level_rebuilt", _PP, "SELECT 'PP' AS mid, i, j, round(v, 9) AS v FROM A")
def level_rebuilt(spark, d):
    """A level without dropping, put together again: D, E and F as they are, the rest as E D^-1 F and the Schur complement."""
    a, _ = tables.coupled_parts(spark, d)
    made = elimination.level(stored(a), elimination.Rules(tau=0.0, alpha=0.0))
    diagonal = made.pivots.select("mid", "i", F.col("i").alias("j"), F.col("d").alias("v"))
    left = product.scale(made.e, None, made.pivots.select("mid", "i", (1 / F.col("d")).alias("x")))
    rest = structure.assemble(made.schur.union(product.matmul(left, made.f)))
    # Places that only the level filled are whole numbers' cancelled products.
    rest = rest.where(F.abs("v") > 1e-12)
    return diagonal.union(made.e).union(made.f).union(rest).select("mid", "i", "j", F.round("v", 9).alias("v"))


@query("level_gmres", _PP, "SELECT 'PP' AS mid, i, ((i % 7) + 1)::DOUBLE AS x FROM R")
def level_gmres(spark, d):
    """Levels over tables precondition GMRES over tables; the solution is known."""
    a, meta = tables.coupled_parts(spark, d)
    a = stored(a)
    b = product.multiply(a, tables.vector(meta, F.col("i") % 7 + 1), meta)
    n = meta.first()["nrows"]
    m = elimination.Levels(a, elimination.Rules(rest=max(50, n // 4)))
    found = krylov.fgmres(a, b, meta, m.solve, rtol=1e-10)
    return found.x.select("mid", "i", F.round("x", 6).alias("x"))


_SSR = "E AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1995-07-01'), A AS MATERIALIZED (SELECT DISTINCT a.s AS i, b.s AS j FROM E a JOIN E b ON a.o = b.o AND a.s <> b.s), D AS MATERIALIZED (SELECT i, count(*) AS deg FROM A GROUP BY i)"
_WALK = _SSR + """, W(a, b, d) AS (SELECT i, i, 0 FROM D UNION SELECT W.a, A.j, d + 1 FROM W JOIN A ON A.i = W.b WHERE d < 12),
M AS MATERIALIZED (SELECT a, b, min(d) AS d FROM W GROUP BY a, b), X AS MATERIALIZED (SELECT a, max(d) AS ecc, min(b) AS c FROM M GROUP BY a),
V AS MATERIALIZED (SELECT M.a, arg_min(b, (deg, b)) AS far FROM M JOIN X ON X.a = M.a AND M.d = ecc JOIN D ON D.i = b GROUP BY M.a),
O AS MATERIALIZED (SELECT c, min((deg, i)) AS start FROM X JOIN D ON D.i = X.a GROUP BY c),
P(c, root, ecc) AS (SELECT O.c, X.a, X.ecc FROM O JOIN X ON X.a = O.start[2] UNION ALL SELECT P.c, far, y.ecc FROM P JOIN V ON V.a = P.root JOIN X y ON y.a = far WHERE y.ecc > P.ecc),
N AS MATERIALIZED (SELECT A.i, list(A.j ORDER BY deg, A.j) AS ns FROM A JOIN D ON D.i = A.j GROUP BY A.i),
Q(c, k, q) AS (SELECT c, 1, [arg_max(root, ecc)] FROM P GROUP BY c UNION ALL SELECT c, k + 1, list_concat(q, list_filter(ns, lambda x: NOT list_contains(q, x))) FROM Q JOIN N ON N.i = q[k] WHERE k <= len(q)),
L AS (SELECT c, arg_max(q, k) AS q FROM Q GROUP BY c),
U AS MATERIALIZED (SELECT row_number() OVER (ORDER BY start, o) - 1 AS place, q[o] AS p, count(*) OVER () AS n FROM L JOIN O USING (c), unnest(range(1, len(q) + 1)) u(o)),
B AS (SELECT max(abs(x.place - y.place)) AS bandwidth FROM A JOIN U x ON x.p = A.i JOIN U y ON y.p = A.j)"""


@query("rcm_frontiers", "RECURSIVE " + _WALK, "SELECT 'SSr' AS mid, n - 1 - place AS i, p, bandwidth FROM U, B")
def rcm_frontiers(spark, d):
    """Reverse Cuthill-McKee of suppliers that share orders of half a year, and the bandwidth it leaves."""
    a = stored(tables.sharing(spark, d, "1995-01-01", "1995-07-01", "SSr"))
    order = stored(graphs.cuthill_mckee(a))
    return order.join(graphs.bandwidth(a, order), "mid").select("mid", "i", "p", "bandwidth")


@query("nested_dissection", _PP, "SELECT 'PP' AS mid, count(*) AS nodes, count(*) AS places, CAST(0 AS BIGINT) AS crossing FROM R")
def nested_dissection(spark, d):
    """Coupled parts by nested dissection: each has a place of its own, and no entry joins two sides of a separator."""
    a, meta = tables.coupled_parts(spark, d)
    # A leaf is a task's, so it does not grow with the table.
    a, leaf = stored(a), min(2_000, max(60, meta.first()["nrows"] // 4))
    near, nodes = graphs.neighbours(a), stored(a.select("mid", "i").distinct())
    parts = dissection.dissected(near, nodes, leaf)
    order = dissection.ordered(near, parts, leaf)
    places = order.groupBy("mid").agg(F.countDistinct("p").alias("nodes"), F.countDistinct("i").alias("places"))
    crossing = dissection.crossing(near, parts).groupBy("mid").agg(F.count("*").alias("crossing"))
    return places.join(crossing, "mid", "left").select("mid", "nodes", "places", F.coalesce("crossing", F.lit(0).cast("long")).alias("crossing"))


@query("tall_qr", _PS, "SELECT 'PS' AS mid, j AS i, CAST(j % 7 + 1 AS DOUBLE) AS x, CAST(nc AS INTEGER) AS rank FROM C, S")
def tall_qr(spark, d):
    """Least squares of parts by suppliers: a right side within its columns gives their known weights, all columns count."""
    a, meta = tables.part_supplier(spark, d)
    a = stored(a)
    b = product.multiply(a, tables.vector(meta, F.col("i") % 7 + 1), meta)
    return tallqr.least_squares(a, b).select("mid", "i", F.round("x", 6).alias("x"), "rank")


_POWER = "RECURSIVE " + _SS + ", D AS MATERIALIZED (SELECT DISTINCT i FROM A), F AS MATERIALIZED (SELECT r.i, list(coalesce(v, 0) ORDER BY c.i) AS w FROM D r CROSS JOIN D c LEFT JOIN A ON A.i = r.i AND A.j = c.i GROUP BY r.i), X(k, x) AS (SELECT 0, (SELECT list(1.0::DOUBLE / sqrt(n)) FROM D, (SELECT count(*) AS n FROM D)) UNION ALL SELECT k + 1, (SELECT list(y / z ORDER BY i) FROM (SELECT i, y, sqrt(sum(y * y) OVER ()) AS z FROM (SELECT i, list_inner_product(w, x) AS y FROM F))) FROM X WHERE k < 60)"


@query("lanczos", _POWER, "SELECT 'SS' AS mid, i, round(list_inner_product(w, x) / x[o], 6) AS value, round(x[o], 6) AS x FROM (SELECT i, w, row_number() OVER (ORDER BY i) AS o FROM F), X WHERE k = 60")
def lanczos(spark, d):
    """The largest eigenvalue of suppliers that share orders, and its vector of positive components: from ones on, so that
    components of one eigenvalue have the same parts in it as in its SQL."""
    a = stored(tables.sharing(spark, d))
    n = a.agg((F.max("i") + 1).alias("nrows")).select(F.lit("SS").alias("mid"), "nrows", F.col("nrows").alias("ncols"))
    ones = stored(a.select("mid", "i").distinct().withColumn("x", F.lit(1.0)))
    values, vectors = spectrum.largest(a, n, 1, vectors=True, start=ones)
    return vectors.join(ones.select("mid", "i"), ["mid", "i"], "left_semi").select("mid", "i", F.round(F.lit(values["SS"][0]), 6).alias("value"), F.round(F.abs("x"), 6).alias("x"))


_INVERSE = f"RECURSIVE {_GRAM}, D AS MATERIALIZED (SELECT r.j AS i, list(coalesce(v, 0) ORDER BY c.j) FILTER (c.j < r.j) AS w FROM C r CROSS JOIN C c LEFT JOIN H ON H.i = r.j AND H.j = c.j GROUP BY r.j), X AS (SELECT C.j AS k, i, [CASE WHEN C.j = 0 THEN 1.0::DOUBLE ELSE 0 END] AS xs FROM C, D WHERE i = 0 UNION ALL SELECT k, D.i, list_append(xs, CASE WHEN k = D.i THEN 1 ELSE 0 END + list_inner_product(w, xs)) FROM X JOIN D ON D.i = X.i + 1)"


@query("inverse_norm", _INVERSE, "SELECT 'PS' AS mid, round(max(n), 9) AS norm FROM (SELECT sum(abs(xs[-1])) AS n FROM X GROUP BY k)")
def inverse_norm(spark, d):
    """The 1-norm of (I - L)^-1 for the Gram matrix's lower triangle L: an inverse without negative entries, for which the
    estimate is the norm itself."""
    strict, meta = _gram(spark, d, "i > j")
    strict = strict.withColumn("v", -F.col("v"))
    found = estimates.triangle_inverse_norm1(strict, structure.indices(meta, "ncols"), triangular.portion(strict, 4))
    return found.select("mid", F.round("norm", 9).alias("norm"))


@query("mm_source", _PP, "SELECT i, j, v FROM A")
def mm_source(spark, d):
    """The coupled parts written and read by the Matrix Market data source, in ranges of 64 KB."""
    a, meta = tables.coupled_parts(spark, d)
    path = store.folder(spark)
    spark.dataSource.register(data_source.MatrixMarket)
    n = str(meta.first()["nrows"])
    a.select("i", "j", "v").write.format("matrixmarket").mode("append").option("nrows", n).option("ncols", n).save(path)
    return spark.read.format("matrixmarket").option("bytes", 1 << 16).load(path)
