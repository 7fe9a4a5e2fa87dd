"""Whitening of vectors by a compensated covariance.

The fit list is each distinct vector of whole numbers once. Its sums S are exact, so n * x - S is exact too, and the
centred vector is kept as two doubles, high and low. Outer products of centred vectors are summed in double-double: an
error-free transformation cuts columns into slices of few bits (Ozaki, Ogita, Oishi and Rump, 2012), products of slices
over SLICED rows are exact doubles, and two-sums gather them into a high and a low part. Tasks give both parts, which
are merged by two-sums, some tasks' parts at a time. The eigenvectors come from LAPACK's divide and conquer on the
tridiagonal form (``numpy.linalg.eigh``) and are refined against the covariance in double-double (Ogita and Aishima,
2018). Only matrices of dimension by dimension reach the driver.

``identity_error`` is measured: the whitened fit list's own covariance, summed the same way, against the identity.

Defined results: vectors that are null or hold null or non-finite components take no part; a vector shorter than the
longest is as if 0 followed; repeated ids are rows of their own and null ids are kept; a component without variance
(under 1e-20 of the trace) has a null ``whitened``, an ``explained`` of 0 (null where the trace is 0) and no part in
``identity_error``, which is null without any; a deviation beyond a long's range is null; a component beyond a long's
range is an error; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common, vectors

#: Rows of one exact product of slices, a slice's bits (twice them and the rows' make a double's 53), slices of a column.
SLICED, BITS, SLICES = 1024, 21, 5
#: Parts of tasks that are merged at once are about the parts over SALTS.
SALTS = 64
#: Share of the trace from which a component counts as having variance.
LEAST = 1e-20

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b) -> Pair:
    """a * b and its error, by halves of the factors."""
    split = lambda x: (h := (c := x * 134217729.0) - (c - x), x - h)
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def plus(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    return two_sum(s, e + (x[1] + y[1]))


def over(x: Pair, n: float) -> Pair:
    q = x[0] / n
    p, e = two_product(q, np.float64(n))
    return two_sum(q, (((x[0] - p) - e) + x[1]) / n)


def slices(x: Pair) -> list[np.ndarray]:
    """Columns of x as sums of SLICES columns of BITS bits each, down from the column's largest magnitude."""
    high, low = two_sum(*x)
    out, top = [], np.frexp(np.abs(high).max(axis=0, initial=0))[1]
    for _ in range(SLICES):
        grid = np.ldexp(1.5, 52 + top - BITS)
        cut = (high + grid) - grid
        out.append(cut)
        high, low = two_sum(high - cut, low)
        top = top - BITS
    return out


def cross(x: Pair, y: Pair | None = None) -> Pair:
    """x' y (x' x) in double-double; what is left out is about 2 ** -100 of the columns' largest magnitudes."""
    total = (np.zeros((x[0].shape[1], (x if y is None else y)[0].shape[1])),) * 2
    for at in range(0, len(x[0]), SLICED):
        part = lambda z: slices((z[0][at : at + SLICED], z[1][at : at + SLICED]))  # noqa: B023, E731
        a = part(x)
        b = a if y is None else part(y)
        for i in range(SLICES):
            for j in range(SLICES - i):
                if y is not None or i <= j:
                    exact = a[i].T @ b[j]
                    total = plus(total, (exact, np.zeros_like(exact)))
                    if y is None and i < j:
                        total = plus(total, (exact.T, np.zeros_like(exact)))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, Pair]:
    """n * x - S exactly, and x - S / n as two doubles."""
    if n * vectors.largest(x) + max(map(abs, sums)) < vectors.EXACT:
        a = n * x - np.array(sums, np.int64)
        return a, over((a.astype(np.float64), np.zeros(a.shape)), n)
    a = n * x.astype(object) - np.array(sums, object)
    high = np.array([v / n for v in a.ravel()], np.float64)
    low = np.array([float(Fraction(v, n) - Fraction(h)) for v, h in zip(a.ravel(), high.tolist())], np.float64)
    return a, (high.reshape(a.shape), low.reshape(a.shape))


def _matrices(batches, width: int):
    for table in vectors.gathered(batches, SLICED, SLICED):
        yield table, vectors.dense(vectors.column(table, "x"), width)


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of the components."""

    def add(batches):
        n, sums = 0, np.zeros(width, object)
        for _, x in _matrices(batches, width):
            n += len(x)
            sums += x.sum(axis=0) if vectors.largest(x) * len(x) < 1 << 63 else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(int(v)) for v in (n, *sums)])], names=["i", "s"])

    parts = fit.select("x").mapInArrow(add, "i int, s string")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # a row a dimension
    return found.get(-1, 0), [found.get(k, 0) for k in range(width)]


def summed(rows: DataFrame, width: int, make, shape: tuple[int, int]) -> Pair:
    """The double-double sum over all rows of ``make``'s matrices, a pair for each block of rows."""
    kind = "i int, salt int, high array<double>, low array<double>"

    def add(batches):
        total = (np.zeros(shape),) * 2
        for _, x in _matrices(batches, width):
            total = plus(total, make(x))
        salt = TaskContext.get().partitionId() % SALTS  # where a task's parts meet those of others, the same when it runs again
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(np.full(shape[0], salt, np.int32)), *(pa.array(list(t)) for t in total)], names=["i", "salt", "high", "low"])

    def merge(table: pa.Table) -> pa.Table:
        total = (np.zeros(shape[1]),) * 2
        for high, low in zip(*(vectors.dense_doubles(vectors.column(table, c), shape[1]) for c in ("high", "low"))):
            total = plus(total, (high, low))
        return pa.table([table.column("i")[:1], table.column("salt")[:1], *(pa.array([t]) for t in total)], names=["i", "salt", "high", "low"])

    parts = rows.select("x").mapInArrow(add, kind).groupBy("i", "salt").applyInArrow(merge, kind)
    found = sorted(parts.groupBy("i").applyInArrow(merge, kind).collect(), key=lambda r: r["i"])  # a row a dimension
    if not found:
        return (np.zeros(shape),) * 2
    return np.array([r["high"] for r in found]), np.array([r["low"] for r in found])


def eigen(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and unit eigenvectors as columns, refined in double-double."""
    values, x = np.linalg.eigh((v[0] + v[0].T) / 2)
    none = np.zeros(x.shape)
    low = none
    for _ in range(3):
        pair = (x, low)
        gram = cross(pair)
        r = -plus(gram, (-np.eye(len(x)), none))[0]
        s = cross(pair, cross(v, pair))  # v is symmetric
        values = s[0].diagonal() / (1 - r.diagonal()) + s[1].diagonal()
        off = s[0] - np.diag(s[0].diagonal())
        close = 2 * (np.abs(off).sum(axis=0).max(initial=0) + np.abs(v[0]).max(initial=0) * np.abs(r).sum(axis=0).max(initial=0))
        gap = values - values[:, None]
        apart = np.abs(gap) > close
        e = np.where(apart, (s[0] + values * r) / np.where(apart, gap, 1.0), r / 2)
        x, low = plus(pair, (x @ e, none))
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def whitened(spark: SparkSession, rows: DataFrame, components: int = 16) -> DataFrame:
    """Per row of ``rows`` (id, x: whole numbers) and component: the columns of ``op13_whitening``, ``id`` for its id."""
    rows = common.stored(spark, rows.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<long>").alias("x")), "vectors")
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = rows.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    if not width:
        return spark.createDataFrame([], schema)
    fill = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = rows.withColumn("x", fill)
    fit = common.stored(spark, rows.select("x").distinct(), "fit")
    n, sums = totals(fit, width)
    covariance = over(summed(fit, width, lambda x: cross(centred(x, n, sums)[1]), (width, width)), n)
    values, basis = eigen(covariance)
    trace = float(np.trace(covariance[0]))
    values, basis = values[:components], basis[:, :components]
    live = values > LEAST * trace
    onto = basis[:, live] / np.sqrt(values[live])
    explained = np.where(live, values, 0.0) / trace if trace else np.full(len(values), np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        high, low = centred(x, n, sums)[1]
        return high @ onto + low @ onto

    kept, error = int(live.sum()), None
    if kept:
        ones = lambda x: np.ones((len(x), 1))
        flat = lambda z: (z, np.zeros(z.shape))
        mean = over(summed(fit, width, lambda x: cross(flat(ones(x)), flat(project(x))), (1, kept)), n)
        around = lambda x: plus(flat(project(x)), (-mean[0], -mean[1]))
        own = over(summed(fit, width, lambda x: cross(around(x)), (kept, kept)), n)
        error = float(np.abs(plus(own, flat(-np.eye(kept)))[0]).max())

    def show(batches):
        many = len(values)
        for table, x in _matrices(batches, width):
            a = centred(x, n, sums)[0]
            if vectors.largest(a) ** 2 * width < 1 << 63 and a.dtype != object:
                deviation = pa.array((a * a).sum(axis=1))
            else:
                deviation = pa.array([d if d < 1 << 63 else None for d in map(int, (a.astype(object) ** 2).sum(axis=1))], pa.int64())
            w = np.full((len(x), many), np.nan)
            w[:, live] = project(x)
            again = np.repeat(np.arange(len(x)), many)
            flat = [np.tile(np.arange(1, many + 1, dtype=np.int32), len(x)), np.full(len(again), n), w.ravel(), np.tile(explained, len(x))]
            shared = pa.array(np.full(len(again), np.nan if error is None else error), from_pandas=True)
            columns = [vectors.column(table, "id").take(pa.array(again)), pa.array(flat[0]), pa.array(flat[1], pa.int64()), deviation.take(pa.array(again))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, from_pandas=True) for c in flat[2:]), shared], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(show, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every row of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(vectors.usable("embedding"))
    found = whitened(spark, rows.select(F.col("vec_id").alias("id"), vectors.whole("embedding", 64, 1_000_000).alias("x")))
    return found.withColumnRenamed("id", "vec_id")
