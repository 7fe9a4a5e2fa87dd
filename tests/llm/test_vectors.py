"""The operators on vectors against brute force on small tables with every odd case."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import maxscore, negatives, vectors, whitening

ODD = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 1.0], [], [0.5]]


def table(spark, rows, extra=True):
    """(vec_id, embedding, label), with columns that clash with the operators' own."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("row", "id", "x", "score", "block", "asks", "terms", "pair", "rank")}) if extra else df


@pytest.fixture(scope="module")
def some():
    draw = np.random.default_rng(4)
    rows = [(k, [float(v) for v in draw.integers(-8, 9, 6) / 16], int(draw.integers(3))) for k in range(160)]
    rows += [(k, rows[k][1], rows[k][2]) for k in (0, 0, 50, 100, 7)]  # repeated rows
    rows += [(k, rows[100][1], 1) for k in range(160, 175)]  # ties
    rows += [(200 + 50 * k, v, k % 3) for k, v in enumerate(ODD)]
    rows += [(None, rows[3][1], 1), (None, rows[9][1], 2), (300, rows[3][1], None), (500, [0.0] * 6, 1)]
    return rows


def fit(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def inner(x, y, factor=256):
    return sum(math.floor(factor * a) * math.floor(factor * b) for a, b in zip(x, y))


def nulls_last(i):
    return (i is None, i or 0)


def found(df):
    return sorted(map(repr, map(tuple, df.collect())))


def searched(rows):
    rows = [r for r in rows if fit(r[1])]
    out = []
    for k, q in enumerate(rows):
        if q[0] is not None and q[0] % 50 == 0:
            scored = sorted((-inner(q[1], r[1]), nulls_last(r[0])) for j, r in enumerate(rows) if j != k)[:5]
            out += [(q[0], rank + 1, None if i[0] else i[1], -s) for rank, (s, i) in enumerate(scored)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("size", [32 << 20, 400])
def test_maxscore(spark, some, monkeypatch, size):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", size)
    monkeypatch.setattr(maxscore, "FIRST", 8)
    rows = maxscore.of_vectors(table(spark, some), "vec_id", "embedding", 256, F.col("vec_id") % 50 == 0)
    assert found(maxscore.top_k(spark, rows, 5)) == searched(some)


def test_maxscore_of_few_and_none(spark):
    few = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 0)]
    for rows in (few, few[:1], []):
        asked = maxscore.of_vectors(table(spark, rows), "vec_id", "embedding", 256, F.col("vec_id") % 50 == 0)
        assert found(maxscore.top_k(spark, asked, 5)) == searched(rows)


def test_maxscore_prunes_and_loses_nothing():
    """Sparse postings: whatever is needed, exactly the rows that reach it come back."""
    import pyarrow as pa

    draw = np.random.default_rng(1)
    n, width = 300, 40
    x = np.where(draw.random((n, width)) < 0.2, draw.integers(-20, 21, (n, width)), 0)
    lists = [np.flatnonzero(r) for r in x]
    postings = maxscore.Postings(pa.table({"terms": pa.array(lists, pa.list_(pa.int32())), "weights": pa.array([r[t] for r, t in zip(x, lists)], pa.list_(pa.int64())), "row": np.arange(n), "id": np.arange(n)}))
    probes = 0
    plain = postings.traverse
    for _ in range(40):
        q = np.where(draw.random(width) < 0.3, draw.integers(-9, 10, width), 0)
        terms = np.flatnonzero(q)
        scores = x @ q
        for needed in (None, -30, 0, 1, *np.sort(scores)[-20::5]):
            seen = []
            postings.traverse = lambda k, w, s: (seen.append(k), plain(k, w, s))  # noqa: B023
            at, got = postings.search(terms, q[terms], needed)
            right = np.arange(n) if needed is None else np.flatnonzero(scores >= needed)
            if needed is None or needed <= 0:
                assert at.tolist() == right.tolist()
            else:
                assert set(at.tolist()) >= set(right.tolist()) and (got >= needed).all()
                probes += len(seen) < len(terms)
            assert (got == scores[at]).all()
        assert len(postings.search(terms, q[terms], int(np.abs(q).sum()) * 21)[0]) == 0
    assert probes > 20


def mined(rows, moved=lambda i, label: label):
    rows = [(i, v, moved(i, label)) for i, v, label in rows if fit(v) and label is not None]
    out = []
    for k, a in enumerate(rows):
        if a[0] is not None and a[0] % 20 == 0:
            scored = [(-inner(a[1], r[1]), nulls_last(r[0]), r) for j, r in enumerate(rows) if j != k]
            near = sorted((s, i) for s, i, r in scored if r[2] == a[2])[:5]
            for p, i in near:
                far = sorted((s, j) for s, j, r in scored if r[2] != a[2] and -30 * p <= -100 * s <= -90 * p)[:10]
                out += [(a[0], None if i[0] else i[1], rank + 1, None if j[0] else j[1], -p, -s) for rank, (s, j) in enumerate(far)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("size", [32 << 20, 2000])
def test_negatives(spark, some, monkeypatch, size):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", size)
    monkeypatch.setattr(negatives, "TILE", 3)
    monkeypatch.setattr(negatives, "CANDIDATES", 20)
    rows = table(spark, some).where(vectors.usable("embedding"))
    asked = rows.select(F.col("vec_id").alias("id"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)).alias("is_anchor"), "label", vectors.whole("embedding", 256).alias("x"))
    assert found(negatives.mined(spark, asked)) == mined(some)
    none = negatives.mined(spark, asked.where("false"))
    assert none.count() == 0 and none.columns == negatives.mined(spark, asked).columns


def test_products_beyond_doubles():
    x = np.array([[2**30 + 1, 3], [1, 2**40 + 1]])
    assert vectors.Rows(x).times(vectors.Rows(x)).tolist() == [[(2**30 + 1) ** 2 + 9, 2**30 + 1 + 3 * (2**40 + 1)], [2**30 + 1 + 3 * (2**40 + 1), 1 + (2**40 + 1) ** 2]]
    kept = vectors.Best(2, 1)
    for score in ([2**60, 2**60 + 1, 2**60 - 1], [2**60 + 2]):
        n = len(score)
        kept.add(np.zeros(n, np.int64), np.array(score, object), np.zeros(n, bool), np.arange(n), np.arange(n))
    assert kept.score.tolist() == [2**60 + 2, 2**60 + 1] and kept.floor(0, 1)[0] == 2**60 + 1


def plain_whitening(x, ids, many):
    """The contract in exact rationals up to the covariance, which is rounded once."""
    once = sorted(set(map(tuple, x)))
    n, width = len(once), len(x[0])
    sums = [sum(r[k] for r in once) for k in range(width)]
    centred = [[n * r[k] - sums[k] for k in range(width)] for r in once]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n**3) for j in range(width)] for i in range(width)])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:many], basis[:, ::-1][:, :many]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(width)) for r in x]
    w = np.array([[n * a - s for a, s in zip(r, sums)] for r in x]) / n @ basis
    return n, deviation, w, values, float(np.trace(v))


@pytest.mark.parametrize("rows", ["some", "ragged", "flat"])
def test_whitening(spark, some, rows):
    if rows == "some":
        some = [r for r in some if not fit(r[1]) or len(r[1]) == 6]
    if rows == "flat":  # a constant dimension, and two that are alike
        draw = np.random.default_rng(2)
        some = [(k, [float(a), 7.5, float(a), float(b)], 0) for k, (a, b) in enumerate(draw.integers(0, 5, (60, 2)) / 4)]
    df = table(spark, some).where(vectors.usable("embedding"))
    got = whitening.whitened(spark, df.select(F.col("vec_id").alias("id"), vectors.whole("embedding", 64, 1_000_000).alias("x"))).collect()
    good = [r for r in some if fit(r[1])]
    width = max(len(r[1]) for r in good)
    x = [[math.floor(64 * v) + 1_000_000 for v in r[1]] + [0] * (width - len(r[1])) for r in good]
    n, deviation, w, values, trace = plain_whitening(x, [r[0] for r in good], 16)
    assert {r["n"] for r in got} == {n} and len(got) == len(good) * width
    assert sorted((repr(r["id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((repr(r[0]), d) for r, d in zip(good, deviation))
    assert all(r["identity_error"] < 1e-10 for r in got)
    for k in range(width):
        own = [r for r in got if r["component"] == k + 1]
        if values[k] < (1e-9 if rows == "flat" else 0) * trace:
            assert all(r["whitened"] is None and r["explained"] == 0 for r in own)
            continue
        assert all(abs(r["explained"] * trace - values[k]) < 1e-9 * values[k] + 1e-14 * trace for r in own)
        if min((abs(values[k] - v) for j, v in enumerate(values) if j != k), default=1) < 1e-6 * trace:
            continue
        mine, right = (sorted((repr(i), s * v) for i, v in zip(ids, vs)) for ids, vs, s in [([r["id"] for r in own], [r["whitened"] for r in own], 1), ([r[0] for r in good], w[:, k] / values[k] ** 0.5, 1)])
        other = sorted((i, -v) for i, v in right)
        close = lambda a, b: all(i == j and abs(u - v) < 1e-6 for (i, u), (j, v) in zip(a, b))
        assert close(mine, right) or close(mine, other)


def test_whitening_of_few_and_none(spark):
    shape = "vec_id long, embedding array<float>, label int"
    ask = lambda rows: whitening.whitened(spark, spark.createDataFrame(rows, shape).select(F.col("vec_id").alias("id"), vectors.whole("embedding", 64, 1_000_000).alias("x"))).collect()
    assert ask([]) == [] and ask([(1, [], 0)]) == []
    assert [tuple(r) for r in ask([(1, [2.0], 0), (1, [2.0], 0)])] == [(1, 1, 1, 0, None, None, None)] * 2


def test_double_double():
    """Sums that plain doubles lose, against whole numbers."""
    draw = np.random.default_rng(3)
    x = draw.integers(-(2**50), 2**50, (3000, 3)).astype(np.float64) * np.array([1.0, 2.0**-20, 2.0**30])
    high, low = whitening.cross((x, np.zeros(x.shape)))
    scaled = [[int(v * 2**20) for v in r] for r in x.tolist()]
    for i in range(3):
        for j in range(3):
            right = sum(r[i] * r[j] for r in scaled)
            mine = int(high[i, j]) * 2**40 + int(low[i, j] * 2**40) if high[i, j] >= 2**53 or high[i, j] <= -(2**53) else None
            assert mine is None or abs(mine - right) <= abs(right) * 2**-90 + 2**-80 * max(abs(r[i]) for r in scaled) * max(abs(r[j]) for r in scaled)


def test_centred_beyond_doubles():
    x = np.array([[2**55 + 1, 5], [2**55 + 4, 6]])
    a, (high, low) = whitening.centred(x, 2, [2**56 + 5, 11])
    assert a.tolist() == [[-3, -1], [3, 1]] and high.tolist() == [[-1.5, -0.5], [1.5, 0.5]] and not low.any()
