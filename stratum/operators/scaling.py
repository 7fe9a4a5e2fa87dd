"""Scalings from extreme values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.product import scale
from stratum.operators.structure import indices
from stratum.sources.store import stored


def _reciprocal(coo: DataFrame, every: DataFrame, axis: str, root: bool = False) -> DataFrame:
    most = coo.groupBy("mid", F.col(axis).alias("k")).agg(F.max(F.abs("v")).alias("m")).withColumnRenamed("k", "i")
    m = F.sqrt("m") if root else F.col("m")
    return every.join(most, ["mid", "i"], "left").select("mid", "i", F.when(F.col("m") > 0, 1 / m).otherwise(1.0).alias("x"))


def unit(meta: DataFrame) -> DataFrame:
    return indices(meta).select("mid", "i", F.lit(1.0).alias("x"))


def extreme(coo: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to largest magnitude 1, then columns of the result; 1 where empty."""
    s = _reciprocal(coo, indices(meta), "i")
    t = _reciprocal(scale(coo, s), indices(meta, "ncols"), "j")
    return s, t


def iterative(coo: DataFrame, meta: DataFrame, sweeps: int = 5, rest: float = 1e-10, symmetric: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and columns scaled at once by 1 over the root of their largest magnitude, at most ``sweeps`` times."""
    coo = stored(coo)  # each sweep reads it a few times
    s, t = unit(meta), unit(meta.select("mid", F.col("ncols").alias("nrows")))
    by = lambda x, f: x.join(f.withColumnRenamed("x", "f"), ["mid", "i"]).select("mid", "i", (F.col("x") * F.col("f")).alias("x"))
    for _ in range(sweeps):
        now = scale(coo, s, t)
        r, c = _reciprocal(now, indices(meta), "i", True), _reciprocal(now, indices(meta, "ncols"), "j", True)
        if symmetric:
            both = r.join(c.withColumnRenamed("x", "y"), ["mid", "i"]).select("mid", "i", F.sqrt(F.col("x") * F.col("y")).alias("x"))
            r = c = both
        r, c = stored(r), stored(c)
        s, t = stored(by(s, r)), stored(by(t, c))  # each sweep reads the last one's factors
        far = r.union(c).agg(F.max(F.abs(1 - F.col("x") * F.col("x")))).first()[0]
        if far is None or far <= rest:
            break
    return s, t


def fix_poor(pairs: DataFrame, beta: float, level: int) -> DataFrame:
    """(mid, i, s, t): from level 2 on, factors of a matched pair that differ by ``beta`` become their geometric mean."""
    beta = 1e3 if beta < 0 else beta
    if level < 2 or beta <= 1:
        return pairs
    poor = F.least("s", "t") * beta < F.greatest("s", "t")
    mean = F.sqrt(F.col("s") * F.col("t"))
    return pairs.select("mid", "i", F.when(poor, mean).otherwise(F.col("s")).alias("s"), F.when(poor, mean).otherwise(F.col("t")).alias("t"))
