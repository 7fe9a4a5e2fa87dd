"""Unit triangular solves (I + T)^-1 y over tables, for strict triangles in any order of rows.

Rows are numbered so that none waits for a later one: by index for a lower or upper triangle, by the longest chain
before them otherwise. They are cut into blocks of about ``entries`` entries in that order. A block waits for the blocks
that its rows' entries reach into; blocks at the same depth of that graph are solved in one job, each in a task of its
own, after one exchange: what the earlier rows add is a join and a sum. So jobs follow the depth of the blocks' graph,
not the chain of rows, and each value is written once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.numbering import running
from stratum.operators.structure import transpose, transpose_conjugate
from stratum.sources.store import Table, drop, stored
from stratum.types import BadInput

#: Entries of a block, which a task holds.
ENTRIES = 1 << 20
#: Right sides that a task holds at once.
SIDES = 32


def portion(strict: DataFrame, parts: int) -> int:
    """Entries of a block that cuts a triangle into about ``parts`` blocks; of a large triangle no more than a task holds."""
    return min(ENTRIES, max(16, strict.count() // parts))


def levels(strict: DataFrame, x: DataFrame) -> DataFrame:
    """(mid, i, level): the longest chain of rows that a row waits for; a cycle, which has none, is an error."""
    rows = x.groupBy("mid").count().agg(F.max("count")).first()[0] or 0
    at = stored(x.select("mid", "i", F.lit(0).alias("level")))
    for _ in range(rows + 1):
        after = strict.join(at.select("mid", F.col("i").alias("j"), "level"), ["mid", "j"]).groupBy("mid", "i").agg((F.max("level") + 1).alias("next"))
        new = stored(at.join(after, ["mid", "i"], "left").select("mid", "i", F.coalesce("next", F.lit(0)).alias("level"), F.col("level").alias("was")))
        at = new.select("mid", "i", "level")
        if not new.where("level <> was").limit(1).count():
            return at
    raise BadInput("rows that wait for each other: not a triangle in any order")


def blocks(strict: DataFrame, rows: DataFrame, entries: int) -> DataFrame:
    """(mid, i, o, block, level): each row's place in the order, its block, and the job that solves the block."""
    side = strict.agg(F.min(F.col("j") < F.col("i")).alias("lower"), F.min(F.col("j") > F.col("i")).alias("upper")).first()
    counts = strict.groupBy("mid", "i").agg(F.count("*").alias("n"))
    if side["lower"] is None or side["lower"] or side["upper"]:
        order = rows.withColumn("o", F.col("i") if side["lower"] is None or side["lower"] else -F.col("i"))
        by = ["o"]
    else:
        order, by = levels(strict, rows).withColumn("o", F.col("level").cast("long")).drop("level"), ["o", "i"]
    order = order.join(counts, ["mid", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")) + 1)
    placed = stored(running(order, by, F.col("n"), "before").select("mid", "i", F.floor(F.col("before") / entries).alias("block"), F.col("before").alias("o")))
    # The graph of blocks: a row for each pair of blocks with an entry between them.
    to, of = placed.select("mid", "i", F.col("block").alias("bi")), placed.select("mid", F.col("i").alias("j"), F.col("block").alias("bj"))
    graph = strict.join(to, ["mid", "i"]).join(of, ["mid", "j"]).where("bi <> bj").select("mid", F.col("bi").alias("i"), F.col("bj").alias("j")).distinct()
    graph = stored(graph)
    names = placed.select("mid", F.col("block").alias("i")).distinct()
    depth = _depths(graph, names)
    return stored(placed.join(depth.select("mid", F.col("i").alias("block"), "level"), ["mid", "block"]))


#: Pairs of blocks whose depths are found on the driver; a larger graph of blocks takes a job for each depth.
DRIVER_PAIRS = 1_000_000


def _depths(graph: DataFrame, names: DataFrame) -> DataFrame:
    if graph.count() > DRIVER_PAIRS:
        return levels(graph, names)
    pairs, depth = {}, {}
    for mid, i, j in graph.select("mid", "i", "j").toPandas().itertuples(index=False):
        pairs.setdefault((mid, i), []).append((mid, j))
    for key in sorted(pairs):  # a block waits for blocks of lower numbers only
        depth[key] = 1 + max(depth.get(k, 0) for k in pairs[key])
    spark = graph.sparkSession
    known = spark.createDataFrame([(m, int(i), int(d)) for (m, i), d in depth.items()], "mid string, i long, level int")
    return names.join(known, ["mid", "i"], "left").select("mid", "i", F.coalesce("level", F.lit(0)).alias("level"))


def _solved(rows: pd.DataFrame, inner: pd.DataFrame, values: list[str]) -> np.ndarray:
    """The values of a block's rows, in the order of ``rows`` (sorted by k, then o)."""
    complex_ = len(values) > 1
    of = lambda f, a, b: f[a].to_numpy(float) + (1j * f[b].to_numpy(float) if complex_ else 0.0)
    i, ks = rows["i"].to_numpy(), rows["k"].nunique()
    n = len(rows) // ks
    x = of(rows, *(values if complex_ else ["x", "x"])).reshape(ks, n).T.copy()
    place = pd.Series(np.arange(n), index=i[:n])
    at = lambda side: place.index.get_indexer(inner[side]).astype(np.int32)
    r = at("i")
    order = np.argsort(r, kind="stable")
    r, c = r[order], at("j")[order]
    v = of(inner, *(("re", "im") if complex_ else ("v", "v")))[order]
    cuts = np.flatnonzero(np.diff(r, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(r))):
        x[r[a]] -= v[a:b] @ x[c[a:b]]
    return x.T.reshape(-1)


def solve(strict: DataFrame, y: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(mid, [k,] i, x): (I + T)^-1 y for a strict triangle (lower, upper, or either in another order of rows).

    With a column ``k``, ``y`` is several right sides, each with all of its rows and solved for itself. Complex entries
    and vectors have ``re`` and ``im``. Rows that wait for each other are an error.
    """
    values = ["re", "im"] if "re" in y.columns else ["x"]
    side = ["k"] if "k" in y.columns else []
    given = y if side else y.withColumn("k", F.lit(0))
    given = given.select("mid", "k", "i", *(F.col(c).cast("double").alias(c) for c in values))
    at = blocks(strict, given.select("mid", "i").distinct(), entries)
    place = at.select("mid", "i", F.col("block").alias("bi"), F.col("level").alias("l"))
    known = at.select("mid", F.col("i").alias("j"), F.col("block").alias("bj"))
    table = stored(strict.join(place, ["mid", "i"]).join(known, ["mid", "j"]))
    given = stored(given.join(at, ["mid", "i"]))
    done = Table(y.sparkSession, given.select("mid", "k", "i", *values).schema)
    shape = f"mid string, k {dict(given.dtypes)['k']}, i long, " + ", ".join(f"{c} double" for c in values)

    def finish(rows: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "o"])
        found = _solved(rows, inner, values)
        parts = (found.real, found.imag) if len(values) > 1 else (found,)
        return rows[["mid", "k", "i"]].assign(**dict(zip(values, parts)))

    last = at.agg(F.max("level")).first()[0]
    for level in range(0 if last is None else last + 1):
        now = given.where(F.col("level") == level)
        if level:
            outer = table.where((F.col("l") == level) & (F.col("bi") != F.col("bj")))
            if len(values) > 1:
                had = done.read().select("mid", "k", F.col("i").alias("j"), F.col("re").alias("xr"), F.col("im").alias("xi"))
                terms = {"re": F.col("re") * F.col("xr") - F.col("im") * F.col("xi"), "im": F.col("re") * F.col("xi") + F.col("im") * F.col("xr")}
            else:
                had = done.read().select("mid", "k", F.col("i").alias("j"), F.col("x").alias("z"))
                terms = {"x": F.col("v") * F.col("z")}
            sums = outer.join(had, ["mid", "j"]).groupBy("mid", "k", "i").agg(*(F.sum(t).alias(f"_{c}") for c, t in terms.items()))
            now = now.join(sums, ["mid", "k", "i"], "left").withColumns({c: F.col(c) - F.coalesce(f"_{c}", F.lit(0.0)) for c in values})
        rows = now.select("mid", "block", "k", "i", "o", *values).withColumn("g", F.pmod(F.xxhash64("k"), F.lit(SIDES)).cast("int"))
        sides = rows.select("mid", "block", F.col("g").alias("side")).distinct()
        inner = table.where((F.col("l") == level) & (F.col("bi") == F.col("bj"))).drop("bj", "l").withColumnRenamed("bi", "block")
        inner = inner.join(sides, ["mid", "block"])
        done.add(rows.groupBy("mid", "block", "g").cogroup(inner.groupBy("mid", "block", "side")).applyInPandas(finish, shape))
    drop(table, given)
    return done.read().select("mid", *side, "i", *values)


def solve_t(strict: DataFrame, y: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(I + T)^-T y; for complex entries (I + T)^-H y."""
    return solve(transpose_conjugate(strict) if "re" in strict.columns else transpose(strict), y, entries)
