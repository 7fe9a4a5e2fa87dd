"""Structure of sparse matrices in coordinate form: plans of select, filter, join and group-by.

A matrix is (mid, i, j, v) with unique (mid, i, j); a size table is (mid, nrows, ncols); a permutation is
(mid, i, p): the original index p at the new position i. Vectors and permutations of a matrix are joined by key;
whether a side is small enough to broadcast is left to the optimiser's size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.numbering import running


#: Indices that are made from one row.
RUN = 1 << 16


def indices(meta: DataFrame, size: str = "nrows") -> DataFrame:
    """(mid, i) for all i of each matrix: first of runs of RUN indices, dealt over tasks, and then of the runs'."""
    tasks = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = meta.where(F.col(size) > 0).select("mid", F.col(size).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / RUN))).alias("run"))
    first = F.col("run") * RUN
    return runs.repartition(tasks, "mid", "run").select("mid", F.explode(F.sequence(first, F.least(first + (RUN - 1), F.col("n") - 1))).alias("i"))


def assemble(coo: DataFrame) -> DataFrame:
    """Entries with repeated places summed."""
    return coo.groupBy("mid", "i", "j").agg(F.sum("v").alias("v"))


def from_csr(rows: DataFrame) -> DataFrame:
    """(mid, indptr, indices, vals) arrays as coordinates: entries and rows are taken apart once, and meet by place."""
    entries = rows.select("mid", F.posexplode(F.arrays_zip(F.col("indices").alias("j"), F.col("vals").alias("v"))).alias("at", "e"))
    ends = F.zip_with("indptr", F.slice("indptr", 2, F.size("indptr")), lambda first, end: F.struct(first.alias("first"), end.alias("end")))
    runs = rows.select("mid", F.posexplode(ends).alias("i", "run")).where("run.end > run.first")
    places = runs.select("mid", "i", F.explode(F.sequence("run.first", F.col("run.end") - 1)).alias("at"))
    return entries.join(places, ["mid", "at"]).select("mid", F.col("i").cast("long").alias("i"), F.col("e.j").cast("long").alias("j"), F.col("e.v").alias("v"))


def to_csr(coo: DataFrame, meta: DataFrame) -> DataFrame:
    """(mid, i, indices, vals): each row's entries in order, empty rows included."""
    rows = coo.groupBy("mid", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))
    rows = indices(meta).join(rows, ["mid", "i"], "left")
    none = F.array().cast("array<struct<j:bigint,v:double>>")
    return rows.withColumn("e", F.coalesce("e", none)).select("mid", "i", F.col("e.j").alias("indices"), F.col("e.v").alias("vals"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select("mid", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def transpose_conjugate(cooz: DataFrame) -> DataFrame:
    return cooz.select("mid", F.col("j").alias("i"), F.col("i").alias("j"), "re", (F.lit(0.0) - F.col("im")).alias("im"))


def row_nnz(coo: DataFrame, meta: DataFrame) -> DataFrame:
    """(mid, i, nnz) for all rows."""
    counts = coo.groupBy("mid", "i").agg(F.count("*").alias("nnz"))
    return indices(meta).join(counts, ["mid", "i"], "left").select("mid", "i", F.coalesce("nnz", F.lit(0).cast("long")).alias("nnz"))


def col_nnz(coo: DataFrame, meta: DataFrame) -> DataFrame:
    """(mid, j, nnz) for all columns."""
    sizes = meta.select("mid", F.col("ncols").alias("nrows"))
    return row_nnz(transpose(coo), sizes).withColumnRenamed("i", "j")


def validity(coo: DataFrame, meta: DataFrame) -> DataFrame:
    """Per matrix: no repeated place, all places within bounds, all values finite."""
    places = coo.groupBy("mid", "i", "j").agg(F.count("*").alias("n"), F.min(~F.isnan("v") & (F.abs("v") < float("inf"))).alias("finite"))
    # Matrices are few and large: their sizes meet a row of each, not its places.
    each = places.groupBy("mid").agg(
        F.max("n").alias("most"), F.least(F.min("i"), F.min("j")).alias("low"), F.max("i").alias("i"), F.max("j").alias("j"), F.min("finite").alias("finite"), F.sum("n").alias("nnz"),
    )
    inside = (F.col("low") >= 0) & (F.col("i") < F.col("nrows")) & (F.col("j") < F.col("ncols"))
    return meta.join(each, "mid", "left").select(
        "mid", F.coalesce(F.col("most") <= 1, F.lit(True)).alias("unique_places"), F.coalesce(inside, F.lit(True)).alias("in_bounds"),
        F.coalesce("finite", F.lit(True)).alias("finite"), F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"),
    )


def split(coo: DataFrame, m: int, axis: str = "j", second: bool = False) -> DataFrame:
    """Entries before ``m`` along an axis, or those from ``m`` on, counted from 0."""
    if not second:
        return coo.where(F.col(axis) < m)
    return coo.where(F.col(axis) >= m).withColumn(axis, F.col(axis) - m)


def leading(coo: DataFrame, m: int) -> DataFrame:
    return coo.where((F.col("i") < m) & (F.col("j") < m))


def permute(coo: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """B[i, j] = A[p_i, q_j]."""
    rows = p.select("mid", F.col("i").alias("new_i"), F.col("p").alias("i"))
    cols = q.select("mid", F.col("i").alias("new_j"), F.col("p").alias("j"))
    return coo.join(rows, ["mid", "i"]).join(cols, ["mid", "j"]).select("mid", F.col("new_i").alias("i"), F.col("new_j").alias("j"), "v")


def identity(meta: DataFrame) -> DataFrame:
    return indices(meta).select("mid", "i", F.col("i").alias("p"))


def inverse(p: DataFrame) -> DataFrame:
    return p.select("mid", F.col("p").alias("i"), F.col("i").alias("p"))


def compose(p: DataFrame, q: DataFrame) -> DataFrame:
    """The permutation that takes position i to p[q[i]]."""
    return q.select("mid", "i", F.col("p").alias("k")).join(p.select("mid", F.col("i").alias("k"), "p"), ["mid", "k"]).select("mid", "i", "p")


def is_identity(p: DataFrame) -> DataFrame:
    return p.groupBy("mid").agg(F.min(F.col("i") == F.col("p")).alias("is_eye"))


def pattern_symmetry(coo: DataFrame) -> DataFrame:
    """(mid, ratio): share of the entries whose mirror is present."""
    mirror = coo.select("mid", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("there"))
    return coo.join(mirror, ["mid", "i", "j"], "left").groupBy("mid").agg((F.count("there") / F.count("*")).alias("ratio"))


def with_transpose_pattern(coo: DataFrame, m: int | None = None) -> DataFrame:
    """(mid, i, j): the pattern of A + A' (of its leading block)."""
    block = coo if m is None else leading(coo, m)
    return block.select("mid", "i", "j").union(block.select("mid", F.col("j"), F.col("i"))).distinct()


def scaled_permuted(coo: DataFrame, s: DataFrame, t: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """(mid, i, j, v) of S A T at new positions; s and t are (mid, i, x)."""
    rows = s.select("mid", "i", F.col("x").alias("s"))
    cols = t.select("mid", F.col("i").alias("j"), F.col("x").alias("t"))
    scaled = coo.join(rows, ["mid", "i"]).join(cols, ["mid", "j"]).select("mid", "i", "j", (F.col("s") * F.col("v") * F.col("t")).alias("v"))
    return permute(scaled, p, q)


def block_E(placed: DataFrame, m: int) -> DataFrame:
    return placed.where((F.col("i") >= m) & (F.col("j") < m)).withColumn("i", F.col("i") - m)


def block_F(placed: DataFrame, m: int) -> DataFrame:
    return placed.where((F.col("i") < m) & (F.col("j") >= m)).withColumn("j", F.col("j") - m)


def diagonal(placed: DataFrame, meta: DataFrame) -> DataFrame:
    """(mid, i, x): the diagonal, 0 where there is no entry."""
    there = placed.where(F.col("i") == F.col("j")).select("mid", "i", "v")
    return indices(meta).join(there, ["mid", "i"], "left").select("mid", "i", F.coalesce("v", F.lit(0.0)).alias("x"))


def densify(coo: DataFrame, meta: DataFrame) -> DataFrame:
    """(mid, i, row): rows as arrays with zeros; for blocks that are dense anyway. Each entry is followed by its gap's zeros."""
    rows = to_csr(coo, meta).join(meta.select("mid", "ncols"), "mid")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    after = F.concat(F.slice("indices", 2, F.size("indices")), F.array("ncols"))
    each = F.zip_with("vals", F.zip_with("indices", after, lambda j, k: k - j - 1), lambda v, gap: F.concat(F.array(v), zeros(gap)))
    ahead = zeros(F.coalesce(F.get("indices", F.lit(0)), "ncols"))
    return rows.select("mid", "i", F.concat(ahead, F.when(F.size("vals") > 0, F.flatten(each)).otherwise(F.array().cast("array<double>"))).alias("row"))


def rotate_left(p: DataFrame, first: int, last: int) -> DataFrame:
    """Positions first..last moved one to the left, the first one to the end."""
    i = F.col("i")
    to = F.when(i == first, last).when((i > first) & (i <= last), i - 1).otherwise(i)
    return p.withColumn("i", to.cast("long"))


def rotate_right(p: DataFrame, first: int, last: int) -> DataFrame:
    """Positions first..last moved one to the right, the last one to the front."""
    i = F.col("i")
    to = F.when(i == last, first).when((i >= first) & (i < last), i + 1).otherwise(i)
    return p.withColumn("i", to.cast("long"))


def find_sorted(coo: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mid, i, j, found, at): where in its row an entry is, or would be."""
    before = coo.select("mid", "i", F.col("j").alias("k"))
    return wanted.join(before, ["mid", "i"], "left").groupBy("mid", "i", "j").agg(
        F.coalesce(F.max(F.col("k") == F.col("j")), F.lit(False)).alias("found"), F.count(F.when(F.col("k") < F.col("j"), 1)).alias("at"),
    )


def defer_tiny(placed: DataFrame, meta: DataFrame, m0: int | None, eps: float, empty: bool = True) -> DataFrame:
    """(mid, i, p): within the first m0 positions (all: None), those of tiny diagonals moved to their end, order kept.

    Without ``empty``, positions whose row or column has no entry are left out of the first m0, and the others move up.
    """
    how = "left" if empty else "inner"
    rows = placed.groupBy("mid", "i").agg(F.max(F.abs("v")).alias("r"))
    cols = placed.groupBy("mid", F.col("j").alias("i")).agg(F.max(F.abs("v")).alias("c"))
    found = diagonal(placed, meta).join(rows, ["mid", "i"], how).join(cols, ["mid", "i"], how)
    most = F.greatest(F.coalesce("r", F.lit(0.0)), F.coalesce("c", F.lit(0.0)))
    found = found if m0 is None else found.where(F.col("i") < m0)
    found = found.withColumn("tiny", (F.abs("x") <= F.lit(eps) * most).cast("int"))
    moved = running(found.select("mid", "tiny", F.col("i").alias("p")), ["tiny", "p"]).select("mid", F.col("at").alias("i"), "p")
    return moved if m0 is None else moved.union(indices(meta).where(F.col("i") >= m0).select("mid", "i", F.col("i").alias("p")))
