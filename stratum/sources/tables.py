"""Matrices and vectors from the star schema's facts, and from stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ``lineitem`` that a task deals with at once where it counts their places or pairs.
LINES = 250_000


def dealt(lines: DataFrame, by: str) -> DataFrame:
    """``lines`` in tasks by ``by``, more of them for more lines, so that what one of them counts does not grow."""
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    return lines.repartition(tasks, by)


def part_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts by suppliers, quantities summed (whole numbers)."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    coo = dealt(lines, "l_partkey").groupBy(F.lit("PS").alias("mid"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    rows = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("nrows"))
    cols = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("ncols"))
    return coo, rows.crossJoin(cols).select(F.lit("PS").alias("mid"), "nrows", "ncols")  # one row each


def sharing(spark: SparkSession, sf_dir: str, first: str | None = None, end: str | None = None, mid: str = "SS", key: str = "l_suppkey") -> DataFrame:
    """Suppliers (or other keys) by suppliers: the orders that two share, of lines shipped from ``first`` until before ``end`` (dates)."""
    lines = table(spark, sf_dir, "lineitem")
    if first is not None:
        lines = lines.where((F.col("l_shipdate") >= F.lit(first).cast("timestamp")) & (F.col("l_shipdate") < F.lit(end).cast("timestamp")))
    once = dealt(lines.select(F.col("l_orderkey").alias("o"), F.col(key).alias("i")), "o").distinct()
    both = once.join(once.select("o", F.col("i").alias("j")), "o").where("i <> j")
    return both.groupBy(F.lit(mid).alias("mid"), "i", "j").agg(F.count("*").cast("double").alias("v"))


def coupled_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts by parts: less the orders of 1995 that two share, a quarter more above the diagonal and a quarter less below,
    and 1 more than a row's orders on it: a sparse, unsymmetric matrix with dominant diagonal and a row for each part."""
    off = sharing(spark, sf_dir, "1995-01-01", "1996-01-01", "PP", "l_partkey")
    meta = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("nrows")).select(F.lit("PP").alias("mid"), "nrows", F.col("nrows").alias("ncols"))
    own = vector(meta, F.lit(1.0)).select("mid", "i", F.col("i").alias("j"), F.col("x").alias("v"))
    sums = off.select("mid", "i", F.col("i").alias("j"), "v")
    off = off.select("mid", "i", "j", (F.col("v") * F.when(F.col("i") < F.col("j"), -1.25).otherwise(-0.75)).alias("v"))
    return off.union(own).union(sums).groupBy("mid", "i", "j").agg(F.sum("v").alias("v")), meta


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations of customers by nations of suppliers, quantities summed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    coo = facts.groupBy(F.lit("NN").alias("mid"), F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return coo, spark.range(1).select(F.lit("NN").alias("mid"), F.lit(25).cast("long").alias("nrows"), F.lit(25).cast("long").alias("ncols"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of event types followed by event types of the same user; types are numbered by name."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("k"))  # a few types
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select("event_type", F.lead("event_type").over(order).alias("after")).where("after is not null").groupBy("event_type", "after").count()
    first = steps.join(kinds.withColumnRenamed("k", "i"), "event_type")
    both = first.join(kinds.select(F.col("event_type").alias("after"), F.col("k").alias("j")), "after")
    return both.select(F.lit("EV").alias("mid"), "i", "j", F.col("count").cast("double").alias("v"))


def stencil(spark: SparkSession, side: int, wind: float = 0.0, mid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The 5-point stencil on a side x side grid; ``wind`` is added to the east and taken from the west."""
    n, mid = side * side, mid or f"FD{side}"
    cells = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    arms = ((0, 0, 4.0), (1, 0, -1.0 + wind), (-1, 0, -1.0 - wind), (0, 1, -1.0), (0, -1, -1.0))
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(v).alias("v")) for dx, dy, v in arms))
    each = cells.select("i", "x", "y", F.explode(near).alias("e")).select("i", (F.col("x") + F.col("e.dx")).alias("x"), (F.col("y") + F.col("e.dy")).alias("y"), F.col("e.v").alias("v"))
    inside = each.where(F.col("x").between(0, side - 1) & F.col("y").between(0, side - 1))
    coo = inside.select(F.lit(mid).alias("mid"), "i", (F.col("y") * side + F.col("x")).alias("j"), "v")
    return coo, spark.range(1).select(F.lit(mid).alias("mid"), F.lit(n).cast("long").alias("nrows"), F.lit(n).cast("long").alias("ncols"))


def vector(meta: DataFrame, value, size: str = "ncols") -> DataFrame:
    """(mid, i, x) with x a column expression of i."""
    from stratum.operators.structure import indices

    return indices(meta, size).select("mid", "i", value.cast("double").alias("x"))
