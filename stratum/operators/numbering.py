"""Numbers and running sums over all rows of a matrix, in order, without a task that sees them all.

Rows are dealt by ranges of (matrix, order), each range counts or sums its own, and what lies before a range is added: a
window over a row for each range. The dealt rows are stored, so that counting and numbering see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.sources.store import stored


def running(rows: DataFrame, by: list[str], weight: Column | None = None, out: str = "at", within: tuple[str, ...] = ("mid",)) -> DataFrame:
    """``rows`` with ``out``: of each ``mid`` (or other keys), the sum of ``weight`` (1) over all rows before this one by ``by``.

    ``by`` must tell the rows of a matrix apart, else the order of equal ones is open.
    """
    dealt = rows.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    dealt = dealt.repartitionByRange(*within, *by).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt)
    sums = dealt.groupBy(*within, "_part").agg(F.sum("_w").alias("_s"))
    ahead = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "_part", F.coalesce(F.sum("_s").over(ahead), F.lit(0).cast("long")).alias("_ahead"))
    before = Window.partitionBy(*within, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn(out, F.coalesce(F.sum("_w").over(before), F.lit(0).cast("long")))
    return own.join(sums, [*within, "_part"]).withColumn(out, F.col(out) + F.col("_ahead")).drop("_w", "_part", "_ahead")
