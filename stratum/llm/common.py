"""What the training-data operators share: working tables, byte blobs, salted look-ups."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot key's rows are dealt over so many salts.
SALTS = 32
#: Rows of a batch between the JVM and Python, which both hold it whole.
BATCH_ROWS = 1_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; in local mode, where it is unset, a temporary one.

    Batches for Python are bounded from here on, as all operators that run Python come by.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stratum-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/stratum"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}-{name}"
    _clean_at_exit(spark, path)
    return path


_PATHS: list[tuple[SparkSession, str]] = []


def _clean_at_exit(spark: SparkSession, path: str) -> None:
    if not _PATHS:
        atexit.register(_clean)
    _PATHS.append((spark, path))


def _clean() -> None:
    for spark, path in _PATHS:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a working table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut, safe when executors are lost."""
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _STORED[table] = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no plan reads any more."""
    for table in tables:
        remove(spark, _STORED.pop(table))


def buckets(spark: SparkSession, texts: DataFrame, per: int) -> int:
    """As many buckets as there are shuffle partitions, or more, so that each gets about ``per`` bytes of the one column."""
    total = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0]))).alias("n")).first()["n"] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores ahead that they are no columns of ``df`` in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def minimum_of_key(rows: DataFrame, keys: list[str], value: str, out: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with the least ``value`` of their key as ``out``.

    The minimum is taken in two partial steps and joined back on (key, salt), so that a key which holds
    a third of all rows is spread over ``salts`` tasks. Null keys form no group: their ``out`` is null.
    """
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", salt)
    parts = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_least"))
    whole = parts.groupBy(*keys).agg(F.min("_least").alias(out), F.collect_list("_salt").alias("_salts"))
    back = whole.select(*keys, out, F.explode("_salts").alias("_salt"))
    return salted.join(back, [*keys, "_salt"], "left").drop("_salt")


def range_bounds(rows: DataFrame, id_col: str, parts: int) -> list[float]:
    """At most ``parts`` - 1 ascending bounds that cut the ids into ranges of about equal counts."""
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = rows.select(F.percentile_approx(F.col(id_col).cast("double"), shares, 20 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def with_part(rows: DataFrame, id_col: str, bounds: list[float], out: str) -> DataFrame:
    """``rows`` with the number of the range that the id lies in; null ids lie in the first."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return rows.withColumn(out, F.lit(0))
    splits = [-float("inf"), *bounds, float("inf")]
    rows = rows.withColumn("_key", F.coalesce(F.col(id_col).cast("double"), F.lit(-float("inf"))))
    rows = Bucketizer(splits=splits, inputCol="_key", outputCol=out, handleInvalid="keep").transform(rows).drop("_key")
    return rows.withColumn(out, F.least(F.col(out), F.lit(float(len(bounds)))).cast("int"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (id, component) per id, component the least id.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of links never grows,
    and the state is a table in the shared folder after every round. A hub's links are only ever
    aggregated by a minimum and joined back with salts.
    """
    both = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = stored(spark, both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        around = edges.select("a", "b").union(edges.select("b", "a"))
        starred = minimum_of_key(around, ["a"], "b", "m").select("b", F.least("a", "m").alias("m"), "a").where("b > a")
        large = starred.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every smaller neighbour of a node, and the node, go to the least of them.
        small = minimum_of_key(large, ["a"], "b", "m")
        pairs = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = stored(spark, pairs.distinct(), "edges")
        # The forest is done when no node is both a child and a parent and every child has one parent.
        open_ = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        many = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        release(spark, edges)
        edges = after
        if not open_ and not many:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
