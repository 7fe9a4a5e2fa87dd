"""Working tables in the folder that the cluster shares: computed once, lineage cut, safe when executors are lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; with a local master, where that is unset, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stratum-')}"
    path = f"{base.rstrip('/')}/stratum-{uuid.uuid4().hex}"
    if not _PATHS:
        atexit.register(_clean)
    _PATHS.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a working table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _PATHS:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


class Table:
    """A table that grows by whole parts; each part's rows are written once."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.path, self.parts = spark, schema, folder(spark), 0

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)
        self.parts += 1

    def read(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read again. Unlike a checkpoint its size is known, so small ones are broadcast in joins."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no plan reads any more."""
    for table in tables:
        remove(table.sparkSession, _STORED.pop(table))
