"""Corpus cleaning in stages, each written as Parquet and read again as the next one's documents.

Toxic documents go; of each group of near duplicates the document with the least id stays; words of passages that
also start earlier go; documents with a benchmark item go; what is left is packed. A stage judges all that the one
before it kept. Rows of one id are one document to the second and fourth stage, and of those of one text too the second
keeps one, with the least other columns; a row without an id is a document of its own there. Other columns than those of
documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common, decontaminate, jaccard, packing, substring, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids to leave out that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of each generation of the encoder's memory, less than where packing runs alone: the executors' heaps have grown by then.
TOKEN_MEMORY = 24 << 20


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: the id, or for a row without one a number beyond all ids."""
    ids = docs.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("without")).first()
    if not ids["without"]:
        return docs.withColumn("key", F.col("doc_id"))
    least, most = (0, 0) if ids["most"] is None else (ids["least"], ids["most"])
    row = F.monotonically_increasing_id()
    key = F.lit(most + 1) + row if most < 1 << 62 else F.lit(least - 1) - row
    without = common.stored(spark, docs.where(F.col("doc_id").isNull()).withColumn("key", key), "without-ids")
    return docs.where(F.col("doc_id").isNotNull()).withColumn("key", F.col("doc_id").cast("long")).unionByName(without)


def _among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, "key", how)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(spark, docs.select(COLUMNS), labels).where("score < 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, without repeated rows."""
    docs = _keyed(spark, docs)
    rows = jaccard.near_duplicates(spark, docs, "key", "text")
    gone = rows.where("component <> id").select(F.col("id").alias("key")).distinct()
    kept = _among(docs, common.stored(spark, gone, "near-duplicates"), "left_anti")
    repeated = common.stored(spark, docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    if not repeated.limit(1).count():
        return kept.select(COLUMNS)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = _among(kept, repeated, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least"))
    return _among(kept, repeated, "left_anti").select(COLUMNS).unionByName(one.select("doc_id", "text", "least.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that also start earlier."""
    rows = substring.remove_repeats(spark, docs, "doc_id", "text")
    changed = F.col("n_removed") > 0
    rows = rows.withColumn("n_chars", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col("kept_text")).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    docs = _keyed(spark, docs)
    gone = decontaminate.of_tables(spark, docs.select(F.col("key").alias("doc_id"), "text"), sf_dir).select(F.col("id").alias("key")).distinct()
    return _among(docs, common.stored(spark, gone, "contaminated"), "left_anti").select(COLUMNS)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(spark, docs, TOKEN_MEMORY)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substring_dedup", passages), ("decontamination", benchmark), ("packing", packs)]

#: Learned weights and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(spark, docs, name)
    return docs
