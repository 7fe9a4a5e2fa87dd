"""Canonical exact digests of documents, by DataFrame functions alone.

A text's canonical form is NFC, case-folded, NFC again, with each run of white space as one space and none at the
ends. Its fingerprint is 128 bits of xxHash64 under two seeds. Rows of equal hashes are compared byte by byte: where
a bucket holds different canonical texts, their SHA-256 is appended to the fingerprints of that bucket, so equal
fingerprints always mean equal canonical texts. Likeness of two fingerprints is 1.0 if they are equal, else 0.0.

Defined results: a null text is an empty one; repeated ids are documents of their own, next to each other in the
order of their texts' hashes; null ids come last in descending order; a single document is its own next; an empty
table gives no row. Columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm import common

#: Ids of rows to compare that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text in a range of ids.
RANGE_BYTES = 32_000_000
_SPACE = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _nfc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def canonical(text: Column) -> Column:
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfc(text), F.lit(True))
    return F.trim(F.regexp_replace(_nfc(folded), _SPACE, " "))


def hashes(canon: Column) -> Column:
    """Two 64-bit hashes of a canonical text, under seeds of their own."""
    return F.struct(F.xxhash64(F.lit("a"), canon).alias("x"), F.xxhash64(F.lit("b"), canon).alias("y"))


def with_canonical(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """``rows`` with the canonical text, made once: `reflect` is repeated for each use unless a generator stands between."""
    return rows.withColumn(out, F.explode(F.array(canonical(text))))


def hashed(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """``rows`` with the hashes of the canonical text."""
    return with_canonical(rows, text, "_canon").withColumn(out, hashes(F.col("_canon"))).drop("_canon")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (id, text) with their hashes ``h`` and ``next`` (id, text, h): the next row by descending id, cyclically.

    Rows are dealt by ranges of the id and sorted there, so each text is shuffled once. The last row of a range
    is also sent to the range after it. Bounds and last rows are one for each range.
    """
    bounds = common.range_bounds(docs, "id", parts)
    dealt = lambda rows: common.with_part(rows, "id", bounds, "part")
    lasts = dealt(docs.select("id")).groupBy("part").agg(F.max("id").alias("id"), F.count("*").alias("n")).orderBy("part").collect()
    after = [(lasts[k]["id"], lasts[(k + 1) % len(lasts)]["part"]) for k in range(len(lasts))]
    ends = docs.sparkSession.createDataFrame(after, "last long, onward int")
    rows = dealt(docs).join(F.broadcast(ends), F.col("id").eqNullSafe(F.col("last")), "left").drop("last")
    own, sent = F.struct(F.col("part").alias("part"), F.lit(0).alias("own")), F.struct(F.col("onward").alias("part"), F.lit(-1).alias("own"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("onward").isNull(), F.array(own)).otherwise(F.array(own, sent)))).drop("part", "onward")
    rows = rows.select("id", "text", F.col("at.part").alias("part"), F.col("at.own").alias("own")).repartition(parts, "part")
    rows = hashed(rows, F.col("text"), "h")
    window = Window.partitionBy("part").orderBy("own", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumn("next", F.lag(F.struct("id", "text", "h")).over(window))
    return rows.where("own = 0").drop("part", "own")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def clashes(spark: SparkSession, docs: DataFrame, table: DataFrame) -> DataFrame:
    """(id, h, suffix) of all entries in buckets that hold different canonical texts.

    Only entries of buckets with several rows are read again; a bucket's least and greatest text are aggregated
    by partial minima and maxima, so a large bucket is never gathered.
    """
    entries = table.select("h", "id", F.lit(False).alias("is_edited"), "next_id").union(table.select("e", "id", F.lit(True), "next_id"))
    repeated = entries.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    several = common.stored(spark, entries.join(repeated, "h", "left_semi"), "several")
    plain = several.where("not is_edited").select("id").distinct()
    sides = several.where("is_edited")

    def of(ids: DataFrame) -> DataFrame:
        small = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
        return docs.join(small.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    made = with_canonical(of(plain), F.col("text"), "canon").select("id", hashes(F.col("canon")).alias("h"), "canon")
    if sides.limit(1).count():
        wanted = sides.select("id").union(sides.select(F.col("next_id").alias("id"))).distinct()
        some = common.stored(spark, of(wanted).select("id", "text"), "texts")
        both = sides.alias("s").join(some.alias("t"), F.col("s.id").eqNullSafe(F.col("t.id"))).join(some.alias("u"), F.col("s.next_id").eqNullSafe(F.col("u.id")))
        again = both.select("s.id", F.col("s.h").alias("h"), F.col("t.text").alias("text"), F.col("u.text").alias("following"))
        again = with_canonical(again, edited(F.col("text"), F.col("following")), "canon").select("id", "h", "canon")
        made = made.union(again.where(hashes(F.col("canon")) == F.col("h")))  # with repeated ids, other pairs of texts also meet
    unlike = made.groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("h")
    unlike = common.stored(spark, unlike, "clashes")
    if not unlike.limit(1).count():
        return unlike.select(F.lit(0).cast("long").alias("id"), "h", F.lit("").alias("suffix"))
    found = made.join(unlike, "h", "left_semi")
    return common.stored(spark, found.select("id", "h", F.concat(F.lit("-"), F.sha2(F.col("canon").cast("binary"), 256)).alias("suffix")).distinct(), "suffixes")


def _shown(h: str) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(f"{h}.x"), 16, "0")), F.lower(F.lpad(F.hex(f"{h}.y"), 16, "0")))


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and their likeness."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    parts = common.buckets(spark, docs.select("text"), RANGE_BYTES)
    rows = with_next(docs, parts).withColumn("edit", edited(F.col("text"), F.col("next.text")))
    rows = hashed(rows, F.col("edit"), "e")
    table = rows.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "h", "e", F.col("next.h").alias("n"), F.col("next.id").alias("next_id"))
    table = common.stored(spark, table, "fingerprints")
    unlike = clashes(spark, docs, table)
    shown = {"h": _shown("h"), "e": _shown("e"), "n": _shown("n")}
    if unlike.limit(1).count():
        for side, owner in (("h", "id"), ("e", "id"), ("n", "next_id")):
            names = unlike.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("suffix").alias(f"{side}_suffix"))
            table = table.join(names, F.col(owner).eqNullSafe(F.col("_id")) & (F.col(side) == F.col("_h")), "left").drop("_id", "_h")
            shown[side] = F.concat(shown[side], F.coalesce(F.col(f"{side}_suffix"), F.lit("")))
    return table.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", shown["h"].alias("fingerprint"), shown["e"].alias("edited_fingerprint"),
        (shown["h"] == shown["e"]).cast("double").alias("near_edited"), (shown["h"] == shown["n"]).cast("double").alias("near_next"),
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
