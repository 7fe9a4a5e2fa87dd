"""Benchmark passages in documents by spaced seeds, with DataFrame functions alone.

Texts are lower-cased runs of letters and digits. A seed is the hash of the words that a fixed mask selects; the others
are ignored, so a seed survives substitutions there. Seeds of benchmark items and documents are joined; each hit names a
diagonal (the word of the document at which the item would start). On it the words are compared one by one: an item is
found where some WINDOW consecutive words (the item's length, if that is less) agree in SHARE of the places.

The seeds miss nothing that the comparison would accept: an item's masks are chosen by its length so that wherever the
permitted substitutions lie in a window, some mask fits between them.

Defined results: null and empty texts have no words and are found nowhere; items of fewer than 5 words allow no
substitution and are found verbatim; repeated items or documents of one id are compared each and give one row per pair
of ids; null ids are kept as such; empty tables give no row. Columns besides ids and texts are ignored.

The SQL joins by two masks of 12 words, SQL_MASKS: it finds no item under 12 words and misses some substitutions.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common

#: Masks in the order in which they are taken until a length is covered.
MASKS = ("1111", "11011", "10111", "11101")
#: The masks of the SQL, of one span and weight.
SQL_MASKS = ("111010010011", "110010110101")
SPAN = len(SQL_MASKS[0])
WINDOW, SHARE = 20, 0.8
#: Rows of benchmark seeds or ids that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``h``: the hashes of the text's words.

    The array passes through explode, as the optimiser would else compute it anew at each use in a lambda.
    """
    return rows.withColumn("h", F.explode(F.array(F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))))


def missed(length: int, masks: tuple[str, ...]) -> int:
    """Placements of the permitted substitutions in a window of ``length`` words under which no mask fits."""
    wrong = max(k for k in range(length + 1) if length - k >= length * SHARE)
    spots = [{at + o for o, c in enumerate(m) if c == "1"} for m in masks for at in range(length - len(m) + 1)]
    return sum(all(not spot.isdisjoint(placed) for spot in spots) for placed in combinations(range(length), wrong))


@lru_cache(maxsize=None)
def masks_for(length: int) -> tuple[str, ...]:
    """Masks that miss nothing in a window of ``length`` words, 1 at least: the first of MASKS, or all the words."""
    if length < len(MASKS[0]):
        return ("1" * length,)
    return next(MASKS[:k] for k in range(1, len(MASKS) + 1) if not missed(length, MASKS[:k]))


def seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """(keep, seed, at): a row for each mask and window of ``h``.

    All masks have as many windows as the shortest: words that a longer one lacks at the end are left out of its seed,
    which adds hits there, never wrong rows.
    """
    starts = F.sequence(F.lit(0), F.col("n") - 1)

    def under(mask: str) -> Column:
        offsets = [o for o, c in enumerate(mask) if c == "1"]
        return F.transform(starts, lambda i: F.xxhash64(F.lit(mask), *(F.get(F.col("h"), i + o) for o in offsets)))

    long_enough = rows.withColumn("n", F.size("h") - (min(map(len, masks)) - 1)).where("n > 0")
    every = long_enough.select(*keep, "n", F.concat(*map(under, masks)).alias("seeds"))
    return every.select(*keep, "n", F.posexplode_outer("seeds").alias("p", "seed")).select(*keep, "seed", (F.col("p") % F.col("n")).alias("at"))


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(id, item, doc_start, matched, compared): each item found in a document, at its best window."""
    items = hashed(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")), "text").select("item", "h")
    items = common.stored(spark, items, "items")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    length = F.least(F.lit(WINDOW), F.size("h"))
    uses: dict[str, list[int]] = {}
    for row in items.where(F.size("h") > 0).select(length.alias("n")).distinct().collect():  # WINDOW rows at most
        for mask in masks_for(row["n"]):
            uses.setdefault(mask, []).append(row["n"])
    masks = tuple(sorted(uses)) or MASKS[:1]
    asked = reduce(DataFrame.union, (seeds(items.where(length.isin(uses.get(m, []))), ["item"], (m,)) for m in masks))
    asked = common.stored(spark, asked.select("seed", "item", F.col("at").alias("item_at")).distinct(), "seeds")
    hits = seeds(hashed(docs, "text").select("id", "h"), ["id"], masks).join(_small(asked), "seed")
    hits = common.stored(spark, hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")

    # Only documents with a hit are read again.
    found = _small(hits.select("id").distinct())
    again = docs.join(found.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    again = hashed(again, "text").select("id", F.col("h").alias("d"))
    pairs = again.join(hits.select(F.col("id").alias("_id"), "item", "shift"), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    few = _small(items)
    pairs = pairs.join(few.select(F.col("item").alias("_item"), F.col("h").alias("q")), F.col("item").eqNullSafe(F.col("_item"))).drop("_item")
    pairs = pairs.withColumn("first", F.greatest(F.lit(0), -F.col("shift"))).withColumn("end", F.least(F.size("q"), F.size("d") - F.col("shift")))
    pairs = pairs.withColumn("length", F.least(F.lit(WINDOW), F.size("q"))).where(F.col("end") - F.col("first") >= F.col("length"))
    same = F.transform(F.sequence("first", F.col("end") - 1), lambda j: (F.get(F.col("q"), j) == F.get(F.col("d"), j + F.col("shift"))).cast("int"))
    pairs = pairs.select("id", "item", "shift", "first", "length", same.alias("same"))
    counts = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("length")),
        lambda k: F.struct(F.aggregate(F.slice("same", k + 1, F.col("length")), F.lit(0), lambda a, x: a + x).alias("matched"), (-(F.col("first") + F.col("shift") + k)).alias("back")),
    )
    best = pairs.select("id", "item", F.col("length").alias("compared"), F.array_max(counts).alias("best"))
    best = best.where(F.col("best.matched") >= F.col("compared") * F.lit(SHARE))
    top = best.groupBy("id", "item").agg(F.max(F.struct("best.matched", "best.back", "compared")).alias("top"))
    return top.select("id", "item", (-F.col("top.back")).cast("long").alias("doc_start"), F.col("top.matched").cast("long").alias("matched"), F.col("top.compared").cast("long").alias("compared"))


def of_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(spark, docs, items, "doc_id", "text", "item_id", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in ``documents``: a row per pair."""
    found = of_tables(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "doc_start", "matched", "compared")


def _sql_seed(mask: str) -> str:
    return " || ' ' || ".join(f"w[i + {o + 1}]" for o, c in enumerate(mask) if c == "1")


SQL = {
    "op10_decontamination": rf"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT item_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS ({" UNION ALL ".join(f"SELECT id, i, {k} AS m, {_sql_seed(m)} AS s FROM d, unnest(range(0, len(w) - {SPAN - 1})) u(i) WHERE len(w) >= {SPAN}" for k, m in enumerate(SQL_MASKS))}),
qs AS ({" UNION ALL ".join(f"SELECT id, i, {k} AS m, {_sql_seed(m)} AS s FROM q, unnest(range(0, len(w) - {SPAN - 1})) u(i) WHERE len(w) >= {SPAN}" for k, m in enumerate(SQL_MASKS))}),
hits AS (SELECT DISTINCT ds.id AS doc, qs.id AS item, ds.i - qs.i AS shift FROM ds JOIN qs ON ds.m = qs.m AND ds.s = qs.s),
p AS (SELECT doc, item, shift, d.w AS dw, q.w AS qw, greatest(0, -shift) AS f, least(len(q.w), len(d.w) - shift) AS e, least({WINDOW}, len(q.w)) AS l FROM hits JOIN d ON d.id = doc JOIN q ON q.id = item),
c AS (SELECT doc, item, f + shift + k AS pos, l, list_sum(list_transform(range(f + k, f + k + l), lambda j: CASE WHEN qw[j + 1] = dw[j + shift + 1] THEN 1 ELSE 0 END)) AS n FROM p, unnest(range(0, e - f - l + 1)) u(k) WHERE e - f >= l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY n DESC, pos) AS k FROM c WHERE n >= l * {SHARE})
SELECT doc AS doc_id, item AS item_id, CAST(pos AS BIGINT) AS doc_start, CAST(n AS BIGINT) AS matched, CAST(l AS BIGINT) AS compared FROM r WHERE k = 1""",
}
