"""Toxicity by a weighted lexicon under Aho-Corasick, on folded text, normalised by length.

Folding: compatibility decomposition, lower case, accents dropped, look-alike letters of other scripts as Latin ones,
digits and signs that stand for letters in a word as these letters. The lexicon has whole words and word beginnings
with their log odds, learned from labelled rows, and a short fixed list for labels too few to learn from. Within an
exception phrase nothing counts. A document's density is the sum of the weights found, the largest at each word, per
hundred words; a logistic curve fitted to the labelled rows makes it a score.

Counts of the lexicon weigh a labelled document by one over the number of labelled documents that share a least
shingle hash with it, so that a group of copies counts about once.

Fitting reads at most FIT_ROWS labelled rows (those of the least hashes of their id), leaving out those whose
crc32(id as text) mod 5 is 0. Labels, languages, sources and ids are no inputs of a score.

Defined results: null and empty texts have density 0 and the score of that; without any label of either kind the
fixed list and a fixed curve hold; null ids are not learned from and count as not held out; an empty table gives no
row. Repeated rows are scored each; of several rows of a labelled id the least text is learned from. Other columns are
carried along, but for one named ``score`` in any case of letters.
"""

from __future__ import annotations

import math
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common

#: Labelled rows that are learned from, at most.
FIT_ROWS = 20_000
#: Weighted toxic documents of a lexicon entry, at least.
SUPPORT = 3.0
#: Log odds, at least, of a word and of a word beginning; an entry weighs its log odds less BASE.
WORD_ODDS, STEM_ODDS, BASE = 3.0, 5.0, 2.0
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
#: Words added to a document's length before the density is taken.
SHORT = 20

# A short list of insults, phrases in which they are none, look-alike letters, signs for letters.
FIXED_WORDS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "dumb", "imbecile", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "pond scum", "worthless stock", "idiot proof", "white trash bag")
LOOK_ALIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l"}
FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_ALIKE = str.maketrans(LOOK_ALIKE)
_FOREIGN = re.compile("[ıɑɡʟͰ-ӿԀ-ԯ]")
_MARKS = re.compile("[̀-ͯ]+")
_SIGNS = re.compile(r"(?<=[^\W\d_])[013457@$]|[013457@$](?=[^\W\d_])|(?<=[^\W\d_])!(?=[^\W\d_])")
_WORDS = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> list[str]:
    """The folded words of a text."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_ALIKE)
    before = None
    while before != text and _SIGNS.search(text):  # a sign beside a sign that was one
        before, text = text, _SIGNS.sub(lambda m: FOR_LETTERS[m[0]], text)
    return _WORDS.findall(text)


class Lexicon:
    """Entries " word " and " beginning" with weights, and exception phrases, in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def total(self, words: list[str]) -> float:
        if not words:
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared and best:
            return sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))
        return sum(best.values())

    def density(self, text: str | None) -> float:
        words = folded(text)
        return 100 * self.total(words) / (len(words) + SHORT)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _features(batches):
    """(id, toxic, signs, entries) per labelled document: least shingle hashes, and its words and beginnings."""
    for batch in batches:
        signs, entries = [], []
        for text in batch.column("text").to_pylist():
            words = folded(text)
            own = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64)
            with np.errstate(over="ignore"):
                signs.append([int((hashes * np.uint64(odd)).min() >> np.uint64(1)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)])
            found = set()
            for word in set(words):
                found.add(f" {word} ")
                found.update(f" {word[:k]}" for k in STEMS if len(word) > k)
            entries.append(list(found))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(signs, pa.list_(pa.int64())), pa.array(entries, pa.list_(pa.string()))], names=["id", "toxic", "signs", "entries"])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[dict[str, float], tuple[float, float]]:
    """The lexicon's weights and the curve (slope, shift)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.distinct().orderBy(F.xxhash64("id"), "id", "toxic").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    if rows.groupBy("id", "toxic").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic")
    made = common.stored(spark, rows.mapInArrow(_features, f"id {docs.schema[id_col].dataType.simpleString()}, toxic int, signs array<long>, entries array<string>"), "toxic-features")
    each = made.select("id", F.posexplode("signs").alias("which", "sign"))
    sharing = each.join(each.groupBy("which", "sign").agg(F.countDistinct("id").alias("n")), ["which", "sign"])
    weighed = made.join(sharing.groupBy("id").agg(F.max("n").alias("n")), "id").withColumn("w", 1 / F.col("n"))
    sums = weighed.agg(F.sum(F.col("w") * F.col("toxic")).alias("t"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("n")).first()
    weights = {f" {w} ": 2.0 for w in FIXED_WORDS}
    curve = (4.0, 4.0)
    toxic, clean = sums["t"] or 0.0, sums["n"] or 0.0
    if toxic and clean:
        counts = weighed.select(F.explode("entries").alias("entry"), "w", "toxic").groupBy("entry").agg(F.sum(F.col("w") * F.col("toxic")).alias("t"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("n"))
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
        best = counts.where(F.col("t") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= F.when(F.col("entry").endswith(" "), WORD_ODDS).otherwise(STEM_ODDS))
        weights |= {r["entry"]: r["odds"] - BASE for r in best.collect()}  # entries of FIT_ROWS documents
        lexicon = Lexicon(weights)

        def measure(batches):
            for batch in batches:
                values = [lexicon.density(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column("toxic")], names=["x", "toxic"])

        points = sorted((r["x"], r["toxic"]) for r in rows.mapInArrow(measure, "x double, toxic int").collect())
        curve = fit_curve(np.array([p[0] for p in points]), np.array([p[1] for p in points], float))
    return weights, curve


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on log(1 + x) with a small penalty, by Newton's method."""
    z = np.log1p(x)
    slope, shift = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        r = p * (1 - p)
        grad = np.array([((p - y) * z).sum() + 1e-2 * slope, (p - y).sum()])
        hess = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    return slope, -shift


def scored(docs: DataFrame, text_col: str, weights: dict[str, float], curve: tuple[float, float]) -> DataFrame:
    """``docs`` with ``score``."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in docs.columns if c.lower() != "score"]
    slope, shift = curve
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # entries of FIT_ROWS documents and the fixed list

    def score(batches):
        lexicon = Lexicon(shared.value)
        for batch in batches:
            values = []
            for text in batch.column(text_col):
                z = slope * math.log1p(lexicon.density(text.as_py())) - shift
                values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, pa.float64())], names=[*names, "score"])

    return docs.select(*names).mapInArrow(score, StructType([docs.schema[c] for c in names] + [StructField("score", DoubleType())]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` with ``score``, learned from the labelled rows among them."""
    weights, curve = learn(spark, docs, labels, id_col, text_col, label_col)
    return scored(docs, text_col, weights, curve)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
