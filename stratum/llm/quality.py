"""Quality by co-training of a text view and a metadata view (Blum and Mitchell, 1998).

The text view sees signs and words: shares of kinds of signs, repetition, and hashed triples of bytes. The metadata
view sees source, language, length and layout (lines). Each is a logistic regression. Over ROUNDS rounds each scores all
unlabelled rows and labels the PER_ROUND it is surest of, for the other to learn from. Each view is then calibrated, and
the two are combined, on labelled rows kept apart for that. Every document is scored on its whole text.

Both views of every document are computed once and stored. Fitting reads at most FIT_ROWS labelled rows, those of the
least hashes of their id; rows whose crc32(id as text) mod 5 is 0 are not learned from.

Defined results: null and empty texts and null metadata are values of their own; without labels of both kinds every
score is 0.5; null ids are scored and count as not held out; repeated rows are scored each, and of several rows of a
labelled id one is learned from, that of the least hash; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.toxicity import held_out

FIT_ROWS = 6_000
ROUNDS, PER_ROUND, SURE = 5, 200, 0.95
TEXT_BINS, META_BINS = 256, 96

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop or comma, 7 other sign, 8 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 8
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 7
_KIND[[44, 46]] = 6


def text_view(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_KIND[data], minlength=9) / n
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x]
    count = max(1, len(words))
    longest = max(map(len, words), default=0)
    own = [len(set(words)) / count, len(set(lines)) / max(1, len(lines)), sum(map(len, words)) / count / 10, np.log1p(longest) / 5, sum(w.isupper() for w in words) / count, sum(not any(c.isalnum() for c in w) for w in words) / count, 1.0 if not words else 0.0]
    bins = np.zeros(TEXT_BINS)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
        bins = np.sqrt(np.bincount(code, minlength=TEXT_BINS) / len(code))
    return np.concatenate([[1.0], kinds * 4, own, bins])


def meta_view(source: str | None, lang: str | None, size: int | None, text: str | None) -> np.ndarray:
    out = np.zeros(META_BINS + 6)
    out[xxhash.xxh3_64_intdigest(f"s{source}") % (META_BINS - 16)] = 1
    out[META_BINS - 16 + xxhash.xxh3_64_intdigest(f"l{lang}") % 16] = 1
    size, lines = size or 0, (text or "").count("\n") + 1
    out[META_BINS:] = 1.0, np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, float(size < 200), float(size > 20_000)
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = proba(x, w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def proba(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def co_train(views: list[np.ndarray], y: np.ndarray, surest: Callable) -> dict[str, np.ndarray]:
    """Weights of both views, their calibrations (slope, shift) and the combination (two slopes, shift).

    ``surest(weights, many)``: (view, label, rows) of unlabelled rows that the view labels, as the other view sees them.
    """
    order = np.random.default_rng(0).permutation(len(y))
    apart, own = order[: len(y) // 4], order[len(y) // 4 :]
    if len(np.unique(y[apart])) < 2 or len(np.unique(y[own])) < 2:
        apart = own = order
    given = [[(v[own], y[own])] for v in views]
    share = y[own].mean()
    many = {1.0: max(1, round(PER_ROUND * share)), 0.0: max(1, round(PER_ROUND * (1 - share)))}
    for _ in range(ROUNDS):
        weights = [fit(np.concatenate([x for x, _ in g]), np.concatenate([t for _, t in g])) for g in given]
        for k, label, rows in surest(weights, many):
            given[1 - k].append((rows, np.full(len(rows), label)))
    weights = [fit(np.concatenate([x for x, _ in g]), np.concatenate([t for _, t in g])) for g in given]
    scales, calibrated = [], []
    for v, w in zip(views, weights):
        z = np.stack([_logit(proba(v[apart], w)), np.ones(len(apart))], axis=1)
        scales.append(fit(z, y[apart], 1e-2))
        calibrated.append(_logit(proba(z, scales[-1])))
    both = fit(np.stack([*calibrated, np.ones(len(apart))], axis=1), y[apart], 1e-2)
    return {"text": weights[0], "meta": weights[1], "text_scale": scales[0], "meta_scale": scales[1], "both": both}


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column("text").to_pylist()
    sources, langs, sizes = (batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))
    text = np.array([text_view(t) for t in texts]).reshape(len(texts), -1)
    meta = np.array([meta_view(*r) for r in zip(sources, langs, sizes, texts)]).reshape(len(texts), -1)
    return text, meta


def viewed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, doc_id, t, m): both views of every row, stored."""

    def make(batches):
        for batch in batches:
            packed = [pa.array([r.astype("<f4").tobytes() for r in v], pa.binary()) for v in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *packed], names=["doc_id", "t", "m"])

    docs = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", "n_chars")
    rows = docs.mapInArrow(make, "doc_id long, t binary, m binary")
    return common.stored(spark, rows.withColumn("row", F.monotonically_increasing_id()), "views")


def _matrices(t: list[bytes], m: list[bytes]) -> list[np.ndarray]:
    wide = len(text_view("")), len(meta_view(None, None, None, None))
    return [np.frombuffer(b"".join(v), "<f4").reshape(-1, n).astype(float) for v, n in zip((t, m), wide)]


def learn(spark: SparkSession, rows: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """The model, from a bounded sample of the labelled ``rows`` and all that have no label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    taught = known.where(~held_out("doc_id")).distinct().orderBy(*order, "y").limit(FIT_ROWS)
    one = F.min_by(F.struct("t", "m"), F.struct(F.xxhash64("t", "m"), "t", "m")).alias("one")
    labelled = rows.join(F.broadcast(taught), "doc_id").groupBy("doc_id", "y").agg(one).select("doc_id", "y", "one.*").collect()
    labelled.sort(key=lambda r: (r["doc_id"], r["y"]))
    y = np.array([r["y"] for r in labelled])
    if len(np.unique(y)) < 2:
        return None
    pool = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    taken: list[int] = []  # 4 * ROUNDS * PER_ROUND at most

    def surest(weights, many):
        def sure(batches):
            for batch in batches:
                p = [proba(x, w) for x, w in zip(_matrices(batch.column("t").to_pylist(), batch.column("m").to_pylist()), weights)]
                far = np.maximum(*(np.maximum(q, 1 - q) for q in p)) >= SURE
                columns = [batch.column("doc_id").filter(pa.array(far)), batch.column("row").filter(pa.array(far)), *(pa.array(q[far]) for q in p)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "p0", "p1"])

        scored = pool.select("doc_id", "row", "t", "m").mapInArrow(sure, "doc_id long, row long, p0 double, p1 double")
        scored = common.stored(spark, scored.join(known.select("doc_id"), "doc_id", "left_anti").where(~F.col("row").isin(taken)), "scored")
        best = []
        for k in (0, 1):
            for label in many:
                p = F.col(f"p{k}") if label else 1 - F.col(f"p{k}")
                # The second view may find all that the first one takes at its top.
                top = scored.select("row", "doc_id", p.alias("p")).where(F.col("p") >= SURE).orderBy(F.desc("p"), *order, "row").limit(many[label] + k * sum(many.values()))
                best.append((k, label, [r["row"] for r in top.collect()]))
        chosen = []
        for k, label, found in best:
            chosen.append((k, label, [r for r in found if r not in taken][: many[label]]))
            taken.extend(chosen[-1][2])
        new = [r for _, _, some in chosen for r in some]
        seen = {r["row"]: (r["t"], r["m"]) for r in rows.where(F.col("row").isin(new)).select("row", "t", "m").collect()} if new else {}
        return [(k, label, _matrices([seen[r][0] for r in some], [seen[r][1] for r in some])[1 - k]) for k, label, some in chosen]

    return co_train(_matrices([r["t"] for r in labelled], [r["m"] for r in labelled]), y, surest)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score) for every row of ``docs`` (doc_id, text, source, lang, n_chars)."""
    rows = viewed(spark, docs)
    model = spark.sparkContext.broadcast(learn(spark, rows, labels))  # some hundred numbers

    def score(batches):
        m = model.value
        for batch in batches:
            if m is None or not batch.num_rows:
                p = q = s = np.full(batch.num_rows, 0.5)
            else:
                text, meta = _matrices(batch.column("t").to_pylist(), batch.column("m").to_pylist())
                p = proba(np.stack([_logit(proba(text, m["text"])), np.ones(len(text))], axis=1), m["text_scale"])
                q = proba(np.stack([_logit(proba(meta, m["meta"])), np.ones(len(meta))], axis=1), m["meta_scale"])
                s = proba(np.stack([_logit(p), _logit(q), np.ones(len(p))], axis=1), m["both"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (p, q, s))], names=["doc_id", "p_text", "p_meta", "score"])

    return rows.select("doc_id", "t", "m").mapInArrow(score, "doc_id long, p_text double, p_meta double, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; ``keep`` is 1 where the score is 0.5 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
