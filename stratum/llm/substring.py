"""Removal of passages that also start earlier, by exact grouping behind a count-min sketch.

First pass: every partition counts its windows in a count-min sketch; the partitions' sketches are merged cell by
cell. A merged count is never less than the true one, so a window that the sketch takes for single is single. Second
pass: only windows estimated to repeat are grouped, by 128 bits of hash; in each group all but the earliest are
marked. A partition sends one window per group, so a very frequent window costs a row per partition. Third pass:
words that a marked window covers are left out.

The sketch grows with the input up to ROWS x 2**MOST_BITS cells, of which the result is a bit each; with more windows
than cells more single windows pass it and are grouped in vain, and the result stays the same.

Defined results: null and empty texts have no words; texts shorter than a window keep all; null ids count as the
least id (-2**63); rows of one id are ordered by a hash of their text, and equal rows of one id have equal results; an
empty table gives no row. Other columns are carried along, but for those named as one of the four added columns in any
case of letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.hashing import Windows, expand, squeeze

WINDOW = 20
#: The sketch: rows, and cells of a row as powers of two, from the least to the most.
ROWS, LEAST_BITS, MOST_BITS = 2, 22, 28
#: Cells of a chunk of the merged sketch, as a power of two.
CHUNK_BITS = 22
#: Bytes of text for each cell of a row (about one window), and of text whose repeated windows meet in a bucket.
CELL_TEXT, BUCKET_TEXT = 4, 4 << 20
#: Windows that a task holds before it counts them, and repeated ones before it sends them on.
HELD, SENT = 4 << 20, 1 << 20
_NULL = -(1 << 63)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _cells(h1: np.ndarray, h2: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - wide)
    return (h1 >> shift).astype(np.uint32), (h2 >> shift).astype(np.uint32)


def sketch(spark: SparkSession, docs: DataFrame, size: int, wide: int) -> list[tuple[int, bytes]]:
    """The merged sketch in compressed chunks: per cell a bit that is set where the count is two or more."""

    def count(batches):
        windows, held, n = Windows(size), [[] for _ in range(ROWS)], 0
        common.trim()

        def flush():
            out = []
            for row in range(ROWS):
                cells, counts = np.unique(np.concatenate(held[row]), return_counts=True)
                cuts = np.searchsorted(cells, np.arange(0, (1 << wide) + 1, 1 << CHUNK_BITS, dtype=np.int64))
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        steps = np.diff(cells[a:b].astype(np.int64), prepend=k << CHUNK_BITS).astype(np.uint32)
                        out.append((row << 16 | k, int(b - a), squeeze(steps, (counts[a:b] > 1).astype(np.uint8))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "n", "cells"])

        for batch in batches:
            for text in batch.column("text"):
                h1, h2 = windows.of(words_of(text.as_py()))
                if len(h1):
                    for row, cells in enumerate(_cells(h1, h2, wide)):
                        held[row].append(cells)
                    n += len(h1)
                if n >= HELD:
                    yield flush()
                    held, n = [[] for _ in range(ROWS)], 0
        if n:
            yield flush()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CHUNK_BITS, np.uint8)
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("cells").to_pylist()):
                steps, more = expand(blob, n, "<u4", "u1")
                at = np.cumsum(steps, dtype=np.int64)
                counts[at] = np.minimum(counts[at] + 1 + more, 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([squeeze(np.packbits(counts > 1))], pa.binary())], names=["chunk", "bits"])

    parts = docs.select("text").mapInArrow(count, "chunk int, n int, cells binary")
    merged = parts.groupBy("chunk").applyInArrow(merge, "chunk int, bits binary")
    return [(r["chunk"], bytes(r["bits"])) for r in merged.collect()]  # ROWS * 2**MOST_BITS bits at most


class Sketch:
    """A merged sketch: compressed chunks where it is made, and where it is sent to the bits alone."""

    def __init__(self, chunks: list[tuple[int, bytes]], wide: int):
        self.chunks, self.wide = chunks, wide

    def __getstate__(self):
        return self.chunks, self.wide

    def __setstate__(self, state):
        self.bits, self.wide = unpacked(*state), state[1]


def unpacked(chunks: list[tuple[int, bytes]], wide: int) -> list[np.ndarray]:
    """The rows of a sketch as packed bits."""
    out, step = [np.zeros(1 << (wide - 3), np.uint8) for _ in range(ROWS)], 1 << (CHUNK_BITS - 3)
    for chunk, blob in chunks:
        k = chunk & 0xFFFF
        out[chunk >> 16][k * step : (k + 1) * step] = expand(blob, step, "u1")[0]
    return out


def _repeated(bits: list[np.ndarray], h1: np.ndarray, h2: np.ndarray, wide: int) -> np.ndarray:
    """Windows that the sketch estimates to start twice or more."""
    keep = np.ones(len(h1), bool)
    for row, cells in zip(bits, _cells(h1, h2, wide)):
        keep &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def _later(h1, h2, doc, tie, start) -> tuple[np.ndarray, np.ndarray]:
    """The order by window and place, and which of that order are not their window's first place."""
    order = np.lexsort((start, tie, doc, h2, h1))
    h1, h2 = h1[order], h2[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    place = (doc[order] == doc[first]) & (tie[order] == tie[first]) & (start[order] == start[first])
    return order, same & ~place  # equal rows of one id share their places


def _runs(doc, tie, start) -> list[np.ndarray]:
    """Places as (id, tie, first, last): runs of consecutive starts."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(order))[1:] - 1
    return [doc[first], tie[first], start[first].astype(np.int32), start[last].astype(np.int32)]


_MARKS = "id long, tie long, first int, last int"
#: Runs of marks in a blob.
_BLOCK = 1 << 16


def marks(spark: SparkSession, docs: DataFrame, size: int) -> DataFrame:
    """(id, tie, first, last): runs of windows of ``docs`` (id, tie, text) that also start earlier."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wide = min(MOST_BITS, max(LEAST_BITS, (total // CELL_TEXT).bit_length()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TEXT))
    shared = spark.sparkContext.broadcast(Sketch(sketch(spark, docs, size, wide), wide))
    window_kinds, mark_kinds = ("<u8", "<u8", "<i8", "<i8", "<u4"), ("<i8", "<i8", "<i4", "<i4")

    def send(batches):
        windows, bits, held, n = Windows(size), shared.value.bits, [], 0
        common.trim()

        def flush():
            h1, h2, doc, tie, start = (np.concatenate(x) for x in zip(*held))
            order, same = _later(h1, h2, doc, tie, start)
            gone, kept = order[same], order[~same]
            runs = _runs(doc[gone], tie[gone], start[gone])
            rows = []
            for k in range(0, len(runs[0]), _BLOCK):
                block = [r[k : k + _BLOCK] for r in runs]
                rows.append((int(block[0][0]) % buckets, 1, len(block[0]), squeeze(*block)))
            bucket = (h1[kept] % np.uint64(buckets)).astype(np.int32)
            kept = kept[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    rows.append((k, 0, int(b - a), squeeze(*(c[kept[a:b]] for c in (h1, h2, doc, tie, start)))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "n", "blob"])

        for batch in batches:
            for doc, tie, text in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
                h1, h2 = windows.of(words_of(text.as_py()))
                at = np.flatnonzero(_repeated(bits, h1, h2, wide)) if len(h1) else h1
                if len(at):
                    held.append((h1[at], h2[at], np.full(len(at), doc, np.int64), np.full(len(at), tie, np.int64), at.astype(np.uint32)))
                    n += len(at)
                if n >= SENT:
                    yield flush()
                    held, n = [], 0
                    common.trim()
        if n:
            yield flush()

    def group(table: pa.Table) -> pa.Table:
        out, found = [], []
        for kind, n, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "blob"))):
            if kind:
                out.append(expand(blob, n, *mark_kinds))
            else:
                found.append(expand(blob, n, *window_kinds))
        if found:
            h1, h2, doc, tie, start = (np.concatenate(x) for x in zip(*found))
            order, same = _later(h1, h2, doc, tie, start)
            gone = order[same]
            out.append(_runs(doc[gone], tie[gone], start[gone]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "tie", "first", "last"])

    return docs.mapInArrow(send, "bucket int, kind int, n int, blob binary").groupBy("bucket").applyInArrow(group, _MARKS)


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    ``kept_text`` is the text itself where nothing is removed, else the kept words joined by one space.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL))
    twice = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    tie = F.xxhash64(text_col) if twice else F.lit(0).cast("long")
    ids, ties, firsts, lasts = common.fresh(docs, "_id", "_tie", "_first", "_last")
    slim = docs.select(key.alias("id"), tie.alias("tie"), F.col(text_col).alias("text"))
    found = marks(spark, slim, size).groupBy("id", "tie").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    found = found.select(F.col("id").alias(ids), F.col("tie").alias(ties), F.col("runs.first").alias(firsts), F.col("runs.last").alias(lasts))
    joined = docs.join(found, (key == F.col(ids)) & (tie == F.col(ties)), "left").drop(ids, ties)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())]
    names = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    schema = StructType([docs.schema[c] for c in names] + added)

    def keep(batches):
        for batch in batches:
            out = []
            for text, first, last in zip(batch.column(text_col), batch.column(firsts).to_pylist(), batch.column(lasts).to_pylist()):
                text = text.as_py()
                words = words_of(text)
                kept = words
                if first:
                    turn = np.zeros(len(words) + 1, np.int64)
                    np.add.at(turn, np.array(first), 1)
                    np.add.at(turn, np.array(last) + size, -1)
                    kept = [w for w, c in zip(words, np.cumsum(turn).tolist()) if not c]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), text if len(kept) == len(words) else joined.decode()))
            if out:
                made = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *(f.name for f in added)])

    return joined.select(*names, *{text_col} - set(names), firsts, lasts).mapInArrow(keep, schema)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the words of repeated windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(spark, docs, "doc_id", "text").select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = {
    "op6_substring": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS x FROM d, unnest(range(0, len(w) - 19)) u(i) WHERE len(w) >= 20),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, unnest(range(0, 20)) u(j)),
k AS (SELECT d.doc_id, q, w[q + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS q FROM d) d LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.p = d.q WHERE gone.p IS NULL),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
