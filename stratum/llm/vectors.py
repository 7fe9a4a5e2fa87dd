"""What the operators on vectors share: whole-number vectors as a table, dense blocks of them, exact products, best rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common

#: Bytes of queries or anchors that are broadcast at once; the others wait for a pass of their own.
BLOCK_BYTES = 32 << 20
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~odd


def whole(vector: str, factor: int, shift: int = 0) -> Column:
    """floor(factor * x) + shift for all components x; one beyond a long's range is an error."""

    def number(x: Column) -> Column:
        y = x.cast("double") * factor
        return F.when(F.abs(y) < 2.0**62, F.floor(y) + shift).otherwise(F.raise_error(F.lit("a component is too large for whole numbers")).cast("long"))

    return F.transform(vector, number)


def numbered(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored, with ``row``: a number that only this row has."""
    return common.stored(spark, rows.withColumn("row", F.monotonically_increasing_id()), name)


def in_blocks(spark: SparkSession, rows: DataFrame, size: Column, name: str) -> tuple[DataFrame, int]:
    """``rows`` stored with ``block``, so many blocks that each has about BLOCK_BYTES by ``size``, and their number."""
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = -(-int(total) // BLOCK_BYTES)
    if blocks <= 1:
        return common.stored(spark, rows.withColumn("block", F.lit(0)), name), blocks
    path = common.new_path(spark, name)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    dealt.write.partitionBy("block").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path), blocks


def gathered(batches: Iterator[pa.RecordBatch], first: int, most: int) -> Iterator[pa.Table]:
    """The batches as tables of about ``first`` rows, then twice as many each, up to ``most``."""
    held, n, size = [], 0, first
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, size = [], 0, min(2 * size, most)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def numbers(table: pa.Table | pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return column(table, name).fill_null(null).to_numpy(zero_copy_only=False)


def dense(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix; a short list is followed by zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def dense_doubles(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Lists of ``width`` doubles as rows of a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def largest(x: np.ndarray) -> int:
    """The largest magnitude in ``x``."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


class Rows:
    """Rows of a matrix for exact products: as doubles, and as Python's numbers where doubles would round."""

    def __init__(self, x: np.ndarray):
        self.x, self.most = x, largest(x)
        self.doubles = x.astype(np.float64) if self.most < EXACT else None

    def times(self, other: Rows, margin: int = 1) -> np.ndarray:
        """Inner products of all rows of both; also ``margin`` times them are exact."""
        if self.doubles is not None and other.doubles is not None and self.x.shape[1] * self.most * other.most * margin < EXACT:
            return self.doubles @ other.doubles.T
        return self.x.astype(object) @ other.x.astype(object).T

    def part(self, start: int, end: int) -> Rows:
        return Rows(self.x[start:end])


class Best:
    """Of each owner the first ``k`` rows by falling score, then id (none last), then row. Any two can be merged."""

    FIELDS = ("owner", "score", "without", "id", "row")

    def __init__(self, k: int, owners: int):
        self.k = k
        self.owner, self.without = np.empty(0, np.int64), np.empty(0, bool)
        self.score, self.id, self.row = (np.empty(0, np.int64) for _ in range(3))
        #: The least score that may still be among the best of an owner; meaningless where ``full`` is false.
        self.least, self.full = np.zeros(owners, np.int64), np.zeros(owners, bool)

    def add(self, owner: np.ndarray, score: np.ndarray, without: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(owner):
            return
        every = [np.concatenate([getattr(self, f), x]) for f, x in zip(self.FIELDS, (owner, score.astype(np.int64), without, id_, row))]
        order = np.lexsort((every[4], every[3], every[2], -every[1], every[0]))
        own = every[0][order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        order = order[place < self.k]
        for f, x in zip(self.FIELDS, every):
            setattr(self, f, x[order])
        last = place[place < self.k] == self.k - 1
        self.full[self.owner[last]] = True
        self.least[self.owner[last]] = self.score[last]

    def floor(self, start: int, end: int) -> np.ndarray:
        """``least`` of the owners start..end-1 as doubles or Python's numbers, minus infinity where any score may come in."""
        least = self.least[start:end]
        out = least.astype(np.float64) if not len(least) or largest(least) < EXACT else least.astype(object)
        out[~self.full[start:end]] = -np.inf
        return out


def contenders(scores: np.ndarray, allowed: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, column) of the allowed scores that may be among the ``k`` best of their row, ties included."""
    kept = np.where(allowed, scores, -np.inf)
    if kept.shape[1] > k:
        at = kept.shape[1] - k
        floor = np.maximum(floor, np.partition(kept, at, axis=1)[:, at])
    return np.nonzero(allowed & (kept >= floor[:, None]))
