"""Best-fit decreasing packing of token sequences.

A document longer than a window is first cut into full windows; the rest is a piece. Pieces are placed in
descending length, each into the open window with the least room that still takes it; a segment tree over the
remaining capacities finds that window. Pieces are dealt over shards, and each shard is packed
for itself, so that a shard leaves a few open windows at most. Only piece lengths are moved, never token ids.

Defined results: a null text is an empty one and has the end id alone; repeated rows are documents of their own
(a piece then appears as often); null ids are packed under a null id; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.tokens import MEMORY

WINDOW = 4096
END_ID = 2
#: Rows that are tokenized in one step.
STEP_ROWS = 250
#: Pieces of a shard, about.
SHARD_PIECES = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class BestFit:
    """Open windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int):
        self.window, self.size = window, 1 << window.bit_length()
        self.count = np.zeros(2 * self.size, np.int64).tolist()
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.used: list[int] = []

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def _tightest(self, least: int) -> int:
        """The least capacity of an open window that is ``least`` or more, or -1."""
        node, count = least + self.size, self.count
        if count[node]:
            return least
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not count[2 * node])
                return node - self.size
            node >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        room = self._tightest(length)
        if room < 0:
            at, room = len(self.used), self.window
            self.used.append(0)
        else:
            at = self.open[room].pop()
            self._add(room, -1)
        offset = self.used[at]
        self.used[at] += length
        if room > length:
            self.open[room - length].append(at)
            self._add(room - length, 1)
        return at, offset


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """The pieces of every document with their length and check sum, and a number ``row``; ``memory`` bounds the encoder's."""

    def cut(batches):
        from stratum.llm.tokens import encoder

        common.trim()
        tokens = encoder(tokenizer, memory)
        for batch in (batch.slice(k, STEP_ROWS) for batch in batches for k in range(0, batch.num_rows, STEP_ROWS)):
            out = []
            for doc, ids in zip(batch.column("id").to_pylist(), tokens.each(batch.column("text"), end_id)):
                for k in range(0, len(ids), 4 * window):
                    part = ids[k : k + 4 * window]
                    out.append((doc, k // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        common.trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES).withColumn("row", F.monotonically_increasing_id())


def pack(spark: SparkSession, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """PIECES with the sequence and the offset of each; a sequence's number holds its shard above 32 bits.

    ``found`` is stored, so that a piece keeps its ``row`` and shard; equal rows are spread as all others are.
    """
    shards = max(1, -(-found.count() // SHARD_PIECES))

    def fit(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        shard, tree = table.column("shard")[0].as_py(), BestFit(window)
        at = [tree.place(x) for x in order.column("length").to_pylist()]
        placed = np.array(at, np.int64).reshape(-1, 2)
        order = order.append_column("sequence_id", pa.array(placed[:, 0] + (shard << 32))).append_column("offset", pa.array(placed[:, 1]))
        return order.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).drop("row")
    return dealt.groupBy("shard").applyInArrow(fit, PACKED)


def packed(spark: SparkSession, docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the production parameters, packed."""
    import public_tokenizers

    found = common.stored(spark, pieces(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), memory=memory), "pieces")
    return pack(spark, found)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 4096 tokens."""
    return packed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
