"""Token ids in wavelet-matrix shards: one file holds the ids, and answers access, counting and occurrence lookup.

A shard's file has a header (with its place among the shards), its documents' ids and starts, and one bit-plane per bit
of a token id from the highest down, in blocks under zstd, with the number of ones before every 512th bit. The planes
are the token ids: nothing else is stored. A block is unpacked when a look-up comes by it. Documents lie in ascending
order of their id over the shards, each whole in one shard.

Defined results: a null text is an empty one and gives the end id alone; rows with equal ids keep all their
documents, next to each other, in the order of a hash of their text and then the text; null ids come first (a file
has a mark for them); an empty table gives no shard and no row. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.hashing import expand, squeeze

END_ID = 2
#: Token ids of a shard, unless one document alone has more.
SHARD_TOKENS = 4 << 20
_MAGIC = b"WVLT0002"
_HEAD = "<8sQQIqqQ"
_HEAD_BYTES = struct.calcsize(_HEAD)
#: Bits between two counts of ones, and bytes of a plane in a block of the file.
_COUNTED, _BLOCK = 512, 1 << 15
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
#: By a number of bits: the bytes of a counted stretch that has ones in its first bits.
_FIRST = np.packbits(np.arange(_COUNTED) < np.arange(_COUNTED)[:, None], axis=1, bitorder="little")

MANIFEST = "path string, docs long, tokens long, bytes long"


def build(ids: np.ndarray, doc_ids: np.ndarray, without: np.ndarray, starts: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """The bytes of a shard's file; documents ``without`` an id have the mark."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    values, packer = ids.astype(np.uint16 if bits <= 16 else np.uint32), zstandard.ZstdCompressor(level=1)
    blobs = [squeeze(np.diff(doc_ids.astype("<i8"), prepend=np.int64(0)), without.astype(np.uint8), np.diff(starts.astype("<i8"), prepend=np.int64(0)))]
    for bit in range(bits - 1, -1, -1):
        one = (values & values.dtype.type(1 << bit)) != 0
        plane = np.packbits(one, bitorder="little")
        plane = np.concatenate([plane, np.zeros(-len(plane) % (_COUNTED // 8), np.uint8)])
        ones = _ONES[plane].reshape(-1, _COUNTED // 8).sum(axis=1, dtype=np.uint32)
        blobs.append(squeeze(ones.astype("<u2")))
        data = plane.tobytes()
        blobs += [packer.compress(data[k : k + _BLOCK]) for k in range(0, len(data), _BLOCK)]
        values = np.concatenate([np.compress(~one, values), np.compress(one, values)])
    sizes = np.array([len(b) for b in blobs], "<u8").tobytes()
    return b"".join([struct.pack(_HEAD, _MAGIC, len(ids), len(doc_ids), bits, part, seq, len(blobs)), sizes, *blobs])


def head(data: bytes) -> tuple[int, int, int]:
    """(part, place in the part, ids) of a shard, from the first bytes of its file."""
    magic, n, _, _, part, seq, _ = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a wavelet shard")
    return part, seq, n


class WaveletMatrix:
    """A shard's file: ``access``, ``rank``, ``count``, ``select`` and ``decode`` work on its planes."""

    def __init__(self, data: bytes):
        head(data)
        _, self.n, self.n_docs, self.bits, _, _, many = struct.unpack_from(_HEAD, data)
        sizes = np.frombuffer(data, "<u8", many, _HEAD_BYTES).astype(np.int64)
        ends = _HEAD_BYTES + 8 * many + np.cumsum(sizes)
        blobs = [memoryview(data)[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        steps, without, starts = expand(blobs[0], self.n_docs, "<i8", "u1", "<i8")
        self.doc_ids, self.without, self.starts = np.cumsum(steps), without.astype(bool), np.cumsum(starts)
        stretches = -(-self.n // _COUNTED)
        per = 1 + -(-stretches * (_COUNTED // 8) // _BLOCK)
        self.planes, self.before, self.zeros, self.packed = [], [], [], []
        for level in range(self.bits):
            own = blobs[1 + level * per : 1 + (level + 1) * per]
            ones = expand(own[0], stretches, "<u2")[0]
            self.before.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]))
            self.zeros.append(self.n - int(self.before[-1][-1]))
            self.planes.append(np.zeros(stretches * (_COUNTED // 8), np.uint8))
            self.packed.append(dict(enumerate(own[1:])))

    def _plane(self, level: int, at: np.ndarray | None = None) -> np.ndarray:
        """The bytes of a plane, of which those at the positions (else all) are unpacked."""
        packed, plane = self.packed[level], self.planes[level]
        for k in list(packed) if at is None else np.unique(at // (8 * _BLOCK)).tolist() if packed else ():
            if k in packed:
                data = zstandard.ZstdDecompressor().decompress(packed.pop(k))
                plane[k * _BLOCK : k * _BLOCK + len(data)] = np.frombuffer(data, np.uint8)
        return plane

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        stretch, rest = at // _COUNTED, at % _COUNTED
        out, some = self.before[level][stretch], np.flatnonzero(rest)
        if len(some):
            plane = self._plane(level, at[some]).reshape(-1, _COUNTED // 8)
            out[some] += _ONES[plane[stretch[some]] & _FIRST[rest[some]]].sum(axis=1, dtype=np.int64)
        return out

    def access(self, positions) -> np.ndarray:
        """The ids at the positions."""
        at, out = np.array(positions, np.int64), np.zeros(len(positions), np.int64)
        for level in range(self.bits):
            one = self._plane(level, at)[at // 8] >> (at % 8).astype(np.uint8) & 1
            ones = self._ones(level, at)
            out = out << 1 | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where on the lowest level the token's occurrences before each of ``ends`` lie."""
        ends = np.array(ends, np.int64)
        if token < 0 or token >> self.bits:
            return np.zeros_like(ends), np.zeros_like(ends)
        low, high = np.zeros(1, np.int64), ends
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return np.broadcast_to(low, high.shape), high

    def ranks(self, token: int, ends) -> np.ndarray:
        """Occurrences of the token before each position."""
        low, high = self._range(token, ends)
        return high - low

    def rank(self, token: int, end: int) -> int:
        return int(self.ranks(token, [end])[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the token's occurrence number ``k``, from 0; -1 if there are not so many."""
        low, high = (int(x[0]) for x in self._range(token, [self.n]))
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def _select(self, level: int, one: int, k: int) -> int:
        before = self.before[level]
        if not one:
            before = np.arange(len(before)) * _COUNTED - before
        stretch = int(np.searchsorted(before, k, side="right")) - 1
        plane = self._plane(level, np.array([stretch * _COUNTED]))
        bits = np.unpackbits(plane[stretch * (_COUNTED // 8) : (stretch + 1) * (_COUNTED // 8)], bitorder="little")
        return stretch * _COUNTED + int(np.flatnonzero(bits == one)[k - before[stretch]])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._plane(level), count=self.n, bitorder="little").view(bool)
            upper, zeros = np.empty(self.n, kind), self.zeros[level]
            np.place(upper, ~one, values[:zeros])
            np.place(upper, one, values[zeros:] | kind(1 << (self.bits - 1 - level)))
            values = upper
        return values


def in_order(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """``docs`` dealt by ranges of the id over partitions 0, 1, ..., sorted in each, rows of one id by their text.

    The bounds come from the ids alone, so the other columns are read once. At most ``parts`` bounds reach the driver.
    """
    bounds = common.range_bounds(docs, id_col, parts)
    rows = common.with_part(docs, id_col, bounds, "_part")
    return rows.repartitionById(len(bounds) + 1, F.col("_part")).sortWithinPartitions("_part", id_col, F.xxhash64(text_col))


def write_shards(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Tokenises and writes; the stored manifest names the files of the attempts that count."""
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from stratum.llm.tokens import encoder

        tokens = encoder(tokenizer)
        held, ids, starts, n, seq, part = [], [], [], 0, 0, 0
        out = []

        def flush():
            nonlocal held, ids, starts, n, seq
            if ids:
                without = np.array([i is None for i in ids])
                data = build(np.frombuffer(b"".join(held), "<u4"), np.array([i or 0 for i in ids], np.int64), without, np.array(starts, np.int64), part, seq)
                path = f"{folder}/{uuid.uuid4().hex}.wvm"
                store, at = fs.FileSystem.from_uri(path)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at, compression=None) as sink:
                    sink.write(data)
                out.append((path, len(ids), n, len(data)))
                held, ids, starts, n, seq = [], [], [], 0, seq + 1

        for batch in batches:
            for doc, found, at in zip(batch.column("id").to_pylist(), tokens.each(batch.column("text"), end_id), batch.column("_part").to_pylist()):
                if at != part:
                    flush()
                    part, seq = at, 0
                if n and n + len(found) // 4 > SHARD_TOKENS:
                    flush()
                held.append(found)
                ids.append(doc)
                starts.append(n)
                n += len(found) // 4
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "docs", "tokens", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.stored(spark, in_order(rows, "id", "text", parts).mapInArrow(write, MANIFEST), "wavelet-manifest")


def placed(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(path, start) of the shards: the ids before each, by the heads of the files."""

    def read(batches):
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as source:
                    found.append((path, *head(source.read(_HEAD_BYTES))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "part", "seq", "n"])

    heads = common.stored(spark, shards.select("path").mapInArrow(read, "path string, part long, seq long, n long"), "wavelet-heads")
    # Ids before a shard: those of earlier parts (a row for each part meets in one task) and of the part's earlier shards.
    whole = heads.groupBy("part").agg(F.sum("n").alias("n"))
    whole = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    return heads.withColumn("inside", inside).join(whole, "part").select("path", (F.col("ahead") + F.col("inside")).alias("start"))


def read_documents(spark: SparkSession, shards: DataFrame, token: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_of_token) of every document in the shards' files: its place among all ids,
    its ids' number and check sum from the planes, and the occurrences of ``token`` by rank."""

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as source:
                    shard = WaveletMatrix(source.read())
                ends = np.append(shard.starts[1:], shard.n)
                many = np.diff(shard.ranks(token, np.append(shard.starts, shard.n)))
                ids = shard.decode().astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(shard.starts, ends)]
                docs = pa.array(shard.doc_ids, pa.int64(), mask=shard.without)
                yield pa.RecordBatch.from_arrays([docs, pa.array(first + shard.starts), pa.array(ends - shard.starts), pa.array(crc, pa.int64()), pa.array(many)], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_of_token"])

    deal = max(1, min(4096, spark.sparkContext.defaultParallelism * 4))
    return placed(spark, shards).repartition(deal, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, n_of_token long")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token ids in wavelet shards, read back; ``n_end_ids`` counts the end id by rank."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(spark, docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), common.new_path(spark, "wavelet"))
    return read_documents(spark, shards).withColumnRenamed("n_of_token", "n_end_ids")
