"""WARC archives written from a table and read back as a table of payload chunks.

``write_warc`` writes gzip members, one per record, into files of a bounded size and returns a manifest.
``read_warc`` streams the files: no record is ever held whole. It gives one row per chunk with the
record's id, the chunk's number and the digest of all payload up to the chunk's end, so the last chunk
carries the digest of the record. Revisit and empty records have one chunk without data.

Defined results: a null payload is an empty one; a null url leaves out the target; a null id is written as
a record with a random-free id of its digest and read back as null; repeated rows are repeated records.
An empty table gives no file and no row. Columns of the input besides those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common

CHUNK_BYTES = 1 << 20
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 18
#: Upper half of the record ids; the lower half is the row's id.
_SPACE = 0x5741524300004000
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
CHUNKS = "file string, record_offset long, record_id string, id long, record_type string, target_uri string, refers_to long, chunk_no long, chunk_offset long, data binary, declared_bytes long, declared_digest string, digest_so_far string, last boolean"


def _record_id(row_id: int | None, digest: str) -> str:
    if row_id is None:
        return f"<urn:sha1:{digest}>"
    return f"<urn:uuid:{uuid.UUID(int=(_SPACE << 64) | (row_id & (1 << 64) - 1))}>"


def _row_id(record_id: str) -> int | None:
    if not record_id.startswith("<urn:uuid:"):
        return None
    low = uuid.UUID(record_id[10:-1]).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _head(row_id, url, digest: str, size: int, refers_to) -> tuple[bytes, bytes]:
    """The record's head and the head of the HTTP message in it."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(row_id, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    block = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode(), http


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """(id, url, payload, sha1, bytes, refers_to): of equal payloads the least id is kept, others refer to it."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "bytes": F.length("payload").cast("long")})
    rows = common.minimum_of_key(rows, ["sha1", "bytes"], "id", "first")
    other = (F.col("bytes") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    rows = rows.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")
    return rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write_warc(spark: SparkSession, rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = 1) -> DataFrame:
    """Writes ``records()`` rows; the manifest is a stored table, so files of failed attempts are never read."""

    def write(batches):
        out, path, sink, count, size = [], None, None, 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "sha1", "bytes", "refers_to")]
            for i in range(batch.num_rows):
                row_id, url, payload, sha1, length, refers_to = (c[i] for c in columns)
                row_id, url, length, refers_to = (x.as_py() for x in (row_id, url, length, refers_to))
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, at = _open(path)
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    sink, count, size = store.open_output_stream(at, compression=None), 0, 0
                gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
                head, http = _head(row_id, url, _base32(sha1.as_py()), length, refers_to)
                parts = [gzip.compress(head + http)]
                if refers_to is None:
                    body = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                    for k in range(0, len(body), CHUNK_BYTES):
                        parts.append(gzip.compress(body[k : k + CHUNK_BYTES]))
                        if len(parts) > 8:
                            size += sink.write(b"".join(parts)) or sum(map(len, parts))
                            parts = []
                parts += [gzip.compress(b"\r\n\r\n"), gzip.flush()]
                data = b"".join(parts)
                sink.write(data)
                size += len(data)
                count += 1
                if size >= file_bytes:
                    sink.close()
                    out.append((path, count, size))
                    sink = None
        if sink is not None:
            sink.close()
            out.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return common.stored(spark, rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _Members:
    """The decompressed bytes of a file of gzip members, with the offset at which each member starts."""

    def __init__(self, source):
        self.source, self.raw, self.offset, self.end = source, b"", 0, False

    def fill(self) -> bool:
        if not self.raw and not self.end:
            self.raw = self.source.read(READ_BYTES)
            self.end = not self.raw
        return bool(self.raw)

    def member(self):
        """Pieces of the next member, or None at the end."""
        if not self.fill():
            return None
        return self._pieces(zlib.decompressobj(31))

    def _pieces(self, gzip):
        while not gzip.eof:
            if not self.fill():
                raise EOFError("a record is cut off")
            before = len(self.raw)
            piece = gzip.decompress(self.raw, READ_BYTES)
            self.raw = gzip.unused_data if gzip.eof else gzip.unconsumed_tail
            self.offset += before - len(self.raw)
            if piece:
                yield piece


def _fields(head: bytes) -> dict[str, str]:
    return dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))


def _chunks_of(file: str, chunk_bytes: int):
    """Rows of CHUNKS, streamed."""
    store, at = _open(file)
    with store.open_input_stream(at, compression=None) as source:
        members = _Members(source)
        while True:
            offset, pieces = members.offset, members.member()
            if pieces is None:
                return
            buffer, heads = bytearray(), []
            while len(heads) < 2:
                cut = buffer.find(b"\r\n\r\n")
                if cut >= 0:
                    heads.append(_fields(bytes(buffer[:cut])))
                    del buffer[: cut + 4]
                else:
                    buffer += next(pieces)
            warc, http = heads
            revisit, declared = warc["warc-type"] == "revisit", int(http["content-length"])
            target = warc.get("warc-target-uri")
            base = (file, offset, warc["warc-record-id"], _row_id(warc["warc-record-id"]), warc["warc-type"], target and urllib.parse.unquote(target), _row_id(warc["warc-refers-to"]) if revisit else None)
            digest = warc["warc-payload-digest"].partition(":")[2]
            left, state, number, done = 0 if revisit else declared, hashlib.sha1(), 0, 0
            while True:
                while len(buffer) < min(left, chunk_bytes):
                    buffer += next(pieces)
                data = bytes(buffer[: min(left, chunk_bytes)])
                del buffer[: len(data)]
                state.update(data)
                left -= len(data)
                yield (*base, number, done, data, declared, digest, digest if revisit else base64.b32encode(state.digest()).decode(), not left)
                number, done = number + 1, done + len(data)
                if not left:
                    break
            for _ in pieces:  # the record's closing line ends
                pass


def read_warc(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table (CHUNKS) of the files in ``manifest.path``; one task reads a file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    frame = spark.createDataFrame([], CHUNKS)
    schema = to_arrow_schema(frame.schema)

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for file in batch.column("path").to_pylist():
                for row in _chunks_of(file, chunk_bytes):
                    rows.append(row)
                    size += len(row[9]) + 300
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    files = manifest.select("path")
    return files.repartition(max(1, min(4096, spark.sparkContext.defaultParallelism * 2)), F.xxhash64("path")).mapInArrow(read, CHUNKS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC and read back: one row per page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = common.new_path(spark, "warc")
    manifest = write_warc(spark, records(pages, "page_id", "url", "html", 0), folder)
    chunks = read_warc(spark, manifest)
    ends = chunks.where("last")
    return ends.select(
        F.col("id").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("declared_bytes")).otherwise(F.col("chunk_offset") + F.length("data")).alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.col("digest_so_far") == F.col("declared_digest")).alias("digest_ok"),
    )


SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda b: ((strpos('0123456789abcdef', substr(x, 1 + CAST((g * 5 + b) // 4 AS INTEGER), 1)) - 1) >> (3 - (g * 5 + b) % 4) & 1) * (16 >> b))) AS INTEGER), 1), '' ORDER BY g) FROM range(0, 32) t(g)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, TRUE AS digest_ok
FROM d""",
}
