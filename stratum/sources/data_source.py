"""Matrix Market files as a Spark data source: ``spark.read.format("matrixmarket")`` and ``df.write.format("matrixmarket")``.

    spark.dataSource.register(MatrixMarket)
    spark.read.format("matrixmarket").load(path)
    df.write.format("matrixmarket").mode("append").option("nrows", n).option("ncols", m).save(path)

A path is a file, or a folder whose files count in the order of their names, the first with the banner and the sizes. The
schema follows from the banner: (i, j, v), (i, j, re, im), or of array files (range, line, x) or (range, line, re, im),
which ``vector`` numbers. Files are read by ranges of bytes, each a task that parses some MB at a time; a line belongs to
the range in which it starts. Symmetric kinds are given whole. The declared number of entries is not compared with what
is found; ``matrix_market.read`` does that. Paths are opened by ``pyarrow.fs``; for stores that only Spark opens there is
``matrix_market.read``.

Writers put each task's lines into a file of its own, under a name that is not read; at the commit those of the attempts
that count get their names, and the banner with the number of entries is written as the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stratum.operators.numbering import running
from stratum.sources.matrix_market import Header, by_name, parsed
from stratum.types import BadInput

#: Bytes of a range, and of what a task parses at once.
RANGE, CHUNK = 64 << 20, 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, at = _opened(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.Directory:
        found = [f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return store, sorted(found, key=lambda f: by_name(f.base_name))
    if found.type != fs.FileType.File:
        raise BadInput(f"no file at {path}")
    return store, [found]


def header(path: str) -> tuple[Header, int]:
    """The header of the first file, and the bytes that it takes there."""
    store, files = _files(path)
    if not files:
        raise BadInput("empty file")
    text, at = b"", 0
    with store.open_input_file(files[0].path) as file:
        while True:
            more = file.read(1 << 16)
            text += more
            lines = text.split(b"\n")
            whole = lines if not more else lines[:-1]
            for k, line in enumerate(whole[1:], 1):
                if line.strip() and not line.lstrip().startswith(b"%"):
                    at = min(len(text), sum(len(x) + 1 for x in whole[: k + 1]))
                    return parsed([x.decode() for x in whole[: k + 1]]), at
            if not more:
                return parsed([x.decode() for x in whole]), len(text)


@dataclass
class Range(InputPartition):
    number: int
    file: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.head, self.skip = header(path)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for k, file in enumerate(_files(self.path)[1]):
            for start in range(0 if k else self.skip, file.size, self.size):
                out.append(Range(len(out), file.path, start, min(start + self.size, file.size)))
        return out or [Range(0, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        line = 0
        for text in self._lines(part) if part.file else ():
            if b"%" in text:
                text = b"\n".join(x for x in text.split(b"\n") if not x.lstrip().startswith(b"%"))
            batch = self._batch(part, line, text.split())
            line += batch.num_rows
            yield batch

    def _lines(self, part: Range) -> Iterator[bytes]:
        """Whole lines that start in the range, some MB at a time."""
        store = _opened(self.path)[0]
        with store.open_input_file(part.file) as file:
            first = part.file == _files(self.path)[1][0].path
            at, rest = part.start, b""
            if at > (self.skip if first else 0):  # the line before may reach into the range
                at -= 1
                file.seek(at)
                while True:
                    more = file.read(1 << 12)
                    cut = more.find(b"\n")
                    if cut >= 0 or not more:
                        break
                    at += len(more)
                if not more:
                    return
                at += cut + 1
            file.seek(at)
            while at < part.end:
                more = file.read(CHUNK)
                if not more:
                    break
                text, at = rest + more, at + len(more)
                if at >= part.end:  # up to the end of the line that the range's last byte is in
                    spare = at - part.end
                    cut = text.find(b"\n", max(0, len(text) - spare - 1))
                    while cut < 0 and (more := file.read(1 << 12)):
                        cut, text = (len(text) + more.find(b"\n") if b"\n" in more else -1), text + more
                    yield text if cut < 0 else text[:cut]
                    return
                cut = text.rfind(b"\n") + 1
                rest = text[cut:]
                if cut:
                    yield text[:cut]
            if rest:
                yield rest

    def _batch(self, part: Range, line: int, words: list[bytes]) -> pa.RecordBatch:
        values = 2 if self.head.is_complex else 1
        wide = values + (2 if self.head.sparse else 0)
        if len(words) % wide:
            raise BadInput(f"{part.file}: a line that has not {wide} words")
        columns = [np.array(words[k::wide], "S") if words else np.empty(0, "S1") for k in range(wide)]
        numbers = [c.astype(float) for c in columns[-values:]]
        names = ["re", "im"] if values > 1 else ["v" if self.head.sparse else "x"]
        if not self.head.sparse:
            n = len(numbers[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part.number)), pa.array(np.arange(line, line + n)), *map(pa.array, numbers)], names=["range", "line", *names])
        i, j = (c.astype(np.int64) - 1 for c in columns[:2])
        if self.head.symmetry != "general":
            other = i != j
            i, j = np.concatenate([i, j[other]]), np.concatenate([j, i[other]])
            signs = {"symmetric": (1, 1), "skew-symmetric": (-1, -1), "hermitian": (1, -1)}[self.head.symmetry]
            numbers = [np.concatenate([c, s * c[other]]) for c, s in zip(numbers, signs)]
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, numbers)], names=["i", "j", *names])


@dataclass
class Written(WriterCommitMessage):
    file: str
    entries: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, nrows: int, ncols: int, digits: int):
        self.path, self.names, self.nrows, self.ncols, self.digits = path, schema.fieldNames(), nrows, ncols, digits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        file = f"{at}/_part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        form, n = f"%d %d{f' %.{self.digits}e' * (len(self.names) - 2)}\n", 0
        with store.open_output_stream(file) as out:
            for batch in iterator:
                i, j, *values = (batch.column(c).to_pylist() for c in self.names)
                out.write("".join([form % (a + 1, b + 1, *v) for a, b, *v in zip(i, j, *values)]).encode())
                n += batch.num_rows
        return Written(file, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        parts = [m for m in messages if m is not None]
        kind = "complex" if "re" in self.names else "real"
        with store.open_output_stream(f"{at}/part-0-sizes") as out:
            out.write(f"%%MatrixMarket matrix coordinate {kind} general\n{self.nrows} {self.ncols} {sum(m.entries for m in parts)}\n".encode())
        for m in parts:
            store.move(m.file, m.file.replace("/_part-", "/part-1-"))

    def abort(self, messages: list[Written | None]) -> None:
        store = _opened(self.path)[0]
        for m in messages:
            if m is not None:
                store.delete_file(m.file)


class MatrixMarket(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrixmarket"

    def schema(self) -> str:
        head = header(self.options["path"])[0]
        values = "re double, im double" if head.is_complex else ("v" if head.sparse else "x") + " double"
        return f"i long, j long, {values}" if head.sparse else f"range long, line long, {values}"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("bytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if schema.fieldNames() not in (["i", "j", "v"], ["i", "j", "re", "im"]):
            raise BadInput("columns are not i, j and v, or i, j, re and im")
        store, at = _opened(self.options["path"])
        if store.get_file_info(at).type != fs.FileType.NotFound:
            if not overwrite:
                raise BadInput(f"there is something at {at}")
            store.delete_dir_contents(at)
        return Writer(self.options["path"], schema, int(self.options["nrows"]), int(self.options["ncols"]), int(self.options.get("digits", 16)))


def vector(rows: DataFrame, mid: str) -> DataFrame:
    """(mid, i, x) or (mid, i, re, im) of what was read from an array file of one column: lines numbered through all ranges."""
    values = [c for c in rows.columns if c not in ("range", "line")]
    return running(rows.withColumn("mid", F.lit(mid)), ["range", "line"]).select("mid", F.col("at").alias("i"), *values)
