"""Matrix Market text files as (mid, i, j, v) tables, and back.

The header is parsed on the driver (a few lines); entries are read and parsed by Spark. Files are 1-based, tables
0-based. Symmetric kinds store one triangle: the mirrored entries are added (negated, or conjugated), the diagonal once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators.structure import transpose
from stratum.types import BadInput


@dataclass(frozen=True)
class Header:
    sparse: bool
    is_complex: bool
    symmetry: str
    nrows: int
    ncols: int
    nnz: int
    #: Lines before the first entry.
    lines: int


def by_name(path: str) -> list[str | int]:
    """Sorts files by name, the numbers in it by value: a writer's part c1000 comes after its c999."""
    return [int(word) if word.isdecimal() else word for word in re.split(r"([0-9]+)", path)]


def _first_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of the parts in the order of their names, some at a time."""
    for file in sorted(spark.read.text(path).inputFiles(), key=by_name):
        reach, seen = 64, 0
        while True:
            head = spark.read.text(file).limit(reach).collect()
            yield from (row[0] for row in head[seen:])
            if len(head) < reach:
                break
            reach, seen = 16 * reach, len(head)


def parsed(lines: Iterable[str]) -> Header:
    """The header from a file's first lines."""
    lines = iter(lines)
    first = next(lines, None)
    if first is None:
        raise BadInput("empty file")
    words, count, sizes = first.split(), 0, None
    for line in lines:
        count += 1
        if line.strip() and not line.lstrip().startswith("%"):
            sizes = line.split()
            break
    if sizes is None:
        raise BadInput("no sizes")
    if len(words) != 5 or words[0] != "%%MatrixMarket":
        raise BadInput("no banner")
    what, form, field, symmetry = (w.lower() for w in words[1:])
    if what != "matrix" or form not in ("coordinate", "array") or field not in ("real", "complex") or symmetry not in ("general", "symmetric", "hermitian", "skew-symmetric"):
        raise BadInput(f"not supported: {first}")
    if len(sizes) != (3 if form == "coordinate" else 2):
        raise BadInput("sizes do not fit the format")
    rows, cols, *rest = map(int, sizes)
    return Header(form == "coordinate", field == "complex", symmetry, rows, cols, rest[0] if rest else rows * cols, count + 1)


def query(spark: SparkSession, path: str) -> Header:
    """The header of a file, without reading its entries."""
    return parsed(_first_lines(spark, path))


def _entries(spark: SparkSession, path: str, head: Header) -> DataFrame:
    """(n, w): the words of each entry's line, numbered in the order of the parts' names and of the lines in them.

    Lines are numbered by split: a count per split reaches the driver, and every line adds what lies before. The size
    line is the first, whatever its form.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where((F.col("value") != "") & ~F.col("value").startswith("%"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most")).collect()
    ahead, shifts = -1, []
    for row in sorted(splits, key=lambda r: (by_name(r["file"]), r["block"])):
        if row["most"] - row["least"] >> 33:
            raise BadInput("a split lies in two partitions")
        shifts.append((row["file"], row["block"], ahead))
        ahead += row["n"]
    if ahead != head.nnz:
        raise BadInput(f"{ahead} entries where {head.nnz} are declared")
    # Comments and blank lines leave gaps in the numbers, so places in a split are counted, not subtracted.
    table = spark.createDataFrame(shifts, "file string, block long, ahead long")
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = lines.withColumn("place", place).join(F.broadcast(table), ["file", "block"])
    return numbered.select((F.col("ahead") + F.col("place")).alias("n"), F.split("value", r"\s+").alias("w")).where("n >= 0")


def expand(coo: DataFrame, symmetry: str) -> DataFrame:
    """The whole matrix of a stored triangle."""
    if symmetry == "general":
        return coo
    mirror = transpose(coo) if "v" in coo.columns else coo.select("mid", F.col("j").alias("i"), F.col("i").alias("j"), "re", "im")
    if symmetry == "skew-symmetric":
        mirror = mirror.withColumns({c: -F.col(c) for c in ("v", "re", "im") if c in coo.columns})
    if symmetry == "hermitian" and "im" in coo.columns:
        mirror = mirror.withColumn("im", -F.col("im"))
    return coo.union(mirror.where("i <> j").select(coo.columns))


def read(spark: SparkSession, path: str, mid: str) -> tuple[DataFrame, DataFrame]:
    """(entries, sizes) of a coordinate file; complex ones have re and im."""
    head = query(spark, path)
    if not head.sparse:
        raise BadInput("a dense file")
    rows = _entries(spark, path, head)
    place = [F.lit(mid).alias("mid"), (F.col("w")[0].cast("long") - 1).alias("i"), (F.col("w")[1].cast("long") - 1).alias("j")]
    values = [F.col("w")[2].cast("double").alias("re"), F.col("w")[3].cast("double").alias("im")] if head.is_complex else [F.col("w")[2].cast("double").alias("v")]
    meta = spark.createDataFrame([(mid, head.nrows, head.ncols, head.is_complex, head.symmetry)], "mid string, nrows long, ncols long, is_complex boolean, symmetry string")
    return expand(rows.select(*place, *values), head.symmetry), meta


def read_vector(spark: SparkSession, path: str, mid: str) -> DataFrame:
    """(mid, i, x), or (mid, i, re, im) of a complex file: the first column of an array file."""
    head = query(spark, path)
    if head.sparse:
        raise BadInput("not an array file")
    rows = _entries(spark, path, head).where(F.col("n") < head.nrows)
    values = [F.col("w")[k].cast("double").alias(c) for k, c in enumerate(("re", "im") if head.is_complex else ("x",))]
    return rows.select(F.lit(mid).alias("mid"), F.col("n").alias("i"), *values)


def write(coo: DataFrame, nrows: int, ncols: int, path: str, digits: int = 16) -> None:
    """One matrix as a ``general`` coordinate file in a folder: rows in order, all parts in the order of their names."""
    form = f"%.{digits}e"
    body = [F.format_string(form, c) for c in (("re", "im") if "re" in coo.columns else ("v",))]
    rows = coo.select((F.col("i") * 2 + 2).alias("k"), F.col("j").alias("l"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, *body).alias("value"))
    kind = "complex" if "re" in coo.columns else "real"
    head = rows.sparkSession.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate {kind} general"), (1, 0, f"{nrows} {ncols} {coo.count()}")], "k long, l long, value string")
    head.union(rows).orderBy("k", "l").select("value").write.text(path)


def write_vector(x: DataFrame, path: str, digits: int = 16, per_file: int = 0) -> None:
    """A vector (i, x) or (i, re, im) as an array file in a folder, of at most ``per_file`` lines a part (0: any)."""
    columns = ("re", "im") if "re" in x.columns else ("x",)
    rows = x.select((F.col("i") + 2).alias("k"), F.concat_ws(" ", *(F.format_string(f"%.{digits}e", c) for c in columns)).alias("value"))
    kind = "complex" if "re" in x.columns else "real"
    head = x.sparkSession.createDataFrame([(0, f"%%MatrixMarket matrix array {kind} general"), (1, f"{x.count()} 1")], "k long, value string")
    head.union(rows).orderBy("k").select("value").write.option("maxRecordsPerFile", per_file).text(path)


def write_native(coo: DataFrame, meta: DataFrame, path: str) -> None:
    """Parquet: entries by matrix, and sizes."""
    coo.write.parquet(f"{path}/entries")
    meta.write.parquet(f"{path}/sizes")


def read_native(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/sizes")
