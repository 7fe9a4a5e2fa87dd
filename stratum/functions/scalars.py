"""Scalar functions: complex numbers as struct<re, im>, safe division, static partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complex_of(re: Column, im: Column | float = 0.0) -> Column:
    im = im if isinstance(im, Column) else F.lit(im)
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def conjugate(z: Column) -> Column:
    return complex_of(z["re"], F.lit(0.0) - z["im"])


def add(x: Column, y: Column) -> Column:
    return complex_of(x["re"] + y["re"], x["im"] + y["im"])


def times(x: Column, y: Column) -> Column:
    return complex_of(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def over(x: Column, y: Column) -> Column:
    """x / y; null where y is 0."""
    size = y["re"] * y["re"] + y["im"] * y["im"]
    top = times(x, conjugate(y))
    return F.when(size > 0, complex_of(top["re"] / size, top["im"] / size))


def inner_complex(x: DataFrame, y: DataFrame) -> DataFrame:
    """(mid, re, im): the sum of conj(x) y for vectors (mid, i, re, im)."""
    right = y.select("mid", "i", F.col("re").alias("yr"), F.col("im").alias("yi"))
    both = x.join(right, ["mid", "i"])
    return both.groupBy("mid").agg(F.sum(F.col("re") * F.col("yr") + F.col("im") * F.col("yi")).alias("re"), F.sum(F.col("re") * F.col("yi") - F.col("im") * F.col("yr")).alias("im"))


def uniform_partition(rows: DataFrame, parts: int) -> DataFrame:
    """(mid, part, first, end): each matrix's rows in ``parts`` runs of about equal length, from its size table."""
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    each = rows.select("mid", "nrows", part)
    size, rest = F.floor(F.col("nrows") / parts), F.col("nrows") % parts
    first = F.col("part") * size + F.least(F.col("part"), rest)
    return each.select("mid", "part", first.cast("long").alias("first"), (first + size + (F.col("part") < rest).cast("int")).cast("long").alias("end"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """A sparse vector less the places (mid, i) of ``gone``."""
    return rows.join(gone.select("mid", "i"), ["mid", "i"], "left_anti")


def first_where(rows: DataFrame, holds: Column) -> DataFrame:
    """(mid, i, x): each vector's first entry for which ``holds``; none where there is none."""
    found = rows.where(holds).groupBy("mid").agg(F.min(F.struct("i", "x")).alias("e"))
    return found.select("mid", "e.i", "e.x")


def ranked(rows: DataFrame, by: str = "i") -> DataFrame:
    """A sparse vector's entries (mid, i, x) with their place in order, zeros and repeated indices left out."""
    from stratum.operators.numbering import running

    return running(rows.where("x <> 0").dropDuplicates(["mid", "i"]), [by])
