"""The Matrix Market data source against the reader of whole files, on many parts and ranges of every length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.sources import data_source, matrix_market
from stratum.types import BadInput


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(data_source.MatrixMarket)
    return lambda path, size=1 << 20: spark.read.format("matrixmarket").option("bytes", size).load(str(path))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("kind", ["real general", "real symmetric", "real skew-symmetric", "complex general", "complex hermitian"])
def test_kinds(spark, source, tmp_path, kind):
    draw = np.random.default_rng(1)
    at = sorted({(int(a), int(b)) for a, b in draw.integers(1, 30, (60, 2)) if a > b or "general" in kind or (a == b and "skew" not in kind)})
    values = 2 if "complex" in kind else 1
    lines = [f"{a}   {b} " + " ".join(f"{v:.17g}" for v in draw.standard_normal(values)) for a, b in at]
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a").write_text(f"%%MatrixMarket matrix coordinate {kind}\n% a remark\n\n  % another\n30 30 {len(at)}\n" + "\n".join(lines[:20]) + "\n")
    (folder / "b").write_text("\n".join(lines[20:41]) + "\n% within\n\n")
    (folder / "c").write_text("\n".join(lines[41:]))  # without a last newline
    (folder / "_ignored").write_text("x")
    whole, _ = matrix_market.read(spark, str(folder / "[abc]"), "M")
    columns = ("i", "j", "re", "im") if values > 1 else ("i", "j", "v")
    right = rows(whole, *columns)
    for size in (41, 333, 1 << 20):
        assert rows(source(folder, size), *columns) == right


def test_vector(spark, source, tmp_path):
    x = np.random.default_rng(2).standard_normal(400)
    (tmp_path / "v").write_text("%%MatrixMarket matrix array real general\n400 1\n" + "".join(f"{v:.17g}\n" for v in x))
    for size in (100, 1 << 20):
        found = data_source.vector(source(tmp_path / "v", size), "V").orderBy("i").collect()
        assert [r["i"] for r in found] == list(range(400)) and [r["x"] for r in found] == x.tolist()


def test_round_trip(spark, source, tmp_path):
    a = spark.range(500).select((F.col("id") * 7 % 100).alias("i"), (F.col("id") % 90).alias("j"), (F.sqrt("id") - 3).alias("v")).repartition(5)
    path = str(tmp_path / "w")
    a.write.format("matrixmarket").mode("append").option("nrows", 100).option("ncols", 90).save(path)
    assert matrix_market.query(spark, path).nnz == 500
    assert rows(source(path, 999), "i", "j", "v") == rows(a, "i", "j", "v")
    with pytest.raises(Exception, match="there is something"):
        a.write.format("matrixmarket").mode("append").option("nrows", 100).option("ncols", 90).save(path)
    z = a.select("i", "j", F.col("v").alias("re"), (-F.col("v")).alias("im"))
    z.write.format("matrixmarket").mode("overwrite").option("nrows", 100).option("ncols", 90).save(path)
    assert rows(source(path), "i", "j", "re", "im") == rows(z, "i", "j", "re", "im")
    a.where("false").write.format("matrixmarket").mode("overwrite").option("nrows", 1).option("ncols", 1).save(path)
    assert source(path).count() == 0


def test_faults(spark, source, tmp_path):
    for name, text in (("empty", ""), ("banner", "1 1 1\n1 1 1\n"), ("pattern", "%%MatrixMarket matrix coordinate pattern general\n1 1 1\n1 1\n"), ("sizes", "%%MatrixMarket matrix coordinate real general\n1 1\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(BadInput):
            data_source.header(str(tmp_path / name))
    (tmp_path / "words").write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n1 2\n")
    with pytest.raises(Exception, match="3 words"):
        source(tmp_path / "words").count()
    with pytest.raises(BadInput):
        data_source.header(str(tmp_path / "none"))
