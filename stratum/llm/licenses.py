"""Licence texts and notices by MinHash bands over overlapping windows, with DataFrame functions alone.

A template is a set of hashed 3-word shingles; its class is the least power of two W that is twice its size or more.
A document is cut, for each class, into windows of W shingles that start every W / 2, so an occurrence of a template
lies whole in a window. Window and template then have a Jaccard similarity of about SHARE / 4 or more; with BANDS
bands of one MinHash each, such a pair shares a band with probability 1 - (1 - SHARE / 4) ** BANDS (more than
0.9999). Retrieved pairs are verified by exact containment: SHARE of the template's shingles lie in the window.

Documents that share no shingle with any template, and windows without such a shingle, have containment 0 and are left
out before hashing; nothing else is. Shingles and bands of the templates are stored tables that are joined, so Spark
broadcasts them as long as their size allows and shuffles them beyond; ``texts`` may be a table of any size.

Versions of a licence differ in a few shingles, so several templates can pass SHARE at one place. Of relatives (SHARE
of the one's shingles are in the other, as in two versions of a notice, or a licence and a part of it) at overlapping
windows of a text the one with most matched shingles stays, of equal ones the smaller. Licences are judged in the text
of a row, not among all rows of an id.

Defined results: null and empty texts, and texts of fewer than 3 words, have no licence; rows of one id are scanned
each and give one row per id and licence, the one with most matched shingles and then the first; null ids are kept; an
empty table, or a table of no templates, gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common

SHINGLE = 3
BANDS = 48
SHARE = 0.8

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(what: str, name: str, colon: str, version: str) -> str:
    """The notice that the GNU licences ask for."""
    return f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if colon == ':' else ';'} either version {version} of the License, or (at your option) any later version"


# Public licences, whole where they are short, else the notices by which they are given.
TEMPLATES = {
    "MIT-line": "Released under the MIT License",
    "MIT-grant": _GRANT.split(", and to permit")[0],
    "MIT": f"{_GRANT} {_NO_WARRANTY}",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0": _gnu("program", "General Public License", ";", "2"),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0": _gnu("program", "General Public License", ":", "3"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", ":", "3"),
    "AGPL-3.0": _gnu("program", "Affero General Public License", ":", "3"),
    "BSD": _BSD,
    "BSD-2-Clause": f"{_BSD}: 1. {_BSD_2} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD}: 1. {_BSD_2} 3. {_BSD_3} {_BSD_END}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
}


def shingled(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``s``: the hashes of all shingles of the text in order (through explode, to be computed once)."""
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), "")
    rows = rows.withColumn("w", F.explode(F.array(words)))
    starts = F.sequence(F.lit(0), F.size("w") - SHINGLE)
    each = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(SHINGLE))))
    return rows.where(F.size("w") >= SHINGLE).withColumn("s", F.explode(F.array(each))).drop("w")


def _bands(shingles: Column) -> Column:
    """(band, value): the least hash of the set under each band's seed."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(F.lit(k), x)))

    return F.array(*(F.struct(F.lit(k).alias("band"), least(k).alias("value")) for k in range(BANDS)))


def templates(spark: SparkSession, texts: dict[str, str] | DataFrame) -> DataFrame:
    """(license, t, n, width): distinct shingles, their number and the class of each template; stored."""
    if isinstance(texts, dict):
        texts = spark.createDataFrame(sorted(texts.items()), "license string, text string")
    rows = shingled(texts.select("license", "text"), "text").select("license", F.array_distinct("s").alias("t"))
    rows = rows.select("license", "t", F.size("t").alias("n"), F.expr("cast(power(2, ceil(log2(2 * size(t)))) as int)").alias("width"))
    return common.stored(spark, rows, "templates")


def relatives(known: DataFrame) -> DataFrame:
    """(license, other): the one may be found where only the other stands."""
    each = known.select("license", "n", F.explode("t").alias("x"))
    both = each.join(each.select(F.col("license").alias("other"), "x"), "x").where("license <> other")
    return both.groupBy("license", "other", "n").agg(F.count("*").alias("m")).where(F.col("m") >= SHARE * F.col("n")).select("license", "other")


def licenses(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, texts: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """(id, license, start, matched, shingles): each licence found, at its best and then first window.

    ``texts`` are templates by name, or a table (license, text) with unlike names.
    """
    known = templates(spark, texts)
    widths = [r["width"] for r in known.select("width").distinct().orderBy("width").collect()]  # powers of two
    schema = "id long, license string, start long, matched long, shingles long"
    if not widths:
        return spark.createDataFrame([], schema)
    # A text's rows of one id have one key; should other rows share it, they share hits, which only adds windows.
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = shingled(docs.withColumn("key", F.xxhash64("id", "text")), "text").select("id", "key", "s")
    hits = rows.select("key", F.posexplode("s").alias("at", "x")).join(known.select(F.explode("t").alias("x")).distinct(), "x", "left_semi")
    hits = common.stored(spark, hits.groupBy("key").agg(F.collect_set("at").alias("hits")), "hits")
    rows = rows.join(hits, "key")

    def of(width: int) -> Column:
        half = width // 2
        last = F.floor(F.greatest(F.lit(0), F.size("s") - half - 1) / half).cast("int")  # the last window that adds shingles
        own = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.array(F.floor(h / half).cast("int"), F.floor(h / half).cast("int") - 1))))
        own = F.filter(own, lambda k: (k >= 0) & (k <= last))
        return F.transform(own, lambda k: F.struct(F.lit(width).alias("width"), (k * half).alias("start"), F.array_distinct(F.slice("s", k * half + 1, width)).alias("x")))

    windows = rows.select("id", "key", F.explode(F.concat(*map(of, widths))).alias("v")).select("id", "key", "v.*")
    banded = windows.select("id", "key", "width", "start", F.explode(_bands(F.col("x"))).alias("b"), "x").select("id", "key", "width", "start", "x", "b.*")
    asked = known.select("license", "width", "n", "t", F.explode(_bands(F.col("t"))).alias("b")).select("license", "width", "n", "t", "b.*")
    found = banded.join(asked, ["width", "band", "value"])
    found = found.select("id", "key", "license", "start", "width", F.size(F.array_intersect("x", "t")).alias("matched"), "n")
    found = found.where(F.col("matched") >= F.col("n") * F.lit(SHARE))
    top = found.groupBy("id", "key", "license", "n", "width").agg(F.max(F.struct("matched", (-F.col("start")).alias("back"))).alias("top"))
    top = common.stored(spark, top.select("id", "key", "license", "n", "width", "top.*"), "licences")
    a, b = top.join(relatives(known), "license").alias("a"), top.alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.other") == F.col("b.license"))
    near = F.abs(F.col("a.back") - F.col("b.back")) < F.greatest("a.width", "b.width")
    more = (F.col("b.matched") > F.col("a.matched")) | ((F.col("b.matched") == F.col("a.matched")) & (F.col("b.n") < F.col("a.n")))
    worse = a.join(b, same & near & more).select(F.col("a.id").alias("_id"), F.col("a.key").alias("_key"), F.col("a.license").alias("_license"))
    kept = top.join(worse, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("license") == F.col("_license")), "left_anti")
    one = kept.groupBy("id", "license").agg(F.max(F.struct("matched", "back", "n")).alias("one"))
    return one.select("id", "license", (-F.col("one.back")).cast("long").alias("start"), F.col("one.matched").cast("long").alias("matched"), F.col("one.n").cast("long").alias("shingles"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in ``documents``: a row per document and licence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licenses(spark, docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
SQL = {
    "op5_licenses": f"""
WITH tw AS (SELECT license, {_WORDS} AS w FROM (VALUES {_VALUES}) v(license, text)),
t AS (SELECT license, list_distinct(list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS t FROM tw),
k AS (SELECT license, t, len(t) AS n, CAST(power(2, ceil(log2(2 * len(t)))) AS BIGINT) AS width FROM t),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS s FROM dw WHERE len(w) >= 3),
x AS (SELECT doc_id, license, j * (width // 2) AS start, n, len(list_intersect(list_distinct(s[j * (width // 2) + 1 : j * (width // 2) + width]), t)) AS m
  FROM d, k, unnest(range(0, 1 + greatest(0, len(s) - width // 2 - 1) // (width // 2))) u(j)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY m DESC, start) AS o FROM x WHERE m >= n * {SHARE}),
o AS (SELECT r.*, width, t FROM r JOIN k USING (license) WHERE o = 1)
SELECT doc_id, license, CAST(start AS BIGINT) AS start, CAST(m AS BIGINT) AS matched, CAST(n AS BIGINT) AS shingles FROM o a
WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND b.license <> a.license AND len(list_intersect(a.t, b.t)) >= {SHARE} * a.n AND abs(a.start - b.start) < greatest(a.width, b.width) AND (b.m > a.m OR b.m = a.m AND b.n < a.n))""",
}
