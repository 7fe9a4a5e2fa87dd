"""Registered queries against their SQL, and the pipeline stage by stage."""

import re

import pytest

from stratum.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(name, agrees):
    agrees(queries.QUERIES[name], queries.SQL[name])


def test_pipeline(spark):
    import corpus_pipeline
    from stratum.llm import common, decontaminate, jaccard, substring

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(spark, stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept == {r["component"] for r in jaccard.near_duplicates(spark, before, "doc_id", "text").collect()}
        if name == "substring_dedup":
            assert substring.remove_repeats(spark, docs, "doc_id", "text").where("n_removed > 0").count() <= 5
        if name == "decontamination":
            assert decontaminate.of_tables(spark, docs, SMALL).count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4]
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_pipeline_of_repeated_rows_and_null_ids(spark):
    """Repeated rows go; rows without an id are judged each, not all alike."""
    import corpus_pipeline

    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, text(1), "en", "b", 9), (1, text(1), "en", "a", 9), (1, text(2), "en", "a", 9), (2, text(3), "en", "a", 9), (None, text(3), "en", "a", 9)]
    rows += [(None, text(4), "en", "a", 9), (None, text(4), "en", "a", 9), (None, text(5), "en", "a", 9), (None, None, "en", "a", 9), (None, item, "en", "a", 9), (3, item + " of 3", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    expected = [rows[k] for k in (1, 2, 3, 5, 7, 8)]
    assert [r for r in plain(kept) if item not in r] == sorted(map(repr, expected))
    assert plain(corpus_pipeline.benchmark(spark, docs, SMALL)) == sorted(map(repr, rows[:9]))


def plainly_contaminated(docs, items, window=20):
    """Ids of documents with an item, by the matches on every diagonal."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    gone, asked = set(), [words(t) for t in items if t]
    for i, text in docs.items():
        places = {}
        for at, w in enumerate(words(text or "")):
            places.setdefault(w, []).append(at)
        for q in asked:
            size, n = min(window, len(q)), len(words(text or ""))
            diagonals = {}
            for j, w in enumerate(q):
                for at in places.get(w, ()):
                    diagonals.setdefault(at - j, set()).add(j)
            for shift, same in diagonals.items():
                if size and 5 * len(same) >= 4 * size:
                    starts = range(max(0, -shift), min(len(q), n - shift) - size + 1)
                    if any(5 * sum(j in same for j in range(k, k + size)) >= 4 * size for k in starts):
                        gone.add(i)
    return gone


def test_pipeline_rows(spark):
    """Every stage's rows against plain Python: ids, all columns, texts after removal, pieces and their check sums."""
    import corpus_pipeline
    from stratum.llm import common, toxicity
    from test_operators import brute_components, brute_removed, crc, encoded, split_words

    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(corpus_pipeline.COLUMNS)
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark, docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    rows = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(spark, stage(spark, docs, SMALL), name)
        got = docs.collect()
        texts = {i: r[1] for i, r in rows.items()}
        if name == "packing":
            encode = encoded("word_bpe_49k.json")
            ids = {i: encode(t) for i, t in texts.items() if t}
            assert {r["doc_id"] for r in got} == {i for i, x in ids.items() if len(x)}
            for i, x in ids.items():
                own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
                assert [r["start"] + r["length"] for r in own] == [*[r["start"] for r in own[1:]], len(x)][: len(own)]
                assert all(r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) for r in own) and (not own or own[0]["start"] == 0)
            break
        found = {r["doc_id"]: tuple(r) for r in got}
        assert len(found) == len(got)
        if name == "toxicity":
            rows = {i: r for i, r in rows.items() if score[i] < 0.5}
        elif name == "near_duplicates":
            component = brute_components(texts.items())
            rows = {i: r for i, r in rows.items() if component[i] == i}
        elif name == "substring_dedup":
            right = brute_removed(texts.items())
            assert set(found) == set(rows)
            for i, r in rows.items():
                if right[i] == split_words(r[1]):
                    assert found[i] == r
                else:
                    assert split_words(found[i][1]) == right[i] and found[i][2:4] == r[2:4] and found[i][4] == len(found[i][1])
            rows = found
        elif name == "decontamination":
            gone = plainly_contaminated(texts, items)
            rows = {i: r for i, r in rows.items() if i not in gone}
        assert found == rows
