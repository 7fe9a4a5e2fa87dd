"""The training-data operators against brute force on small tables with hard cases."""

import base64
import hashlib
import itertools
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import common, decontaminate, fingerprint, jaccard, licenses, packing, quality, substring, tokens, toxicity, warc, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(n)]


WORDS = vocabulary(4000, 0)


def passage(n, seed):
    rng = np.random.default_rng(seed)
    return [WORDS[k] for k in rng.integers(0, len(WORDS), n)]


def hard_texts():
    """(id, text): nulls, empty and short texts, copies, near copies, shared passages, repeated rows, a long text."""
    base, shared = passage(120, 1), passage(30, 2)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, " ".join(shared)), (8, "x  " + " ".join(shared) + "\n y")]
    for k in range(6):
        near = list(base)
        near[10 * k + 3] = f"changed{k}"
        rows.append((10 + k, " ".join(near)))
        rows.append((30 + k, " ".join(passage(60, 50 + k) + shared + passage(20, 90 + k))))
    rows += [(50, " ".join(passage(9000, 7))), (51, "\x1c a b Été ſΣ"), (60, "same row twice " * 9), (60, "same row twice " * 9), (None, "no id at all in this row")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in hard_texts()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split_words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 3_000_000), (6, "u", "<p>other</p>"), (7, "u", "<p>same</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_warc(spark, warc.records(table, "page_id", "url", "html"), common.new_path(spark, "warc"))
    rows = warc.read_warc(spark, manifest, 1 << 20).collect()
    for page, url, html in pages:
        chunks = sorted((r for r in rows if r["id"] == page), key=lambda r: r["chunk_no"])
        first = min(p for p, _, h in pages if (h or "") == (html or ""))
        data = (html or "").encode()
        assert chunks[-1]["last"] and [c["chunk_no"] for c in chunks] == list(range(len(chunks)))
        assert chunks[-1]["digest_so_far"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert chunks[0]["declared_bytes"] == len(data) and chunks[0]["target_uri"] == url
        if page == first:
            assert chunks[0]["record_type"] == "response" and b"".join(c["data"] for c in chunks) == data
            done = 0
            for c in chunks:  # the digest of what came so far
                done += len(c["data"])
                assert c["digest_so_far"] == base64.b32encode(hashlib.sha1(data[:done]).digest()).decode() and len(c["data"]) <= 1 << 20
        else:
            assert chunks[0]["record_type"] == "revisit" and chunks[0]["refers_to"] == first
    assert warc.write_warc(spark, warc.records(table.limit(0), "page_id", "url", "html"), common.new_path(spark, "warc")).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(parent, 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in parent}


def test_jaccard(spark, docs, none):
    rows = jaccard.near_duplicates(spark, docs, "doc_id", "text").collect()
    right = brute_components(hard_texts())
    assert len(rows) == len(hard_texts())
    assert {r["id"]: r["component"] for r in rows if r["id"] is not None} == right
    assert [r["component"] for r in rows if r["id"] is None] == [None]
    assert jaccard.near_duplicates(spark, none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 4, 5, 7, 9, 15, 16, 17, 30, 64, 127, 128, 300, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        far = len(a) // 3
        gone = int(rng.integers(0, far + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, far - gone).astype(np.uint64) * np.uint64(2)]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= either - both
        if 100 * both >= 75 * either:
            for frequent in (a[:0], a[::2], np.union1d(a, b), np.sort(rng.permutation(a)[: n // 5])):
                assert len(np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent)))


def brute_removed(rows, size=20):
    keyed = sorted({(i if i is not None else -(1 << 63), t) for i, t in rows}, key=lambda r: r[0])
    first, gone = {}, {}
    for i, t in keyed:
        words = split_words(t)
        for k in range(len(words) - size + 1):
            first.setdefault(tuple(words[k : k + size]), (i, k))
    for i, t in keyed:
        words = split_words(t)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] != (i, k):
                gone.setdefault(i, set()).update(range(k, k + size))
    return {i: [w for k, w in enumerate(split_words(t)) if k not in gone.get(i, ())] for i, t in keyed}


def test_substring(spark, docs, none):
    right = brute_removed(hard_texts())
    for r in substring.remove_repeats(spark, docs, "doc_id", "text").collect():
        kept = right[r["doc_id"] if r["doc_id"] is not None else -(1 << 63)]
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert r["n_words"] - r["n_removed"] == len(kept)
    assert substring.remove_repeats(spark, none, "doc_id", "text").count() == 0


ODD_TEXTS = ["", "a b\nc", "a  b", "it's Ok", "x \n y", "\n\nab", "éé a b", " lead", "trail ", "a\n\nb", "<|endoftext|> x", "I'm\nwe'll 's", "a\x00b", "12 34a", "\t tab wide", "\x1cfs\x1d", "ΑΣ ΟΔΟΣ", "İstanbul", "日本語 テスト", "😀 emoji"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, library = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in ODD_TEXTS + [t for _, t in hard_texts() if t]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_random_texts_equal_the_library(name):
    """Batches of texts made of odd parts, special tokens' strings, wide spaces and quotes among them."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, library, rng = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name)), np.random.default_rng(3)
    parts = ["a", "b", "\u00c9", "e\u0301", "\u03a3", "\u017f", " ", "  ", "\n", "\r\n", "\t", "\x00", "\x01", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u180e", "\u200b", "'s", "'", "'re", "'T", "1", "22", "!", "?!", "<|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u65e5", "\U0001f642", "\u0130", "\u212a", "\ufeff", "\u00b2"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(5000)]
    ids, lengths = own.batch(pa.array([*texts, None]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [*(x.ids for x in library.encode_batch(texts, add_special_tokens=False)), []]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_memory_is_bounded_in_bytes(name):
    """Ever new and long chunks, more than fit, and some that come again: never more than two generations are held."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    bound, rng = 1 << 18, np.random.default_rng(4)
    own, library = tokens.Encoder(public_tokenizers.path(name), bound), Tokenizer.from_file(public_tokenizers.path(name))
    again = [" ".join(passage(40, k)) for k in range(20)]
    for wide in (8, 200, 20_000, bound):
        for _ in range(4):
            texts = again + [" ".join("".join(rng.choice(list("abc"), wide)) for _ in range(3)) for _ in range(max(1, min(200, bound // wide)))]
            ids, lengths = own.batch(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
            assert sum(sys.getsizeof(chunk) + sys.getsizeof(ids) for kept in (own.young, own.old) for chunk, ids in kept.items()) <= 2 * bound


def test_tokens_of_words_before_signs():
    """Words of letters that are all ASCII or not, before every sign: ids as the library's, and a word goes to it once."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library, sent = tokens.Encoder(path), Tokenizer.from_file(path), []
    learn = own._learn
    own._learn = lambda chunks: sent.extend(chunks) or learn(chunks)
    words = ["word", "Zeit5", "caf\u00e9", "\u00ff", "\u00d7", "a\u00f7", "\u024f", "\u0416\u047f", "\u0482", "\u65e5", "\u2026", "it's", "x\u00b7"]
    signs = [chr(x) for x in range(33, 127) if not chr(x).isalnum()]
    texts = [f"{w}{s}{t} {w}{s}\n{w}{s}{w}'s{s}" for w in words for s in signs for t in ("", "!", "'", "'ll", "\u2026")]
    ids, lengths = own.batch(pa.array(texts).slice(1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x.ids for x in library.encode_batch(texts[1:], add_special_tokens=False)]
    sent.clear()
    own.batch(pa.array([f" sentence{k}{s}" for k in range(50) for s in ",.;:!?"]))
    assert sum("sentence" in c for c in sent) == 50


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (511, 3), (512, 70_000), (5000, 50_257)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.array([4]), np.array([False]), np.array([0])))
    assert np.array_equal(m.decode(), ids)
    at = np.arange(0, n, max(1, n // 50))
    assert np.array_equal(m.access(at), ids[at])
    for token in {*ids[:5].tolist(), top + 1}:
        where = np.flatnonzero(ids == token)
        assert m.ranks(token, at).tolist() == [int((ids[:k] == token).sum()) for k in at] and m.count(token) == len(where) and m.rank(token, n // 2) == int((ids[: n // 2] == token).sum())
        assert [m.select(token, k) for k in range(min(4, len(where)))] == where[:4].tolist() and m.select(token, len(where)) == -1


def encoded(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_shards(spark, docs, none):
    import public_tokenizers

    run = lambda d: wavelet.read_documents(spark, wavelet.write_shards(spark, d, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), common.new_path(spark, "w"))).collect()
    encode, start, right = encoded("byte_bpe_50k.json"), 0, []
    for i, t in sorted(hard_texts(), key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        ids = encode(t)
        right.append((i, start, len(ids), crc(ids), ids.count(2)))
        start += len(ids)
    assert sorted(map(tuple, run(docs)), key=lambda r: r[1]) == right
    assert run(none) == []
    # Unlike texts of one id, null ids and the least id have one order, however the rows are dealt.
    rows = [(7, f"text {k}") for k in range(30)] + [(None, "x"), (None, "y z"), (-(1 << 63), "least"), (7, None), (8, "<|endoftext|> " * 3)]
    tied = [sorted(map(tuple, run(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))), key=lambda r: r[1]) for n in (1, 5)]
    assert tied[0] == tied[1] and [r[0] for r in tied[0]] == [None, None, -(1 << 63), *[7] * 31, 8]


def test_packing(spark, docs, none):
    rows = packing.packed(spark, docs.where("doc_id is null or doc_id <> 60")).collect()
    encode = encoded("word_bpe_49k.json")
    for i, t in hard_texts():
        if i != 60:
            ids = encode(t)
            own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
            assert [r["start"] for r in own] == [*itertools.accumulate((r["length"] for r in own), initial=0)][:-1]
            assert sum(r["length"] for r in own) == len(ids) and all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
    for _, window in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in window:
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert packing.packed(spark, none).count() == 0


def test_packing_of_equal_rows(spark):
    """Equal rows are documents of their own and need not share a shard."""
    rows = packing.packed(spark, spark.createDataFrame([(1, "same words"), (None, "")], "doc_id long, text string").join(spark.range(500).select(F.col("id").alias("k")))).collect()
    assert len(rows) == 1000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 1000


def test_best_fit_is_the_tightest():
    rng, tree, free = np.random.default_rng(0), packing.BestFit(100), []
    for length in sorted(rng.integers(1, 101, 400).tolist(), reverse=True):
        fits = [r for r in free if r >= length]
        window, offset = tree.place(length)
        if window == len(free):
            assert not fits
            free.append(100)
        else:
            assert free[window] == min(fits)
        assert offset == 100 - free[window]
        free[window] -= length


def test_fingerprints(spark, docs, none):
    pairs = [(i, t or "") for i, t in hard_texts() if i != 60]
    order = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(spark, docs.where("doc_id is null or doc_id <> 60"), "doc_id", "text").collect()}
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert found[i]["n_chars"] == len(t) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["near_edited"] == float(found[i]["fingerprint"] == found[i]["edited_fingerprint"])
    assert found[1]["fingerprint"] == found[2]["fingerprint"] != found[10]["fingerprint"] and found[5]["fingerprint"] == found[6]["fingerprint"]
    assert fingerprint.fingerprints(spark, none, "doc_id", "text").count() == 0
    folded = spark.createDataFrame([(1, "Café  X\n"), (2, "cafÉ x"), (3, "cafe x")], "doc_id long, text string")
    a, b, c = (r["fingerprint"] for r in fingerprint.fingerprints(spark, folded, "doc_id", "text").orderBy("doc_id").collect())
    assert a == b != c


def test_fingerprints_of_ties(spark):
    """Unlike texts of one id have one order, however the rows are dealt; near_next by the next text itself."""
    rows = [(5, t) for t in ("A", "a ", " a", "b", "A", "caf\u00e9")] + [(4, "x"), (6, "X"), (None, "y"), (None, "Y ")]
    found = [sorted(map(repr, map(tuple, fingerprint.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(n), "doc_id", "text").collect()))) for n in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    pair = spark.createDataFrame([(3, "Same  text"), (2, "same TEXT"), (1, "other")], "doc_id long, text string")
    assert {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprints(spark, pair, "doc_id", "text").collect()} == {3: 1.0, 2: 0.0, 1: 0.0}


def test_fingerprint_bucket_of_different_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "hashes", lambda canon: F.struct(F.length(canon).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    rows = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc")], "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark, rows, "doc_id", "text").collect()}
    assert found[1] == found[3] != found[2] and len(set(found.values())) == 3


@pytest.mark.parametrize("seed", range(4))
def test_joining_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for k in range(80):
        own = np.concatenate([rng.permutation(base)[: rng.integers(30, 61)], rng.integers(0, 1 << 62, rng.integers(0, 25)).astype(np.uint64)])
        sets.append(np.unique(own))
    groups = rng.integers(0, 60, 80)
    linked = [(a, b) for a, b in itertools.combinations(range(80), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]

    def joined(links):
        least = {int(g): int(g) for g in groups}
        for _ in least:
            for a, b in links:
                least[int(groups[a])] = least[int(groups[b])] = min(least[int(groups[a])], least[int(groups[b])])
        return least

    found = jaccard.joining(np.arange(80), groups, sets)
    assert set(map(tuple, map(sorted, found))) <= set(linked) and joined(found) == joined(linked)


@pytest.mark.parametrize("met", [2_048, 2])
def test_jaccard_of_a_large_hub_in_blocks(spark, monkeypatch, met):
    """Near copies of one text and texts that share a long passage with it, with blocks of a few sets, and where the
    members of a hub are too many to compare their sketches."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(jaccard, "MET", met)
    rng, base, rows = np.random.default_rng(2), passage(60, 900), []
    for k in range(150):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            words[at] = f"v{k}x{at}"
        rows.append((k, " ".join(words[: int(rng.integers(45, 61))] + passage(int(rng.integers(0, 12)), 1000 + k))))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["id"]: r["component"] for r in jaccard.near_duplicates(spark, table, "doc_id", "text").collect()}
    assert found == brute_components(rows) and len(set(found.values())) > 3


@pytest.mark.parametrize("seed", range(10))
def test_partners_keep_every_linked_set(seed):
    """Sets of very different sizes, one of more shingles in a cell than a byte counts, against all pairs."""
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    bases, sets = [draw(n) for n in (1, 4, 30, 300, 700)], []
    for _ in range(60):
        base = bases[int(rng.integers(0, 5))]
        sets.append(np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, len(base) // 4 + 1)) :], draw(int(rng.integers(0, len(base) // 4 + 1)))])))
    crowd = np.unique(rng.integers(0, 1 << 40, 3_000).astype(np.uint64))
    sets += [draw(120), crowd, crowd[200:]]
    groups, sizes = rng.integers(0, 6, len(sets)), np.array([len(s) for s in sets])
    groups[-2:] = 7, 8
    stay = jaccard.partners(groups, sizes, [jaccard.sketch(s) for s in sets])
    linked = [any(g != h and 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)) for h, y in zip(groups, sets)) for g, x in zip(groups, sets)]
    assert all(stay[linked]) and any(linked) and stay[-2:].all() and not stay[-3]
    alone = jaccard.partners(np.zeros(len(sets), int), sizes, [jaccard.sketch(s) for s in sets])
    assert not alone.any()


def test_jaccard_of_the_least_id_and_null_ids(spark):
    least, text = -(1 << 63), " ".join(passage(30, 77))
    table = spark.createDataFrame([(least, text), (4, text), (None, text), (None, None), (5, None)], "doc_id long, text string")
    found = sorted(map(tuple, jaccard.near_duplicates(spark, table, "doc_id", "text").collect()), key=repr)
    assert found == sorted([(least, 26, least), (4, 26, least), (None, 26, None), (None, 0, None), (5, 0, 5)], key=repr)


def test_clashing_columns(spark):
    """Other columns of the names that the operators use inside are carried along; those of added columns are not."""
    text = " ".join(passage(40, 31))
    table = spark.createDataFrame([(1, text, 11, 12, 13, 14, 15, 16), (2, text, 21, 22, 23, 24, 25, 26)], "doc_id long, text string, _first int, _ID int, _tie int, N_Words int, Score int, bucket int")
    found = {r["doc_id"]: r.asDict() for r in substring.remove_repeats(spark, table, "doc_id", "text").collect()}
    assert (found[2]["n_words"], found[2]["n_removed"], found[1]["n_removed"]) == (40, 40, 0)
    assert [found[2][c] for c in ("_first", "_ID", "_tie", "Score", "bucket")] == [21, 22, 23, 25, 26] and "N_Words" not in found[2]
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(spark, table, marks).collect()
    assert [c for c in found[0].asDict() if c.lower() == "score"] == ["score"] and {r["_first"] for r in found} == {11, 21}
    assert jaccard.near_duplicates(spark, table, "doc_id", "text").count() == 2
    assert {r["doc_id"] for r in packing.packed(spark, table).collect()} == {1, 2}
    assert fingerprint.fingerprints(spark, table, "doc_id", "text").count() == 2
    assert licenses.licenses(spark, table, "doc_id", "text").count() == 0


def test_repeated_rows_mark_once(spark):
    """Many equal rows of one id after an earlier copy give each place of a mark once."""
    text = " ".join(passage(100, 55))
    table = spark.createDataFrame([(1, text), *[(2, text)] * 200, *[(None, text + f" {k}") for k in range(3)]], "doc_id long, text string").repartition(5)
    rows = substring.remove_repeats(spark, table, "doc_id", "text").collect()
    right = brute_removed([(2, text), (1, text)])
    assert {r["n_removed"] for r in rows if r["doc_id"] == 2} == {100} and len(rows) == 204 and right[2] == []


def test_lexicon_against_a_plain_matcher():
    """Every entry at every place, the largest weight of each word, none inside an exception phrase."""
    rng, letters = np.random.default_rng(8), list("ab")
    word = lambda n: "".join(rng.choice(letters, n))
    for _ in range(200):
        entries = {f" {word(rng.integers(1, 4))}" + (" " if rng.integers(0, 2) else ""): float(rng.integers(1, 9)) for _ in range(6)}
        phrases = tuple(f"{word(2)} {word(rng.integers(1, 3))}" for _ in range(2))
        words = [word(rng.integers(1, 4)) for _ in range(rng.integers(0, 12))]
        text, total = f" {' '.join(words)} ", 0.0
        spared = [(k, k + len(p) + 1) for p in phrases for k in range(len(text)) if text.startswith(f" {p} ", k)]
        for k in range(len(text)):
            found = [w for e, w in entries.items() if text.startswith(e, k)]
            if words and found and not any(a <= k < b for a, b in spared):
                total += max(found)
        lexicon = toxicity.Lexicon(entries, phrases)
        assert lexicon.total(words) == total and abs(lexicon.density(" ".join(words)) - 100 * total / (len(words) + toxicity.SHORT)) < 1e-9


def test_jaccard_of_ids_with_several_texts(spark):
    one, two, three, four = (passage(60, 700 + k) for k in range(4))
    near = lambda words, at: [("swapped" if k == at else w) for k, w in enumerate(words)]
    # 10 joins 5 and 7; 21 and 20 share a text, and 21 is near 22 by another; 31 has an empty text beside that of 30.
    rows = [(10, one), (5, one), (10, two), (7, two), (20, three), (21, three), (21, four), (22, near(four, 30)), (31, near(one[:40], 0)), (30, near(one[:40], 0)), (31, []), (40, []), (40, passage(9, 3))]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    found = {(r["id"], r["component"]) for r in jaccard.near_duplicates(spark, table, "doc_id", "text").collect()}
    assert found == {(5, 5), (7, 5), (10, 5), (20, 20), (21, 20), (22, 20), (30, 30), (31, 30), (40, 40)}


def test_jaccard_of_random_ids(spark):
    """Ids drawn anew for texts with near copies, against components over all pairs of rows."""
    rng = np.random.default_rng(11)
    bases = [passage(50, 800 + k) for k in range(6)]
    rows = []
    for k in range(60):
        words = list(bases[int(rng.integers(0, 6))])
        for at in rng.choice(50, int(rng.integers(0, 4)), replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((int(rng.integers(0, 45)), words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    least = {i: i for i, _ in rows}
    for _ in rows:
        for (i, _), x in zip(rows, sets):
            for (j, _), y in zip(rows, sets):
                if 100 * len(x & y) >= 75 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    assert {(r["id"], r["component"]) for r in jaccard.near_duplicates(spark, table, "doc_id", "text").collect()} == set(least.items())


def test_decontamination(spark, none):
    item = passage(40, 200)
    swapped = [("other" if k % 6 == 5 else w) for k, w in enumerate(item)]
    texts = [(1, " ".join(passage(50, 201) + item + passage(50, 202))), (2, " ".join(passage(10, 203) + swapped)), (3, " ".join(passage(300, 204))), (4, None), (5, ""), (6, " ".join(item[10:35]).upper()), (7, " ".join(item[:8] + passage(60, 205))), (None, " ".join(item))]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (8, "too short"), (7, None), (6, "")], "item_id long, text string")
    run = lambda d, q: {(r["id"], r["item"]) for r in decontaminate.contaminated(spark, d, q, "doc_id", "text", "item_id", "text").collect()}
    assert run(table, items) == {(1, 9), (2, 9), (6, 9), (None, 9)}
    assert run(table, items.limit(0)) == set() and run(none, items) == set()


def test_decontamination_masks():
    for length in range(1, decontaminate.WINDOW + 1):
        assert decontaminate.missed(length, decontaminate.masks_for(length)) == 0
    assert decontaminate.missed(20, decontaminate.SQL_MASKS) == 368 and decontaminate.missed(15, decontaminate.SQL_MASKS) == 146


def test_decontamination_against_all_diagonals(spark):
    """Substitutions at the tolerance and one beyond it, in items of 1 to 24 words, against all diagonals without seeds."""
    rng = np.random.default_rng(5)
    items = [(n, passage(n, 300 + n)) for n in range(1, 25)]
    docs = []
    for n, item in items:
        size = min(decontaminate.WINDOW, n)
        for k in range(12):
            start, copy = int(rng.integers(0, n - size + 1)), [f"o{j}" for j in range(n)]
            wrong = rng.choice(size, size // 5 + (k % 4 == 3), replace=False)
            copy[start : start + size] = [("other" if j in wrong else w) for j, w in enumerate(item[start : start + size])]
            docs.append((1000 * n + k, passage(k % 3, n + k) + copy + passage(k % 2, n * k)))
    # The substitutions that seeds of spread words miss: 15 words in runs of three.
    docs.append((1, ["other" if j in (3, 7, 11) else w for j, w in enumerate(items[14][1])]))
    expected = set()
    for i, d in docs:
        for item, q in items:
            size, best = min(decontaminate.WINDOW, len(q)), None
            for shift in range(-len(q), len(d)):
                for at in range(max(0, -shift), min(len(q), len(d) - shift) - size + 1):
                    matched = sum(q[j] == d[j + shift] for j in range(at, at + size))
                    if 5 * matched >= 4 * size and (best is None or (-matched, at + shift) < best):
                        best = (-matched, at + shift)
            if best:
                expected.add((i, item, best[1], -best[0], size))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.contaminated(spark, table, asked, "doc_id", "text", "item_id", "text").collect()} == expected


def test_licenses_of_relatives(spark):
    """A notice that nearly holds another is reported alone; both are where both stand."""
    by, sa, more = licenses.TEMPLATES["CC-BY-4.0"], licenses.TEMPLATES["CC-BY-SA-4.0"], " ".join(passage(200, 66))
    table = spark.createDataFrame([(1, f"{more} {sa}. {more}"), (2, by), (3, f"{sa} {more} {by}"), (4, more)], "doc_id long, text string")
    found = {(r["id"], r["license"]) for r in licenses.licenses(spark, table, "doc_id", "text").collect()}
    assert found == {(1, "CC-BY-SA-4.0"), (2, "CC-BY-4.0"), (3, "CC-BY-4.0"), (3, "CC-BY-SA-4.0")}


def test_licenses(spark, none):
    mit, long = licenses.TEMPLATES["MIT"], " ".join(passage(20_000, 4))
    texts = [(1, " ".join(passage(40, 1)) + " " + mit + " " + " ".join(passage(77, 2))), (2, "Released under the MIT License."), (3, "released under the mit"), (4, None), (5, ""), (6, " ".join(passage(300, 3))), (None, "x LICENSED UNDER the apache license version 2.0 y"), (7, f"{long} {mit} {long}")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    run = lambda d: {(r["id"], r["license"]) for r in licenses.licenses(spark, d, "doc_id", "text").collect()}
    assert run(table) == {(1, "MIT"), (2, "MIT-line"), (None, "Apache-2.0-line"), (7, "MIT")}
    assert run(none) == set()
    assert licenses.licenses(spark, table, "doc_id", "text", {}).count() == 0


GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


def test_licenses_of_versions(spark):
    """Each version of a notice, and a licence that holds another one, is named as itself alone."""
    bsd = licenses.TEMPLATES["BSD-3-Clause"].replace("copyright holder nor", "Example Institute nor")
    right = {
        "GPL-2.0": GNU.format("program", ";", "General Public License", ";", "2"),
        "GPL-3.0": GNU.format("program", ":", "General Public License", ",", "3"),
        "LGPL-2.1": GNU.format("library", ";", "Lesser General Public License", ";", "2.1"),
        "LGPL-3.0": GNU.format("library", ":", "Lesser General Public License", ",", "3"),
        "AGPL-3.0": GNU.format("program", ":", "Affero General Public License", ",", "3"),
        "BSD-2-Clause": licenses.TEMPLATES["BSD-2-Clause"],
        "BSD-3-Clause": bsd,
        "MIT": licenses.TEMPLATES["MIT"],
        "MIT-grant": licenses.TEMPLATES["MIT-grant"],
    }
    more = " ".join(passage(150, 67))
    rows = [(k, f"{more} {text} {more}") for k, text in enumerate(right.values())]
    found = {(r["id"], r["license"]) for r in licenses.licenses(spark, spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert found == set(enumerate(right))


def test_licenses_by_row(spark):
    """Relatives are judged in one text: those of other rows of the id, or of none, stay; equal rows count once; templates may be a table."""
    two, three = licenses.TEMPLATES["GPL-2.0"], licenses.TEMPLATES["GPL-3.0"]
    rows = [(k, text, 1, "b") for k in (1, None) for text in (two, three, three)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key int, license string")
    names = spark.createDataFrame(sorted(licenses.TEMPLATES.items()), "license string, text string")
    for texts in (licenses.TEMPLATES, names):
        found = [tuple(r) for r in licenses.licenses(spark, table, "doc_id", "text", texts).select("id", "license").collect()]
        assert len(found) == 4 and set(found) == {(k, x) for k in (1, None) for x in ("GPL-2.0", "GPL-3.0")}


def test_folding_and_exceptions():
    assert toxicity.folded("Y0u 1D10T, ѕtυріd! café") == ["you", "idiot", "stupid", "cafe"]
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tras": 1.0, " idiot ": 3.0})
    assert lexicon.total(toxicity.folded("idiot idiot")) == 6.0
    assert lexicon.total(toxicity.folded("the trash can")) == 0.0
    assert lexicon.total(toxicity.folded("you trash")) == 2.0 and lexicon.density(None) == 0.0


def test_toxicity_learns(spark, none):
    rng = np.random.default_rng(0)
    bad = ["grumbol", "snarvek", "plodrix"]
    rows, labels = [], []
    for k in range(300):
        words, toxic = passage(int(rng.integers(20, 200)), 1000 + k), k % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(0, len(words))), bad[int(rng.integers(0, 3))])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, None), (901, ""), (None, "plodrix " * 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark, table, marks).collect()}
    assert all(0 <= s <= 1 for s in found.values())
    assert np.mean([(found[k] >= 0.5) == bool(t) for k, t in labels]) > 0.97
    assert found[900] == found[901] < 0.5 < found[None]
    assert toxicity.toxicity(spark, none, marks.limit(0)).count() == 0


def test_quality_held_out(spark, none):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(spark, base, labels).join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0)], DOCS)
    assert [r["score"] for r in quality.quality(spark, odd, labels.limit(0)).collect()] == [0.5, 0.5]
    assert quality.quality(spark, none, labels).count() == 0


def test_quality_learns_from_all_unlabelled(spark):
    """Scores as by co-training in memory on 8,000 unlabelled rows, more than any sample of 6,000 holds."""
    rng = np.random.default_rng(3)
    kinds = rng.random(9000) < 0.5
    texts = [" ".join(passage(int(rng.integers(3, 9)), k)) + ("." if good else " !!! $$ 77") for k, good in enumerate(kinds)]
    data = [(k, t, "en", f"src{int(good)}{k % 3}", len(t)) for k, (t, good) in enumerate(zip(texts, kinds))]
    flips = rng.random(9000) < 0.1
    labels = spark.createDataFrame([(k, int(kinds[k] ^ flips[k])) for k in range(1000)], "doc_id long, quality int")
    apart = {r["id"] for r in spark.range(9000).where(toxicity.held_out("id")).collect()}
    order = {r["id"]: r["h"] for r in spark.range(9000).select("id", F.xxhash64("id").alias("h")).collect()}
    seen = [np.float32([quality.text_view(r[1]) for r in data]).astype(float), np.float32([quality.meta_view(r[3], r[2], r[4], r[1]) for r in data]).astype(float)]
    learned = [k for k in range(1000) if k not in apart]
    free = {k for k in range(1000, 9000) if k not in apart}
    assert len(free) > 6000

    def surest(weights, many):
        out = []
        for k in (0, 1):
            for label, n in many.items():
                p = quality.proba(seen[k], weights[k])
                p = p if label else 1 - p
                best = sorted((j for j in free if p[j] >= quality.SURE), key=lambda j: (-round(p[j], 12), order[j]))[:n]
                free.difference_update(best)
                out.append((k, label, seen[1 - k][best]))
        return out

    model = quality.co_train([v[learned] for v in seen], np.array([float(kinds[k] ^ flips[k]) for k in learned]), surest)
    z = [quality._logit(quality.proba(np.stack([quality._logit(quality.proba(v, model[n])), np.ones(9000)], axis=1), model[f"{n}_scale"])) for v, n in zip(seen, ("text", "meta"))]
    expected = quality.proba(np.stack([*z, np.ones(9000)], axis=1), model["both"])
    found = {r["doc_id"]: r["score"] for r in quality.quality(spark, spark.createDataFrame(data, DOCS).repartition(5), labels).collect()}
    assert len(found) == 9000 and np.abs(np.array([found[k] for k in range(9000)]) - expected).max() < 1e-5


@pytest.mark.parametrize("seed", range(3))
def test_met_signatures_in_little_memory(seed):
    """A bucket's members against plain sets, and the memory that a signature takes there."""
    import pyarrow as pa

    rng, n, sent, owners = np.random.default_rng(seed), 20_000, [], {}
    for k in range(30):
        sign = np.unique(rng.integers(0, 1 << 48, n, np.uint64))
        sign[:40] = np.sort(rng.choice(np.arange(60, dtype=np.uint64), 40, replace=False))
        sign = np.sort(sign)
        local = rng.integers(0, 50, len(sign)).astype(np.uint32)
        least = np.arange(50 * k, 50 * k + 50) * 7
        sent.append((0, 1, len(sign), jaccard.squeeze(np.diff(sign, prepend=np.uint64(0)), local), 50, jaccard.squeeze(least, least.astype(np.uint64))))
        for s, o in zip(sign[:40].tolist(), least[local[:40]].tolist()):
            owners.setdefault(s, set()).add(o)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*sent), kinds)], names=["bucket", "kind", "n", "blob", "m", "who"])
    tracemalloc.start()
    found = jaccard.met(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    right = {}
    for own in owners.values():
        for o in own - {min(own)}:
            right[min(own), o] = max(right.get((min(own), o), 0), len(own))
    assert {(r["a"], r["b"]): r["x"] for r in found.to_pylist()} == right
    assert peak < 64 * 30 * n


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in common.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
