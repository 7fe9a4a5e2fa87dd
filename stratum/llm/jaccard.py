"""Exact n-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

A document's set is hashed shingles. Sizes fall into bands [2**b, 2**(b+1)); a set takes part in its own band and,
if it can be linked with a set there, in the next. In a band the domain is cut into first-level partitions of three
second-level ones each. Two linked sets of n shingles differ in at most k = n // 3 places, so of more than k / 2
first-level partitions one has at most one differing second-level partition: the two others agree. Hence each
first-level partition gives the three subsets of two second-level partitions as signatures, and linked sets share
one. Partitions are enumerated in order and only until enough of them are filled (two second-level partitions not
empty), so a shared signature is never one of empty partitions. A set that has too few filled partitions also gives
its rarest shingles, as many as it may lack and one more (rare ones by their hash, then frequent ones by their
frequency in a sample); of two linked sets of that kind one such shingle is common.

Equal sets are one class, of which the least id stands for all. The sets that share a signature are settled in two
rounds. First each signature's least member (its hub) is held against the others: candidates whose sizes, or whose
counts of shingles in cells of the domain, already differ by more than linked sets can are left out, and the rest are
verified on their whole sets. Then the members of a hub that the links found so far leave in different components
are settled together: one that by sizes and sketches can be linked with no member of another component leaves, as does
a set more than a quarter of whose shingles no other such set has, and the sets that stay of one hub meet in a task, which counts the shingles that a set outside the hub's largest
component shares with each other one and gives a link for each pair of components it joins. Pairs are never rows
there, and a large hub is cut into blocks of bounded size of which every two that need it meet. No bucket is capped.

Defined results: null and empty texts have no shingles and no links; rows of one id are one document with several
texts, linked where any of them are, and have one component (the SQL takes the union of their shingles); a null id has a null component and no links; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.hashing import Windows, expand, mixed, squeeze

WORDS = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle is frequent if so many of the sampled documents (one in SAMPLE) have it; at most so many are frequent.
SAMPLE, FREQUENT, MOST_FREQUENT = 32, 4, 500_000
#: Signatures that a task holds before it sends them on.
HELD = 1 << 20
#: Bytes of text whose signatures meet in a bucket; shingles whose counts meet in one; shingles of a block of a hub.
BUCKET_TEXT, BUCKET_SHINGLES, BLOCK_SHINGLES = 8 << 20, 2 << 20, 1 << 20
#: Members of a hub in a class of sizes whose sketches are compared with each other, and the bytes of these sketches;
#: with more of them all members stay. Bytes of sketches that meet in a bucket.
MET, MET_BYTES, BUCKET_SKETCHES = 2_048, 2 << 20, 8 << 20
#: Holders of shingles that are looked at in one step.
AT_ONCE = 1 << 20
#: Ids of documents to fetch that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_PAIRS = ((0, 1), (0, 2), (1, 2))
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingles(text: str | None, windows: Windows) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. Within two texts, 64 bits do not collide in practice."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < windows.size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words))], np.uint64)
    return np.unique(windows.of(words)[0])


def partitions(band: int) -> int:
    """First-level partitions of a band: about a fifth of its largest size."""
    return max(1, -(-(2 << band) // 5))


def signatures(elements: np.ndarray, frequent: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set of sorted hashes; ``frequent`` is sorted, ``rank`` its order from the least frequent."""
    n = len(elements)
    if not n:
        return np.empty(0, np.uint64)
    far, band = n * (100 - PERCENT) // PERCENT, n.bit_length() - 1
    often, last = np.zeros(n, bool), elements[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        often = frequent[at] == elements
        last = elements[often] if rank is None else elements[often][np.argsort(rank[at[often]])]
    rare = elements[~often]
    out, mass = [], mixed(rare ^ _A)
    for b in (band, band + 1):
        if b > band and 100 * n < PERCENT << b:
            break
        need, enough = far // 2 + 1, False
        if len(rare):
            cells = 3 * partitions(b)
            cell = ((rare >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            content, full = np.zeros(cells, np.uint64), np.zeros(cells, bool)
            content[cell[first]] = np.add.reduceat(mass, first)
            full[cell[first]] = True
            content, full = content.reshape(-1, 3), full.reshape(-1, 3)
            filled = np.cumsum(full.sum(axis=1) > 1)
            enough = bool(filled[-1] >= need)
            stop = int(np.searchsorted(filled, need)) + 1 if enough else len(filled)
            with np.errstate(over="ignore"):
                place = (np.arange(stop, dtype=np.uint64) << np.uint64(8)) + np.uint64(b)
                for k, (i, j) in enumerate(_PAIRS):
                    some = full[:stop, i] | full[:stop, j]
                    sign = content[:stop, i] * _A + content[:stop, j] * _B + mixed(place * np.uint64(3) + np.uint64(k))
                    out.append(mixed(sign[some]))
        if not enough:
            with np.errstate(over="ignore"):
                out.append(mixed(np.concatenate([rare, last])[: n * (100 - PERCENT) // 100 + 1] + np.uint64(b + 1) * _B))
    return np.unique(np.concatenate(out))


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents, by a sample, and their order from the least frequent; MOST_FREQUENT at most."""

    def each(batches):
        windows = Windows(words)
        for batch in batches:
            found = [shingles(t.as_py(), windows) for t in batch.column("text")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "s long")
    often = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT)
    found = np.array([r["s"] for r in often.collect()], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], len(found) - order


def cells_of(sizes: np.ndarray) -> np.ndarray:
    """Cells of the sketch of a set: a power of two, about a quarter of its size."""
    return np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 2, 4, 16))


def sketch(elements: np.ndarray) -> bytes:
    """Shingles in each cell of the domain, as bytes."""
    cells = int(cells_of(np.array(len(elements))))
    at = (elements >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=cells), 255).astype(np.uint8).tobytes()


def apart(u: bytes, v: bytes) -> int:
    """The sum of the differences of two sketches, the finer one folded: at most the sets' distance."""
    x, y = (np.frombuffer(z, np.uint8).astype(np.int32) for z in (u, v))
    few = min(len(x), len(y))
    if (x.max(initial=0) == 255) or (y.max(initial=0) == 255):
        return 0  # a full cell counts no further
    return int(np.abs(x.reshape(few, -1).sum(axis=1) - y.reshape(few, -1).sum(axis=1)).sum())


_FOUND = "kind int, a long, b long, x long, y long, sketch binary"


def met(table: pa.Table) -> pa.Table:
    """Rows of ``candidates`` of a bucket; documents are looked up for the signatures only that come up again."""
    out, signs, owners, ids, highs, n_ids = [], [], [], [], [], 0
    for kind, n, blob, m, who in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "blob", "m", "who"))):
        if kind != 1:
            doc, size, high, low = expand(blob, n, "<i8", "<i8", "<u8", "<u8")
            ends = np.concatenate([[0], np.cumsum(cells_of(size))]).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(who)])
            out.append([pa.array(np.full(n, kind, np.int32)), *(pa.array(c, pa.int64()) for c in (doc, size, high.view(np.int64), low.view(np.int64))), cells])
        else:
            steps, local = expand(blob, n, "<u8", "<u4")
            least, high = expand(who, m, "<i8", "<u8")
            signs.append(np.cumsum(steps, dtype=np.uint64))
            owners.append(local + np.uint32(n_ids))
            ids.append(least)
            highs.append(high)
            n_ids += m
    if signs:
        sign = np.concatenate(signs)
        signs.clear()
        order = np.argsort(sign)
        sign = sign[order]
        again = np.zeros(len(sign), bool)
        again[1:] = sign[1:] == sign[:-1]
        again[:-1] |= again[1:]
        sign, owner = sign[again], np.concatenate(owners)[order[again]]
        doc, high = np.concatenate(ids)[owner], np.concatenate(highs)[owner]
        del order, owners
        order = np.lexsort((doc, high, sign))  # of equal sets the least id
        sign, doc, high = sign[order], doc[order], high[order]
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (high[1:] != high[:-1])
        sign, doc = sign[new], doc[new]
        order = np.lexsort((doc, sign))
        sign, doc = sign[order], doc[order]
        head = np.ones(len(sign), bool)
        head[1:] = sign[1:] != sign[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(sign)), 0)) if len(sign) else np.empty(0, np.int64)
        many, hub = np.bincount(first, minlength=len(sign))[first], doc[first]
        other = hub != doc
        hub, doc, many = hub[other], doc[other], many[other]
        order = np.lexsort((-many, doc, hub))
        hub, doc, many = hub[order], doc[order], many[order]
        new = np.ones(len(hub), bool)
        new[1:] = (hub[1:] != hub[:-1]) | (doc[1:] != doc[:-1])
        n = int(new.sum())
        out.append([pa.array(np.ones(n, np.int32)), *(pa.array(c, pa.int64()) for c in (hub[new], doc[new], many[new], np.zeros(n, np.int64))), pa.nulls(n, pa.binary())])
    return pa.table([pa.chunked_array(x) for x in zip(*out)], names=["kind", "a", "b", "x", "y", "sketch"])


def candidates(spark: SparkSession, docs: DataFrame, words: int) -> DataFrame:
    """Rows of three kinds: (0, id, size, digest, digest, sketch) per document, (2, 0, size, ...) per document without an
    id, and (1, hub, member, size of their largest signature): the members of a signature with its least one."""
    buckets = common.buckets(spark, docs.select("text"), BUCKET_TEXT)
    often = spark.sparkContext.broadcast(frequent_shingles(docs, words))  # MOST_FREQUENT numbers at most

    def send(batches):
        windows = Windows(words)
        common.trim()
        members, classes, signs, n = [], {}, [], 0

        def flush():
            nonlocal members, classes, signs, n
            out = []
            kinds, ids, sizes, highs, lows = (np.array(x, t) for x, t in zip(zip(*(m[:5] for m in members)), (np.int64, np.int64, np.int64, np.uint64, np.uint64)))
            cells = [m[5] for m in members]
            least = np.array([x[0] for x in classes.values()], np.int64)
            high = np.array([x[1] for x in classes.values()], np.uint64)
            bucket = (mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            place = 2 * bucket + (kinds > 0)
            for k in np.unique(place):
                own = np.flatnonzero(place == k)
                out.append((int(k) // 2, int(k) % 2 * 2, len(own), squeeze(ids[own], sizes[own], highs[own], lows[own]), 0, b"".join([cells[o] for o in own])))
            if signs:
                # 48 bits of a signature are sent: a chance meeting is only one more candidate.
                sign, owner = np.concatenate([s for _, s in signs]), np.repeat(np.array([o for o, _ in signs], np.uint32), [len(s) for _, s in signs])
                signs = []
                order = np.argsort(sign)
                sign, owner = sign[order], owner[order]
                bucket = ((sign >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                sign >>= np.uint64(16)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    a, b = cuts[k], cuts[k + 1]
                    here, local = np.unique(owner[a:b], return_inverse=True)
                    cut = squeeze(np.diff(sign[a:b], prepend=np.uint64(0)), local.astype(np.uint32))
                    out.append((int(k), 1, int(b - a), cut, len(here), squeeze(least[here], high[here])))
            members, classes, signs, n = [], {}, [], 0
            common.trim()
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["bucket", "kind", "n", "blob", "m", "who"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = shingles(text.as_py(), windows)
                digest = xxhash.xxh3_128_intdigest(found.tobytes()) if len(found) else 0
                high, low = digest >> 64, digest & (1 << 64) - 1
                members.append((int(doc is None), doc or 0, len(found), high, low, sketch(found)))
                n += 8
                if len(found) and doc is not None:
                    if digest in classes:
                        known = classes[digest]
                        known[0] = min(known[0], doc)
                    else:
                        classes[digest] = [doc, high]
                        signs.append((len(classes) - 1, signatures(found, *often.value)))
                        n += len(signs[-1][1])
                if n >= HELD:
                    yield flush()
        if members:
            yield flush()

    sent = docs.select("id", "text").mapInArrow(send, "bucket int, kind int, n int, blob binary, m int, who binary")

    def meet(table: pa.Table) -> pa.Table:
        out = met(table)
        common.trim()
        return out

    return common.stored(spark, sent.groupBy("bucket").applyInArrow(meet, _FOUND), "candidates")


def shingle_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(row, id, elements) of the texts of the documents in ``ids``; ``row`` is a number."""

    def make(batches):
        windows = Windows(words)
        for batch in batches:
            made = [shingles(t.as_py(), windows).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "elements"])
        common.trim()

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = docs.select("id", "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    made = wanted.mapInArrow(make, "id long, elements binary").where(F.length("elements") > 0)
    return common.stored(spark, made.withColumn("row", F.monotonically_increasing_id()), "sets")


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not rule out a link; ``known`` is (id, n, sketch)."""

    def near(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("m")) + np.asarray(batch.column("n"))
            far = np.array([apart(u, v) for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())], np.int64)
            keep = pa.array(far * (100 + PERCENT) <= sizes * (100 - PERCENT))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
        common.trim()

    left = known.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("u"))
    right = known.select(F.col("id").alias("b"), "n", F.col("sketch").alias("v"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where((F.col("m") * 100 >= F.col("n") * PERCENT) & (F.col("n") * 100 >= F.col("m") * PERCENT))
    return both.select("a", "b", "m", "n", "u", "v").mapInArrow(near, "a long, b long").distinct()


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def count(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("u"), batch.column("v")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
        common.trim()

    pairs = common.stored(spark, possible(pairs, known), "possible")
    sets = shingle_sets(spark, docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), words)
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("u"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("v"))
    linked = pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v").mapInArrow(count, "a long, b long")
    linked = common.stored(spark, linked.distinct(), "verified")
    common.release(spark, pairs, sets)
    return linked


def mostly_shared(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(row) of ``sets`` (row, elements) of which at most a quarter, as for links, are shingles that no other row has.

    48 bits of a shingle are compared: a chance meeting only lets a row stay.
    """
    total = sets.agg(F.sum(F.length("elements")).alias("n"), F.count("*").alias("rows")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["n"] or 0) // (8 * BUCKET_SHINGLES)))
    ranges = max(8, total["rows"] // 50_000)

    def send(batches):
        held, rows, n = [], [], 0

        def flush():
            s, row = np.concatenate(held) >> np.uint64(16), np.repeat(np.array(rows, np.int64), [len(x) for x in held])
            order = np.argsort(s, kind="stable")
            s, row = s[order], row[order]
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            first = np.flatnonzero(head)
            alone = np.diff(np.append(first, len(s))) == 1
            s, row = s[first], row[first]
            bucket = ((s >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts, out = np.searchsorted(bucket, np.arange(buckets + 1)), []
            for k in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[k], cuts[k + 1])
                one = alone[own]
                steps = [np.diff(s[own][x], prepend=np.uint64(0)) for x in (one, ~one)]
                out.append((int(k), len(steps[0]), squeeze(steps[0], row[own][one]), len(steps[1]), squeeze(steps[1])))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["bucket", "n", "alone", "m", "shared"])

        for batch in batches:
            for row, elements in zip(batch.column("row").to_pylist(), batch.column("elements")):
                held.append(np.frombuffer(elements.as_buffer(), np.uint64))
                rows.append(row)
                n += len(held[-1])
                if n >= HELD:
                    yield flush()
                    held, rows, n = [], [], 0
        if n:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        alone, shared = [], []
        for n, one, m, more in zip(*(table.column(c).to_pylist() for c in ("n", "alone", "m", "shared"))):
            steps, row = expand(one, n, "<u8", "<i8")
            alone.append((np.cumsum(steps, dtype=np.uint64), row))
            shared.append(np.cumsum(expand(more, m, "<u8")[0], dtype=np.uint64))
        s, row = (np.concatenate(x) for x in zip(*alone))
        order = np.argsort(s, kind="stable")
        s, row = s[order], row[order]
        own = np.ones(len(s), bool)
        own[1:] = s[1:] != s[:-1]
        own[:-1] &= own[1:].copy()
        row, many = np.unique(row[own & ~np.isin(s, np.concatenate(shared))], return_counts=True)
        out, at = [], row % ranges
        for k in np.unique(at):
            out.append((int(k), int((at == k).sum()), squeeze(row[at == k], many[at == k].astype(np.int64))))
        return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["range", "n", "blob"])

    def tally(table: pa.Table) -> pa.Table:
        row, many = (np.concatenate(x) for x in zip(*(expand(b, n, "<i8", "<i8") for n, b in zip(table.column("n").to_pylist(), table.column("blob").to_pylist()))))
        row, place = np.unique(row, return_inverse=True)
        return pa.table([pa.array(row), pa.array(np.bincount(place, weights=many).astype(np.int64))], names=["row", "alone"])

    sent = sets.select("row", "elements").mapInArrow(send, "bucket int, n int, alone binary, m int, shared binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "range int, n int, blob binary")
    alone = counted.groupBy("range").applyInArrow(tally, "row long, alone long")
    sizes = sets.select("row", (F.length("elements") / 8).alias("n")).join(alone, "row", "left")
    return sizes.where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * PERCENT).select("row")


def salted(seats: DataFrame) -> DataFrame:
    """``seats`` with a salt, by which a hub of very many members is dealt over tasks."""
    return seats.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(common.SALTS)).cast("int"))


def mixed_keys(seats: DataFrame, *keys: str) -> DataFrame:
    """(keys, salt, members, bytes) of the keys whose members (salted) are of several groups."""
    members, size = F.col("members"), F.col("bytes")
    parts = seats.groupBy(*keys, "salt").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count("*").alias("members"), F.sum(F.length("sketch")).alias("bytes"))
    whole = parts.groupBy(*keys).agg(F.min("g").alias("g"), F.max("h").alias("h"), F.sum(members).alias("members"), F.sum(size).alias("bytes"), F.collect_list("salt").alias("salts"))
    return whole.where("g <> h").select(*keys, F.explode("salts").alias("salt"), "members", "bytes")


def partners(groups: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Which sets can, by their sizes and sketches, be linked with one of another group."""
    few = min(len(s) for s in sketches)
    cells = [np.frombuffer(s, np.uint8) for s in sketches]
    full = np.array([c.max() == 255 for c in cells])  # a full cell counts no further
    table = np.stack([c.reshape(few, -1).sum(axis=1, dtype=np.int32) for c in cells])
    stay = np.zeros(len(groups), bool)
    for k in range(len(groups)):
        if not stay[k]:
            both = sizes + sizes[k]
            near = (groups != groups[k]) & (np.minimum(sizes, sizes[k]) * 100 >= np.maximum(sizes, sizes[k]) * PERCENT)
            at = np.flatnonzero(near)
            far = np.abs(table[at] - table[k]).sum(axis=1)
            at = at[full[at] | full[k] | (far * (100 + PERCENT) <= both[at] * (100 - PERCENT))]
            stay[at] = True
            stay[k] = len(at) > 0
    return stay


def comparable(spark: SparkSession, seats: DataFrame, known: DataFrame) -> DataFrame:
    """The seats (hub, doc, group) that by sizes and sketches can be linked with one of another group of their hub.

    Linked sets lie in one class of sizes or in two neighbouring ones, so the members of a hub meet by class. Where they
    are too many to meet in a task all of them stay. ``known`` is (id, n, sketch).
    """
    sized = common.stored(spark, salted(seats).join(known.withColumnRenamed("id", "doc"), "doc"), "sized")
    buckets = common.buckets(spark, sized.select("sketch"), BUCKET_SKETCHES // 2)
    size = F.floor(F.log(1.34, F.col("n").cast("double"))).cast("int")  # a ratio over 4 / 3, which two linked sets keep
    rows = sized.withColumn("class", F.explode(F.array(size, size + 1)))
    rows = rows.join(mixed_keys(rows, "hub", "class"), ["hub", "class", "salt"])

    def meet(table: pa.Table) -> pa.Table:
        hub, kind, doc, group, n = (np.asarray(table.column(c)) for c in ("hub", "class", "doc", "group", "n"))
        order = np.lexsort((doc, kind, hub))
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(c[order]) != 0 for c in (hub, kind)], axis=0)
        sketches, stay = table.column("sketch").to_pylist(), np.zeros(len(order), bool)
        for own in np.split(order, np.flatnonzero(new)[1:]):
            stay[own] = partners(group[own], n[own], [sketches[k] for k in own])
        common.trim()
        return table.select(["hub", "doc", "group"]).filter(pa.array(stay))

    few = (F.col("members") <= MET) & (F.col("bytes") <= MET_BYTES)
    sent = rows.where(few).select(F.pmod(F.xxhash64("hub", "class"), F.lit(buckets)).alias("bucket"), "hub", "class", "doc", "group", "n", "sketch")
    kept = sent.groupBy("bucket").applyInArrow(meet, "hub long, doc long, group long")
    kept = common.stored(spark, kept.union(rows.where(~few).select("hub", "doc", "group")).distinct(), "comparable")
    common.release(spark, sized)
    return kept


def joining(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all groups which links between the sets join."""
    out: list[tuple[int, int]] = []
    while True:  # sets that lack too much of the others leave, until none does
        sizes = np.array([len(s) for s in sets], np.int64)
        code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(owner, weights=many[code] > 1, minlength=len(sets))
        stay = np.flatnonzero(100 * shared >= PERCENT * sizes)
        if len(stay) == len(sets):
            break
        ids, groups, sets = ids[stay], groups[stay], [sets[k] for k in stay]
        if len(sets) < 2:
            return out
    root = {g: g for g in groups.tolist()}

    def find(g):
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    labels, counts = np.unique(groups, return_counts=True)
    if len(labels) < 2:
        return out
    most = int(labels[np.argmax(counts)])
    order = np.argsort(code, kind="stable")
    holders, ends = owner[order], np.cumsum(many)
    begins, at = ends - many, np.concatenate([[0], np.cumsum(sizes)])
    for k in np.flatnonzero(groups != most).tolist():
        both, every = np.zeros(len(sets), np.int64), code[at[k] : at[k + 1]]
        for own in np.split(every, np.flatnonzero(np.diff(np.cumsum(many[every]) // AT_ONCE)) + 1):
            wide = many[own]
            places = np.repeat(begins[own] - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
            both += np.bincount(holders[places], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= PERCENT * (sizes + sizes[k] - both)) & (groups != groups[k])).tolist():
            a, b = find(int(groups[k])), find(int(groups[j]))
            if a != b:
                root[b] = a
                out.append((int(ids[k]), int(ids[j])))
    return out


def settled(spark: SparkSession, docs: DataFrame, seats: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """Links (a, b) between members of a hub; ``seats`` is (hub, doc, group), with the hubs' own, ``known`` as for ``possible``."""
    seats = comparable(spark, seats, known)
    sets = shingle_sets(spark, docs, seats.select(F.col("doc").alias("id")).distinct(), words)
    stay = common.stored(spark, sets.select("row", F.col("id").alias("doc"), (F.length("elements") / 8).alias("n")).join(mostly_shared(spark, sets), "row"), "mostly-shared")
    left = salted(seats.join(stay, "doc"))
    salts = left.groupBy("hub", "salt").agg(F.min("group").alias("g"), F.max("group").alias("h"))
    salts = salts.groupBy("hub").agg(F.min("g").alias("g"), F.max("h").alias("h"), F.collect_list("salt").alias("salts")).where("g <> h")
    salts = common.stored(spark, salts.select("hub", F.explode("salts").alias("salt")), "open")
    left = common.stored(spark, left.join(salts, ["hub", "salt"], "left_semi"), "seats")
    # A hub's largest group needs no links in itself. Blocks of it and of the others, by their numbers of shingles.
    sizes = left.groupBy("hub", "group").agg(F.sum("n").alias("n"))
    sizes = sizes.groupBy("hub").agg(F.max_by("group", F.struct("n", "group")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    whole = F.col("all") <= 2 * BLOCK_SHINGLES
    sizes = sizes.select("hub", "largest", F.when(whole, 0).otherwise(blocks(F.col("all") - F.col("most"))).alias("p"), blocks(F.col("most")).alias("q"))
    at = left.join(sizes.join(salts, "hub"), ["hub", "salt"])
    block = F.pmod(F.xxhash64("row"), F.when(F.col("group") == F.col("largest"), F.col("q")).otherwise(F.greatest("p", F.lit(1)))).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    large = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(i.alias("i"), (F.col("p") + F.col("block")).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    keys = F.when(F.col("p") == 0, alone).when(F.col("group") == F.col("largest"), large).otherwise(other)
    at = at.withColumn("block", block).select("hub", "row", "doc", "group", "n", F.explode(keys).alias("key"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(at.agg(F.sum("n").alias("n")).first()["n"] or 0) // BLOCK_SHINGLES))

    def meet(table: pa.Table) -> pa.Table:
        hub, i, j, doc, group = (np.asarray(table.column(c)) for c in ("hub", "i", "j", "doc", "group"))
        order = np.lexsort((doc, j, i, hub))
        elements, out = table.column("elements").combine_chunks(), []
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(c[order]) != 0 for c in (hub, i, j)], axis=0)
        for own in np.split(order, np.flatnonzero(new)[1:]):
            if len(np.unique(group[own])) > 1:
                out += joining(doc[own], group[own], [np.frombuffer(elements[int(k)].as_buffer(), np.uint64) for k in own])
        return pa.table([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    at = at.select("hub", "row", "doc", "group", "key.*").withColumn("bucket", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(buckets)))
    few = stay.select("row").limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = sets.select("row", "elements").join(F.broadcast(stay.select("row")) if few else stay.select("row"), "row", "left_semi")
    met = at.join(own, "row").select("bucket", "hub", "i", "j", "doc", "group", "elements")
    links = common.stored(spark, met.groupBy("bucket").applyInArrow(meet, "a long, b long"), "links")
    common.release(spark, seats, sets, stay, salts, left)
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component) per row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = candidates(spark, docs, words)
    members = found.where("kind <> 1").select(F.when(F.col("kind") == 0, F.col("a")).alias("id"), F.col("b").alias("n"), "x", "y")
    stars = common.stored(spark, found.where("kind = 1").groupBy(F.col("a").alias("hub"), F.col("b").alias("doc")).agg(F.max("x").alias("most")), "stars")
    known = found.where("kind = 0 and b > 0").select(F.col("a").alias("id"), F.col("b").alias("n"), "sketch")
    near = verified(spark, docs, stars.select(F.col("hub").alias("a"), F.col("doc").alias("b")), known, words)

    # By class and salt, so that a class of very many rows is spread.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(common.SALTS)).cast("int"))
    parts = salted.where("id is not null and n > 0").groupBy("x", "y", "salt").agg(F.min("id").alias("least"))
    classes = parts.groupBy("x", "y").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))

    # An id of several texts is linked with the least ids of their classes, which stand for it.
    texts = members.where("id is not null").groupBy("id").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in "xy"))
    several = common.stored(spark, texts.where("least_x <> most_x or least_y <> most_y").select("id"), "several")
    links = near
    any_several = several.limit(1).count() > 0
    if any_several:
        standing = classes.select("x", "y", "least", F.explode("salts").alias("salt"))
        links = links.union(salted.join(several, "id", "left_semi").join(standing, ["x", "y", "salt"]).select("id", "least").distinct())
    groups = common.components(spark, links)

    # Second round: members of a hub that are still in different components.
    seats = stars.where("most > 2").select("hub", "doc")
    seats = seats.union(seats.select("hub", F.col("hub").alias("doc")).distinct()).join(groups.withColumnRenamed("id", "doc"), "doc", "left")
    more = settled(spark, docs, seats.select("hub", "doc", F.coalesce("component", "doc").alias("group")), known, words)
    common.release(spark, stars, near)
    if more.limit(1).count():
        groups = common.components(spark, groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    # Back to all rows; those without shingles have no class, and of an id of several texts its component.
    classes = classes.join(groups, F.col("least") == F.col("id"), "left").select("x", "y", F.coalesce("component", "least").alias("component"), F.explode("salts").alias("salt"))
    rows = salted.join(classes, ["x", "y", "salt"], "left")
    if any_several:
        own = several.join(groups, "id").select("id", F.col("component").alias("own"))
        rows = rows.join(own, "id", "left").withColumn("component", F.coalesce("component", "own"))
    return rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under Jaccard similarity of 5-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


SQL = {
    "op2_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS g FROM w, unnest(range(0, greatest(len(w) - 4, 1))) u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id""",
}
