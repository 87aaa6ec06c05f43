"""Exact n-gram Jaccard self-join by grouped prefixes, and the components of its links.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. A
document's set holds its distinct shingles of WIDTH words (64-bit hashes). Sets link when
100 * intersection >= percent * union.

1. Equal sets are one node. A node's prefix is its first n - ceil(percent * n / 100) + 1 shingles
   in one global order: by the class of their frequency, then by hash, so that common passages
   seldom stand in a prefix. The classes come from counters over all shingles of all documents
   (`frequency_classes`); any order at all gives whole results.
2. Nodes with the same prefix and size are one group. Postings (shingle, group, size, place in
   the prefix) travel packed; the groups that share a prefix shingle make a list.
3. Within a list, pairs of groups are filtered by size and by place, and groups that no other
   one passes with leave the list. In a list of up to SMALL groups all pairs that pass are taken,
   in a longer one each group is paired with one pivot group that it passes with. Such pairs are
   expanded to nodes, filtered by parity bitmaps (their distance bounds the intersection from
   above) and verified on whole sets. The links are merged to components.
4. Only longer lists, and lists with groups of several nodes, that still hold several components go on. Their group pairs are filtered in
   blocks, the rest expanded to pairs of nodes of different components, filtered by bitmaps and
   verified: first each node with the closest one of every other component, then, in the lists
   that are still open, all pairs left. So links between components are all found, and a group of
   near copies is merged without its pairs being listed.

Memory: a task holds one bucket of postings (19 bytes each; their number follows the counted shingles), one
block pair, or one set and the set that is compared with it. What follows the lists is in `links`.

Cases: null, empty and wordless texts have n_shingles 0 and link with nothing; shorter texts
have their whole sequence as one shingle; very long texts are taken whole; rows with the same
doc_id and repeated rows are documents of their own; a null doc_id never names a component if
another id is there; ties of size or frequency go by hash; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from . import _arrow
from .links import PLACE_SCALE, Filter, alike, bitmap, labelled, partitions, set_id, sets, settle, signed, size_code

WIDTH, PERCENT = 5, 80
PLACES, SLICE = 1 << 20, 1 << 14  # frequency counters, and those of them that travel in one row
SMALL = 16  # groups of a list whose pairs are all taken if they pass the filters
STAR = 256  # groups of a list that one pivot can take
POSTING = 8 + 8 + 2 + 1  # bytes of a posting: shingle, group, size, place
BUCKET = 4 << 20  # bytes of postings that a task holds at once
FLUSH = 16 << 20  # bytes of text between two flushes of a task's buckets


def group_key(first: np.ndarray, size: int) -> int:
    """128 bits for a prefix and a set size; the lower 64 are the group's id."""
    return xxhash.xxh3_128_intdigest(first.tobytes(), size)


def _group(key: int) -> int:
    return signed(key & (1 << 64) - 1)


def prefix(u: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a sorted set in the global order, in that order."""
    size = len(u) - -(-percent * len(u) // 100) + 1
    c = classes[(u & np.uint64(PLACES - 1)).astype(np.int64)]
    return u[np.argsort(c, kind="stable")[:size]]


def pivots(allowed: Filter, n: int) -> np.ndarray:
    """For each group of a list in order of size the group that it is paired with, or itself.

    The list is taken in runs of STAR groups. In a run the first group without a pivot becomes one
    and takes all that pass its filter; the first pivots of consecutive runs are paired.
    """
    lead = np.full(n, -1)
    for start in range(0, n, STAR):
        stop = min(n, start + STAR)
        for k in range(start, stop):
            if lead[k] < 0:
                lead[k] = k
                later = np.arange(k + 1, stop)
                later = later[lead[k + 1 : stop] < 0]
                lead[later[allowed(k, later)]] = k
        if start and lead[start] == start and allowed(start - STAR, start):
            lead[start] = start - STAR
    return lead


def partnered(allowed: Filter, n: int) -> np.ndarray:
    """Which groups of a list in order of size pass the filter with any other one; neighbours are tried first."""
    every = np.arange(n)
    out = np.zeros(n, bool)
    for step in (1, 2, 4):
        if n > step:
            good = allowed(every[:-step], every[step:])
            out[:-step] |= good
            out[step:] |= good
    for k in np.flatnonzero(~out).tolist():
        lo, hi = np.searchsorted(allowed.code, (allowed.code[k] - allowed.slack, allowed.code[k] + allowed.slack + 1))
        near = np.delete(every[lo:hi], k - lo)
        good = near[allowed(k, near)]
        out[good] = True
        out[k] = len(good) > 0
    return out


def group_pairs(allowed: Filter, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a list's groups that are taken at once, by places in the list."""
    if n <= SMALL:
        one, other = np.triu_indices(n, 1)
        good = allowed(one, other)
        return one[good], other[good]
    lead, every = pivots(allowed, n), np.arange(n)
    return lead[lead != every], every[lead != every]


def _dense_or_places(counts: np.ndarray) -> bytes:
    """SLICE counters as their bytes, those of one weight side by side (so that compression finds the zeros), or, if shorter, the places of what was counted."""
    if counts.sum() < SLICE // 2:
        return np.repeat(np.arange(SLICE, dtype=np.uint16), counts).tobytes()
    return np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 8).T).tobytes()


def _counts(raw: bytes) -> np.ndarray:
    if len(raw) < 8 * SLICE:
        return np.bincount(np.frombuffer(raw, np.uint16), minlength=SLICE)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def frequency_classes(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A class from 0 (least) to 255 (most frequent) for each of PLACES counters, and the number of all shingles.

    Every shingle of every document is counted once at the place of its low bits. A place's class
    follows from how many standard deviations of a mean place's count it lies above the mean (in
    eighths up to 10, by the logarithm beyond), so the classes keep their meaning at every size of
    the corpus. The counters (8 MB) are all that reaches the driver, the classes (1 MB) all that
    goes back.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(PLACES, np.int64), [], 0
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                held += list(sets(part, WIDTH))
                size += sum(map(len, held[-part.num_rows :]))
                if size > PLACES:
                    total += np.bincount((np.concatenate(held) & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
                    held, size = [], 0
        if size:
            total += np.bincount((np.concatenate(held) & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        parts = total.reshape(-1, SLICE)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([_dense_or_places(parts[k]) for k in used], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                sums[k] = sums.get(k, 0) + _counts(x.as_py())
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    sums = docs.select("text").mapInArrow(tally, schema).repartition(partitions(docs.sparkSession), "slice").mapInArrow(add, schema).toArrow()
    total = np.zeros((PLACES // SLICE, SLICE), np.float32)
    for k, x in zip(sums.column("slice").to_pylist(), sums.column("counts").to_pylist()):
        total[k] = np.frombuffer(x, np.int64)
    mean = total.mean(dtype=np.float64)
    above = (total.ravel() - np.float32(mean)) / np.float32(np.sqrt(mean + 1))
    return np.clip(np.where(above < 10, 40 + 8 * above, 120 + 8 * np.log2(np.maximum(above, 10) / 10)), 0, 255).astype(np.uint8), int(total.sum(dtype=np.float64))


def _packed(keys: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of bytes, packed into one binary value for each of the buckets that shingles are dealt to."""
    bucket = (keys >> np.uint64(20) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order)) * rows.shape[1]
    raw = pa.py_buffer(np.ascontiguousarray(rows[order]))
    payload = pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(ends.astype(np.int32)), raw])
    return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), payload], ["bucket", "payload"])


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Rows of bytes of one bucket after another; the batches are sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if b != now and held:
                yield np.concatenate(held)
                held = []
            now = b
            held.append(np.frombuffer(x.as_py(), np.uint8).reshape(-1, width))
    if held:
        yield np.concatenate(held)


def _lists(base: DataFrame, classes: np.ndarray, percent: int, total: int) -> DataFrame:
    """sig, gids, codes, places, ones, others: each list of groups that can link once, in order of size, with the pairs to take by places in it."""
    parts = partitions(base.sparkSession)
    # a prefix holds about the share of its set that links need not share
    buckets = max(64, 4 * parts, min(1 << 30, total * (100 - percent) // 100 * POSTING // BUCKET))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, tails, size = [], [], 0

        def out():
            x = np.concatenate(tokens)
            return _packed(x, np.concatenate([x.view(np.uint8).reshape(-1, 8), np.concatenate(tails)], 1), buckets)

        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                size += part.nbytes
                for u in sets(part, WIDTH):
                    if not len(u):
                        continue
                    p = prefix(u, classes, percent)
                    key = group_key(p, len(u))
                    if key in seen:
                        continue
                    seen.add(key)
                    tail = np.zeros((len(p), 11), np.uint8)
                    tail[:, :8] = np.frombuffer((key & (1 << 64) - 1).to_bytes(8, "little"), np.uint8)
                    tail[:, 8:10] = np.frombuffer(size_code(len(u)).to_bytes(2, "little"), np.uint8)
                    tail[:, 10] = np.minimum(255, np.arange(len(p)) * PLACE_SCALE // len(u))
                    tokens.append(p)
                    tails.append(tail)
                if size > FLUSH and tokens:
                    yield out()
                    tokens, tails, size = [], [], 0
                if len(seen) > 500_000:
                    seen.clear()
        if tokens:
            yield out()

    ints = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.list_(pa.int64()), ints, pa.list_(pa.int16()), ints, ints)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for raw in _unpacked(batches, POSTING):
            token = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
            gid = np.ascontiguousarray(raw[:, 8:16]).view(np.int64).ravel()
            code = np.ascontiguousarray(raw[:, 16:18]).view(np.uint16).ravel()
            # most shingles stand in one posting only: leave them before the sort by three keys
            order = np.argsort(token, kind="stable")
            t = token[order]
            same = np.append(t[1:] == t[:-1], False)
            order = order[same | np.append(False, same[:-1])]
            order = order[np.lexsort((gid[order], code[order], token[order]))]
            token, gid, code, place = token[order], gid[order], code[order], raw[order, POSTING - 1]
            fresh = np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1]) | (code[1:] != code[:-1])) if len(token) else np.zeros(0, bool)
            token, gid, code, place = token[fresh], gid[fresh], code[fresh], place[fresh]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(token)))
            allowed = Filter(code, place, percent)
            twos = first[size == 2]
            hopeless = set(twos[~allowed(twos, twos + 1)].tolist())
            rows = []
            for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
                if a in hopeless:
                    continue
                s = xxhash.xxh3_64_intdigest(gid[a : a + n].tobytes())
                if s in seen:
                    continue
                seen.add(s)
                take = np.arange(a, a + n)
                take = take[partnered(Filter(code[take], place[take], percent), n)]
                if len(take):
                    one, other = group_pairs(Filter(code[take], place[take], percent), len(take))
                    rows.append((signed(s), gid[take], code[take].astype(np.int32), place[take].astype(np.int16), one.astype(np.int32), other.astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["sig", "gids", "codes", "places", "ones", "others"])
            if len(seen) > 500_000:
                seen.clear()

    postings = base.select("text").mapInArrow(post, "bucket int, payload binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    # equal lists of several tasks stand for different shingles; the places of one of them are enough, as each alone bounds the pairs
    return postings.mapInArrow(lists, "sig long, gids array<long>, codes array<int>, places array<short>, ones array<int>, others array<int>").dropDuplicates(["sig"])


def join(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document.

    With `by_row` also text_hash (xxhash64 of the text) and stays: whether the row stands for its
    component as the one with the least doc_id (null last) and text hash, or has no words.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("text_hash", F.xxhash64("text"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes, total = frequency_classes(base)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                n, sid, gid, bits = [], [], [], []
                for u in sets(part, WIDTH):
                    n.append(len(u))
                    sid.append(set_id(u) if len(u) else None)
                    gid.append(_group(group_key(prefix(u, classes, percent), len(u))) if len(u) else None)
                    bits.append(bitmap(u) if len(u) else None)
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, ("doc_id", "key", "text_hash")), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(gid, pa.int64()), pa.array(bits, pa.binary())],
                    ["doc_id", "key", "text_hash", "n", "sid", "gid", "bits"],
                )

    with _arrow.scratch(spark, "jaccard") as path:
        table = _arrow.Tables(spark, path)
        rows = table(base.mapInArrow(describe, "doc_id long, key long, text_hash long, n long, sid long, gid long, bits binary"))
        per_set = [F.min(c).alias(c) for c in ("gid", "n", "key", "bits")]
        nodes = table(rows.filter("sid is not null").groupBy("sid").agg(*per_set, F.min("doc_id").alias("least"), F.min(row).alias("first")))
        lists = table(_lists(base, classes, percent, total))
        several = table(nodes.groupBy("gid").agg(F.count("*").alias("k"), F.min("sid").alias("head")))

        # pairs of groups, expanded to the first node of the pivot group and all nodes of the other one
        entries = lists.select("gids", F.explode(F.arrays_zip("ones", "others")).alias("p"))
        groups = entries.select(F.expr("gids[p.ones]").alias("one"), F.expr("gids[p.others]").alias("gid")).distinct()
        groups = groups.union(several.filter("k > 1").select("gid", "gid"))
        heads = several.select(F.col("gid").alias("one"), F.col("head").alias("a"))
        pairs = groups.join(heads, "one").join(nodes.select("gid", F.col("sid").alias("b")), "gid").filter("a <> b")
        tested = table(alike(pairs.select("a", "b").distinct(), nodes, percent))

        # lists whose pairs of nodes are not all tested yet: long ones, and those with a group of several nodes
        whole = lists.filter(F.size("gids") <= SMALL).select("sig", F.explode("gids").alias("gid")).join(several.filter("k > 1"), "gid").select("sig")
        whole = whole.union(lists.filter(F.size("gids") > SMALL).select("sig")).distinct()
        listed = lists.join(whole, "sig", "left_semi").select("sig", F.posexplode("gids").alias("at", "gid"), "codes", "places")
        listed = listed.select("sig", "gid", F.expr("codes[at]").alias("code"), F.expr("places[at]").cast("int").alias("place"))
        listed = table(listed.union(several.filter("k > 2").select("gid", "gid", F.lit(0), F.lit(0))).join(nodes.select("sid", "gid"), "gid"))

        comp = settle(tested, listed, nodes, base, percent, WIDTH, table)
        out = labelled(rows.select("doc_id", "text_hash", "n", "sid"), nodes, comp)
        stays = F.coalesce(F.col("stands").eqNullSafe(row) | F.col("sid").isNull(), F.lit(False)).alias("stays")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"), *(["text_hash", stays] if by_row else [])).checkpoint()
