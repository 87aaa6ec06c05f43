"""Near-duplicate detection by circulant MinHash: two permutations stand for all coordinates of a signature.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; a set holds the distinct shingles of
WIDTH words. Shingles fall on 2^32 cells by their hash. The permutation `scatter` of the cells is applied once;
coordinate k is the least value of the permutation `order` over the scattered cells, shifted circularly by k. ROWS
coordinates make a band, and sets that agree in a band meet. Two sets of similarity s miss each other in all bands with
probability (1 - s^ROWS)^BANDS: 2.4e-9 at 0.85, less above.

Equal sets are one node. The nodes of one band value are a list; equal lists are one. Each node is paired with two
of its lists' least nodes, filtered by size and parity bitmap and verified on whole sets; lists that still hold
several components after that go on in `links.settle`, which compares all their pairs across components. The signature
only proposes: every link is confirmed on whole sets.

Memory: a task holds a slice of texts and one array of the slice's shingles a coordinate, one block pair of a list, or one
set and the set that is compared with it.

Cases: null, empty and wordless texts have n_shingles 0, link with nothing and are kept; shorter texts have their whole
sequence as one shingle; very long texts are taken whole; rows with the same doc_id and repeated rows are documents of
their own, all of them kept if their doc_id names the component; a null doc_id never names a component if another id is
there, and is kept only where none is; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from . import _arrow
from .links import SIZE_SCALE, alike, bitmap, labelled, set_id, sets, settle

WIDTH, PERCENT = 3, 85
ROWS, BANDS = 6, 42
CLOSEST, SCALE = 3, 4  # components that a node meets in a round; size of a parity bitmap
CELLS = 1 << 15  # scattered cells that go through all coordinates before the next ones


def _stirred(x: np.ndarray, a: int, b: int, shifts: tuple[int, int, int]) -> np.ndarray:
    """A permutation of the 32-bit numbers: shifts and odd factors, each of which can be undone."""
    x ^= x >> np.uint32(shifts[0])
    x *= np.uint32(a)
    x ^= x >> np.uint32(shifts[1])
    x *= np.uint32(b)
    x ^= x >> np.uint32(shifts[2])
    return x


def scatter(cells: np.ndarray) -> np.ndarray:
    return _stirred(cells.copy(), 0x9E3779B1, 0x7FEB352D, (15, 16, 15))


def order(cells: np.ndarray) -> np.ndarray:
    return _stirred(cells, 0x85EBCA6B, 0xC2B2AE35, (16, 13, 16))


def signatures(cells: np.ndarray, starts: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """Signatures (documents, size) of non-empty runs of scattered cells that begin at `starts`."""
    out = np.full((size, len(starts)), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(cells), CELLS):
        part = cells[a : a + CELLS]
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, a + len(part), "left")
        inside = np.maximum(starts[first:last] - a, 0)
        for k in range(size):
            least = np.minimum.reduceat(order(part - np.uint32(k)), inside)
            np.minimum(out[k, first:last], least, out=out[k, first:last])
    return out.T


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit hashes (documents, BANDS) of the bands of signatures, different for equal values in different bands."""
    x = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_arrow._ODD) + np.zeros((len(x), 1), np.uint64)
    for k in range(ROWS):
        h = _arrow.mix(h ^ x[:, :, k])
    return h


def _described(base: DataFrame) -> DataFrame:
    """doc_id, key, text_hash, n, sid, bits and band hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                found = list(sets(part, WIDTH))
                n = np.array([len(u) for u in found], np.int64)
                some = np.flatnonzero(n)
                hashes = np.zeros((len(found), BANDS), np.uint64)
                if len(some):
                    cells = scatter((np.concatenate([found[k] for k in some]) >> np.uint64(32)).astype(np.uint32))
                    hashes[some] = bands(signatures(cells, np.concatenate([[0], np.cumsum(n[some])[:-1]])))
                rows = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * BANDS, pa.array(hashes.view(np.int64).ravel()))
                values = [pa.array(n), pa.array([set_id(u) if len(u) else None for u in found], pa.int64()), pa.array([bitmap(u, SCALE) if len(u) else None for u in found], pa.binary()), rows]
                yield pa.RecordBatch.from_arrays([*map(part.column, ("doc_id", "key", "text_hash")), *values], ["doc_id", "key", "text_hash", "n", "sid", "bits", "bands"])

    return base.mapInArrow(run, "doc_id long, key long, text_hash long, n long, sid long, bits binary, bands array<long>")


def dedup(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept of every document.

    BANDS and ROWS are chosen for `percent` of 85 or more; a lower one is an error, as links would be missed.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"the bands find links of {PERCENT} % or more")
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("text_hash", F.xxhash64("text"))
    with _arrow.scratch(spark, "circulant") as path:
        table = _arrow.Tables(spark, path)
        rows = table(_described(base))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
        nodes = table(rows.filter("sid is not null").groupBy("sid").agg(*(F.min(c).alias(c) for c in ("n", "key", "bits", "bands")), F.min("doc_id").alias("least"), first))

        met = nodes.select("sid", F.explode("bands").alias("band"))
        several = met.groupBy("band").agg(F.count("*").alias("c"), F.min("sid").alias("a")).filter("c > 1")
        members = table(met.join(several, "band"))
        which = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"x{k}") for k in (0, 1)]  # a set of nodes by two sums of hashes
        lists = members.groupBy("band").agg(F.count("*").alias("c"), *which).groupBy("x0", "x1", "c").agg(F.min("band").alias("band"))
        code = F.floor(F.log("n") * SIZE_SCALE).cast("int").alias("code")
        listed = members.join(lists.select("band"), "band", "left_semi").join(nodes.select("sid", "n"), "sid")
        listed = table(listed.select(F.col("band").alias("sig"), F.col("sid").alias("gid"), code, F.lit(0).alias("place"), "sid"))
        # each node first meets two of its lists' least nodes only; components decide what else must be looked at
        firsts = members.groupBy(F.col("sid").alias("b")).agg(F.array(F.min("a"), F.max("a")).alias("heads")).select(F.explode("heads").alias("a"), "b")
        tested = table(alike(firsts.filter("a <> b").distinct(), nodes, percent))

        comp = settle(tested, listed, nodes, base, percent, WIDTH, table, CLOSEST)
        out = labelled(rows.select("doc_id", "n", "sid"), nodes, comp)
        component = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")).checkpoint()
