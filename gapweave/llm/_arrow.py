"""Helpers for Arrow batches of documents: byte buffers, bounded slices, word and shingle hashes.

A batch handed over by Spark can hold many megabytes of text. Everything here works on
slices of bounded size, so the memory of a task does not follow the size of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch, shared_dir  # noqa: F401  for the operators

SLICE_BYTES = 1 << 20
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """From now on a session's Arrow batches have BATCH_ROWS rows at most: one of 10,000 documents lies whole in the JVM's buffers and again in Python."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


class Tables:
    """Tables written one after another to a folder: each cuts the lineage where executors can read it again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n = spark, path, 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most `most` bytes of text together, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def bytes_of(buf: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = buf.tobytes()
    edges = at.tolist()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


# ---- hashes -------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finaliser
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])  # what separates terms of digits, letters and bytes over 127


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), SLICE_BYTES)
        for k, base in enumerate((_ODD, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def words(buf: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes not set in `apart`, and the n + 1 word numbers at which documents begin."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~apart[buf]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, at: np.ndarray, code: np.ndarray = LOWER_CODE, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased) and the documents' word numbers."""
    starts, ends, bounds = words(buf, at, apart)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    up, down = _upto(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(code[buf] * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_ODD)), bounds


def shingle_hashes(buf: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `width` words, in order with repeats, and where documents begin.

    A document with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    h, bounds = word_hashes(buf, at)
    m = len(h)
    counts = np.diff(bounds)
    if not m:
        return h, np.zeros(len(counts) + 1, np.int64)
    place = np.arange(m) - np.repeat(bounds[:-1], counts)
    size = np.repeat(counts, counts)
    total = np.zeros(m, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * _ODD % (1 << 64)
        part = h[k:] * np.uint64(factor)
        if k:
            part[place[: m - k] + k >= size[: m - k]] = 0
        total[: m - k] += part
    keep = place <= np.maximum(size - width, 0)
    out = mix(total[keep])
    return out, np.concatenate([[0], np.cumsum(np.where(counts, np.maximum(counts - width + 1, 1), 0))])
