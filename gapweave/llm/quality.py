"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A Gaussian kernel over standardised statistics of a text's bytes is approximated by DIM random
cosines. Labelled rows are dealt over tasks; each task adds up its part of the normal equations
(a matrix of fixed size) and only these sums reach the driver, which solves the ridge system.
Raw scores of labelled rows kept apart are binned, and pool-adjacent-violators on the bins
makes them probabilities.

Cases: a null or empty text is scored like any other (all its statistics are 0); labels for
unknown documents, null labels and repeated labels are allowed (each labelled row counts);
without labelled rows of both kinds the share of label 1, or 0.5, is everyone's score; null
doc_ids are scored but never learned from; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from . import _arrow

DIM = 192
RIDGE = 1e-3
BANDWIDTH = 3.0
BINS = 2048
PARTS = 32  # tasks that sum normal equations; each sends one matrix of fixed size
SEED = 7

STATISTICS = ("length", "word_length", "upper", "digit", "symbol", "stop_mark", "space", "newline", "non_ascii", "bar", "distinct_words", "word_spread", "marked_words", "distinct_bytes", "line_repeats")

# byte classes as bits: upper, digit, symbol, sentence mark, space, newline, non-ASCII, bar
_CLASS = np.zeros((8, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#$%&*!<>=@~^_\\{}[]+/"]] = True
_CLASS[3, [ord(c) for c in ".,;:?"]] = True
_CLASS[4, [32, 9]] = True
_CLASS[5, [10, 13]] = True
_CLASS[6, 128:] = True
_CLASS[7, ord("|")] = True


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    size = np.diff(at).astype(np.float64)
    per = 1 / np.maximum(size, 1)
    counts = [_sums(_CLASS[k][buf], at) for k in range(8)]
    starts, ends, bounds = _arrow.words(buf, at)
    n = np.diff(bounds).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    square = np.concatenate([[0], np.cumsum(length**2)])
    plain = np.concatenate([[0], np.cumsum(length)])
    many = np.maximum(n, 1)
    mean = (plain[bounds[1:]] - plain[bounds[:-1]]) / many
    spread = np.sqrt(np.maximum((square[bounds[1:]] - square[bounds[:-1]]) / many - mean**2, 0))
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = np.concatenate([[0], np.cumsum(_CLASS[2][last] | _CLASS[7][last])])
    hashes, _ = _arrow.word_hashes(buf, at)
    kinds, seen, repeats = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    ends_of_lines = np.flatnonzero(_CLASS[5][buf])
    line_at = np.searchsorted(ends_of_lines, at)
    for k in range(len(size)):
        a, b = bounds[k], bounds[k + 1]
        kinds[k] = len(np.unique(hashes[a:b]))
        seen[k] = np.count_nonzero(np.bincount(buf[at[k] : at[k + 1]], minlength=256)) if size[k] else 0
        if line_at[k + 1] - line_at[k] >= 1:
            lines = buf[at[k] : at[k + 1]].tobytes().split(b"\n")
            repeats[k] = 1 - len(set(lines)) / len(lines)
    return np.stack([np.log1p(size) / 8, mean / 6, *(counts[j] * per for j in (0, 1, 2, 3, 4)), np.sqrt(counts[5] * per), counts[6] * per, counts[7] * per, kinds / np.sqrt(many) / 10, spread / 4, (marked[bounds[1:]] - marked[bounds[:-1]]) / many, seen / 64, repeats], 1)


@dataclass
class Model:
    """Everything a task needs to score: a few kilobytes, whatever the input."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.center, self.scale, self.weights, self.phase) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def fourier(x: np.ndarray, center: np.ndarray, scale: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random cosines of the standardised statistics, and a constant."""
    z = np.clip((x - center) / scale, -6, 6) @ weights + phase
    return np.concatenate([np.cos(z) * np.sqrt(2 / weights.shape[1]), np.ones((len(x), 1))], 1)


def pool(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted pool-adjacent-violators: the non-decreasing fit to means y with weights w."""
    blocks: list[list[float]] = []
    for v, m in zip(y, w):
        blocks.append([v, m, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            m = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / m, m, a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The statistics of each text as array<double>, beside the named columns."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                x = statistics(*_arrow.utf8(part.column("text")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), flat], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, learn: object, label: str = "quality") -> Model:
    """Fit on documents for which the boolean column `learn` (over doc_id) holds and a label is there.

    labels has doc_id and the label column (0 or 1). A fifth of the labelled rows calibrates.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # statistics are a few numbers a row, so the shuffle of the join carries no text
    rows = _features(base.filter(learn).filter(F.col("doc_id").isNotNull()), ("doc_id",)).join(known, "doc_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5 * PARTS)).cast("int")).repartition(PARTS, "part")
    _arrow.shared_dir(spark)
    rows = rows.checkpoint()
    n = len(STATISTICS)
    moments = rows.agg(F.count("y").alias("n"), F.sum("y").alias("s"), *(F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(n)), *(F.stddev_pop(F.get("x", F.lit(k))).alias(f"d{k}") for k in range(n))).first()
    rng = np.random.default_rng(SEED)
    weights = rng.normal(size=(n, DIM)) / BANDWIDTH
    phase = rng.uniform(0, 2 * np.pi, DIM)
    if not moments["n"] or moments["s"] in (0, moments["n"]):
        share = moments["s"] / moments["n"] if moments["n"] else 0.5
        return Model(np.zeros(n), np.ones(n), weights, phase, np.zeros(DIM + 1), np.array([0.0]), np.array([share]))
    center = np.array([moments[f"m{k}"] for k in range(n)])
    scale = np.maximum([moments[f"d{k}"] for k in range(n)], 1e-6)
    size = DIM + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            # 65,536 rows of features at a time
            for at in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(at, 1 << 16)
                z = fourier(_matrix(part.column("x")), center, scale, weights, phase)
                gram += z.T @ z
                right += z.T @ part.column("y").to_numpy(zero_copy_only=False)
        if gram.any():
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["gram", "right"])

    fit = rows.filter(F.col("part") % 5 != 0).select("x", "y").coalesce(PARTS).mapInArrow(sums, "gram binary, right binary")
    gram, right = np.zeros((size, size)), np.zeros(size)
    for r in fit.toLocalIterator():  # PARTS rows at most: one sum a task
        gram += np.frombuffer(r["gram"]).reshape(size, size)
        right += np.frombuffer(r["right"])
    beta = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(size) / size, right)
    model = Model(center, scale, weights, phase, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x")))
            k = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    bins = rows.filter(F.col("part") % 5 == 0).select("x", "y").mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("y").alias("n")).collect()  # BINS rows at most
    bins.sort(key=lambda r: r["bin"])
    if bins:
        # one row of either label stands at either end, so no score is quite certain
        y, w = np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins])
        knots = np.maximum.accumulate([r["raw"] for r in bins])
        prior = moments["s"] / moments["n"]
        model.knots, model.values = knots, pool((y * w + prior) / (w + 1), w + 1)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """`keep` columns and the calibrated score of each text (0 to 1, higher: better) under the name `out`."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                s = model.score(statistics(*_arrow.utf8(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], [*keep, out])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
