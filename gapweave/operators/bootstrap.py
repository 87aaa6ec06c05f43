"""Percentile bootstrap intervals of the means of several metrics in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import scratch, ship
from . import order as od

RESAMPLES, LEVEL, SEED = 10_000, 0.95, 42
SLACK = 3.5  # standard deviations by which Poisson numbers stay under the draws that they stand for
WHOLE = 20_000  # values of a group up to which the generator is replayed as for one array
STEP = 1 << 18  # draws at once: they stay in the processor's cache
LOOKED_UP, OPEN = 1 << 14, (1 << 16) - 1  # rates up to which Poisson numbers are looked up by 16 bits; what the bits leave open
OWNERS = 1 << 22  # places of a table that finds the row of a single draw
GROUPS = 100_000  # groups whose sizes are broadcast


def _bounds(means: np.ndarray, level: float) -> np.ndarray:
    return np.quantile(means, [(1 - level) / 2, (1 + level) / 2], axis=0)


def bootstrap_means(values: np.ndarray, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> np.ndarray:
    """(2, metrics): intervals of the means of columns of one length, all from one set of drawn rows."""
    n = len(values)
    if not n:
        return np.full((2, values.shape[1]), np.nan)
    rng, step = np.random.default_rng(seed), max(1, 1_000_000 // n)
    return _bounds(np.concatenate([values[rng.integers(0, n, (min(step, resamples - k), n))].mean(1) for k in range(0, resamples, step)]), level)


def bootstrap_mean(values: np.ndarray, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> tuple[float, float]:
    """The interval of one array's mean; NaN is left out."""
    return tuple(float(x) for x in bootstrap_means(values[~np.isnan(values)][:, None], resamples, level, seed)[:, 0])


def bootstrap_paths(sizes: Sequence[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each chunk the splits (first chunk, end, values on the left, on the right) of a binary tree that lead to it."""
    sums, out, todo = np.concatenate([[0], np.cumsum(sizes)]), [[] for _ in sizes], [(0, len(sizes), [])]
    while todo:
        a, b, path = todo.pop()
        if b - a == 1:
            out[a] = path
        else:
            m = (a + b) // 2
            path = [*path, (a, b, int(sums[m] - sums[a]), int(sums[b] - sums[m]))]
            todo += [(a, m, path), (m, b, path)]
    return out


def bootstrap_chunk(values: np.ndarray, weights: np.ndarray, chunk: int, path: Sequence[tuple[int, int, int, int]], resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """What one chunk of a group adds to the sums of each resample, for values (rows,) or (rows, metrics).

    A resample's draws fall on the chunks by a multinomial law. Each split of the path draws its
    binomial share with a seed of its own, so chunks agree on their counts without seeing each
    other; a chunk then draws that many of its own rows, the same ones for every metric: how often each
    row is drawn as Poisson numbers, which meet all metrics in one product of matrices.
    """
    total = int(weights.sum())
    counts = np.full(resamples, path[0][2] + path[0][3] if path else total)
    for a, b, left, right in path:
        share = np.random.default_rng([seed, 1, a, b]).binomial(counts, left / (left + right)) if left + right else counts * 0
        counts = share if chunk < (a + b) // 2 else counts - share
    out = np.zeros((resamples, *values.shape[1:]))
    if not total:
        return out
    rate, parts, shares = max(0.0, 1 - SLACK / np.sqrt(total)), _parts(weights), weights // np.gcd.reduce(weights)
    # nanoseconds of a resample: a number of a part, a single draw and a table's share, or a binomial number of a row
    taken = sum((3 if w <= LOOKED_UP else 80) * len(some) for w, some in parts.items()) + 10 * SLACK * np.sqrt(total) + 400 * len(parts)
    if taken > 80 * len(values) or shares.sum() > OWNERS:
        rng, step = np.random.default_rng([seed, 2, chunk]), max(1, STEP // len(values))
        for k in range(0, resamples, step):
            out[k : k + step] = rng.multinomial(counts[k : k + step], weights / total) @ values
        return out
    rng = np.random.Generator(np.random.SFC64([seed, 2, chunk]))
    columns = values.reshape(len(values), -1)
    center = weights @ columns / total
    # a row has a number in each of its parts; taken from their mean the values lose nothing to their size
    at = np.concatenate(list(parts.values()))
    weighed, place = (columns - center)[at], np.unique(at, return_index=True)[1]
    tables, owners = [(_poisson_table(rate * w), len(some)) for w, some in parts.items()] if rate else [], np.repeat(place, shares)
    step = max(1, int(STEP / (len(at) + SLACK * np.sqrt(total))))
    for k in range(0, resamples, step):
        n = counts[k : k + step]
        got = _times(rng, len(at), tables, owners, n) @ weighed
        out[k : k + step] = (got + n[:, None] * center).reshape(out[k : k + step].shape)
    return out


def _parts(weights: np.ndarray) -> dict[int, np.ndarray]:
    """Rows by multiples that add up to their weights, each with one law of Poisson numbers.

    A weight that many rows share is one multiple; others are sums of powers of two.
    """
    found, inverse, shared = np.unique(weights, return_inverse=True, return_counts=True)
    own = 16 * shared >= len(weights)
    out = {int(w): [np.flatnonzero(inverse == i)] for i, w in enumerate(found) if own[i]}
    rest = np.where(own[inverse], 0, weights)
    for b in range(int(rest.max()).bit_length()):
        if len(at := np.flatnonzero(rest >> b & 1)):
            out.setdefault(2**b, []).append(at)
    return {w: np.sort(np.concatenate(at)) for w, at in out.items()}


def _poisson_table(rate: float) -> tuple:
    """The rate, the distribution function and numbers by the first 16 random bits, OPEN where these leave them open."""
    if rate > LOOKED_UP:
        return rate, None, None
    k = np.arange(int(rate + 12 * np.sqrt(rate) + 40))
    ends = np.cumsum(np.exp(k * np.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])))
    cells = np.arange((1 << 16) + 1) / (1 << 16)
    first = np.searchsorted(ends, cells[:-1], "right")
    is_open = first != np.searchsorted(ends, cells[1:], "left")
    return rate, ends, np.where(is_open, OPEN, first).astype(np.uint16)


def _poisson(rng: np.random.Generator, table: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Poisson numbers by inversion; a number whose 16 bits leave it open gets 53 more."""
    rate, ends, first = table
    if ends is None:
        return rng.poisson(rate, shape).astype(float)
    size = shape[0] * shape[1]
    bits = rng.integers(0, 1 << 64, -(-size // 4), dtype=np.uint64).view(np.uint16)[:size]
    found = np.take(first, bits)
    rest = np.flatnonzero(found == OPEN)
    out = found.astype(float)
    out[rest] = np.searchsorted(ends, (bits[rest] + rng.random(len(rest))) / (1 << 16), "right")
    return out.reshape(shape)


def _times(rng: np.random.Generator, size: int, tables: list, owners: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of `size` parts of rows is drawn in counts[k] draws of rows with replacement, for each k.

    Poisson numbers given their sum are multinomial. So numbers whose sum is counts[k] at most, filled up by single
    draws, have the law of counts[k] draws whatever the sum was; those that exceed it are thrown away whole.
    A single draw is one of `owners`, in which a row's part stands as often as its weight asks for.
    """

    def numbers(n: int) -> np.ndarray:
        if not tables:
            return np.zeros((n, size))
        got = [_poisson(rng, table, (n, wide)) for table, wide in tables]
        return got[0] if len(got) == 1 else np.concatenate(got, 1)

    out = numbers(len(counts))
    left = counts - out.sum(1).astype(np.int64)
    for _ in range(2):
        if len(over := np.flatnonzero(left < 0)):
            out[over] = numbers(len(over))
            left[over] = counts[over] - out[over].sum(1).astype(np.int64)
    over = left < 0
    out[over], left[over] = 0, counts[over]
    at = owners[rng.integers(0, len(owners), int(left.sum()), dtype=np.uint32)]
    np.add.at(out.reshape(-1), at + np.repeat(np.arange(len(counts)) * size, left), 1.0)
    return out


def intervals(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], order: Sequence[str] = (), most: int = WHOLE, spread: bool = False) -> DataFrame:
    """keys and, for each metric, <metric>_ci95_lo and _hi of its mean: percentiles of 10,000 resamples of all its values.

    A group of up to `most` rows replays numpy's generator over each metric's values in the order of `order`; metrics with
    as many values share one set of draws. A larger one is dealt into chunks of about `most` distinct rows of values by their
    hash, so that equal ones meet and are counted; metrics with values in the same rows share the draws, and every chunk
    adds its part to the sums of the same resamples, with seeds of its own, so no group is gathered whole. Null and NaN are
    missing; without values the bounds are null. Null keys are keys.

    With `spread` n (all rows) and <metric>_mean and _std (population) stand before the bounds; there NaN is a value.
    The rows are counted in one pass; the counts lie in the shared folder, from which they are deleted at the end.
    """
    vs, names = [f"_v{i}" for i in range(len(metrics))], [f"_o{i}" for i in range(len(order))]
    ship(df.sparkSession)
    rows = df.select(*keys, *(F.col(m).cast("double").alias(v) for m, v in zip(metrics, vs)), *(F.col(c).alias(n) for n, c in zip(names, order)))
    with scratch(df.sparkSession, "intervals") as path:
        counted = rows.groupBy(*keys, *vs).agg(F.count("*").alias("_m"))
        counted.write.parquet(path)
        counted = df.sparkSession.read.schema(counted.schema).parquet(path)
        return _intervals(rows, counted, keys, metrics, vs, names, most, spread).checkpoint()  # a row for each group


def _intervals(rows: DataFrame, counted: DataFrame, keys: Sequence[str], metrics: Sequence[str], vs: Sequence[str], names: Sequence[str], most: int, spread: bool) -> DataFrame:
    """The intervals of `rows` (keys, metrics `vs`, order `names`), of which `counted` holds each distinct one with its number _m."""
    kinds = dict(rows.dtypes)
    spec, out = ", ".join(f"`{k}` {kinds[k]}" for k in keys), [f"`{m}_ci95_{e}`" for m in metrics for e in ("lo", "hi")]
    times, times_if = F.col("_m"), lambda c: F.sum(F.when(c, F.col("_m")).otherwise(0))
    number = {v: F.when(~F.isnan(v), F.col(v)).alias(v) for v in vs}
    each = [e for v in vs for e in (times_if(number[v].isNotNull()).alias(f"_n{v}"), times_if(F.col(v).isNotNull()).alias(f"_k{v}"), F.sum(F.col(v) * times).alias(f"_t{v}"))]
    sizes = counted.groupBy(*keys).agg(F.sum("_m").alias("_size"), F.count("*").alias("_distinct"), *each).checkpoint()
    groups, n_small = sizes.agg(F.count("*"), F.count_if(F.col("_size") <= most)).first()
    few = F.broadcast if groups <= GROUPS else (lambda x: x)

    def shared(lists: list) -> dict:
        """Columns by what they must agree on to share draws."""
        found: dict = {}
        for i, x in enumerate(lists):
            found.setdefault(x, []).append(i)
        return found

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [pdf.sort_values([*names, v])[v].dropna().to_numpy(float) for v in vs]
        row: dict = {k: [pdf[k].iloc[0]] for k in keys}
        for at in shared([len(c) for c in columns]).values():
            got = bootstrap_means(np.stack([columns[i] for i in at], 1))
            for j, i in enumerate(at):
                row |= {f"{metrics[i]}_ci95_lo": [got[0, j]], f"{metrics[i]}_ci95_hi": [got[1, j]]}
        return pd.DataFrame(row)[[*keys, *(c.strip("`") for c in out)]]

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        found = [bootstrap_paths(pdf[v].tolist()) for v in vs]
        return pdf[[*keys]].assign(_chunk=pdf["_chunk"], place=range(len(pdf)), paths=[[[x for split in f[k] for x in split] for f in found] for k in range(len(pdf))])

    def sums(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        flat, place = [tuple(map(int, p)) for p in at["paths"].iloc[0]], int(at["place"].iloc[0])
        pdf = pdf.sort_values([*vs, "_m"])
        values, weights, has = pdf[[*vs]].to_numpy(float), pdf["_m"].to_numpy(np.int64), pdf[[*vs]].notna().to_numpy()
        total = np.zeros((RESAMPLES, len(vs)))
        for (path, _), which in shared([(p, has[:, i].tobytes()) for i, p in enumerate(flat)]).items():
            splits, here = np.asarray(path, np.int64).reshape(-1, 4).tolist(), has[:, which[0]]
            total[:, which] = bootstrap_chunk(values[np.ix_(here, which)], weights[here], place, splits)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(total) for k in keys}, "resample": np.arange(len(total)), **{f"s{v}": total[:, i] for i, v in enumerate(vs)}})

    got = []
    if n_small or not groups:
        small = od.same_groups(rows, few(sizes.filter(F.col("_size") <= most).select(*keys)), keys).select(*keys, *number.values(), *names)
        got.append(small.groupBy(*keys).applyInPandas(whole, f"{spec}, " + ", ".join(f"{c} double" for c in out)))
    if n_small < groups:
        large = od.same_groups(counted, few(sizes.filter(F.col("_size") > most).select(*keys, "_distinct")), keys)
        large = large.select(*keys, *number.values(), "_m", "_distinct")
        large = large.select(*keys, F.pmod(F.xxhash64(*vs), F.ceil(F.col("_distinct") / most)).alias("_chunk"), *vs, "_m")
        chunks = large.groupBy(*keys, "_chunk").agg(*(times_if(F.col(v).isNotNull()).alias(v) for v in vs))
        where = chunks.groupBy(*keys).applyInPandas(paths, f"{spec}, _chunk long, place long, paths array<array<long>>")
        # a fixed number of partitions: a chunk is short in bytes and long in work
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = large.repartition(n, *keys, "_chunk").groupBy(*keys, "_chunk").cogroup(where.groupBy(*keys, "_chunk"))
        parts = dealt.applyInPandas(sums, f"{spec}, resample int, " + ", ".join(f"s{v} double" for v in vs))
        means = od.same_groups(parts.groupBy(*keys, "resample").agg(*(F.sum(f"s{v}").alias(f"s{v}") for v in vs)), few(sizes.select(*keys, *(f"_n{v}" for v in vs))), keys)
        # RESAMPLES values a group, whatever its size
        bounds = means.groupBy(*keys).agg(*(F.percentile(F.when(F.col(f"_n{v}") > 0, F.col(f"s{v}") / F.col(f"_n{v}")), [(1 - LEVEL) / 2, (1 + LEVEL) / 2]).alias(v) for v in vs))
        got.append(bounds.select(*keys, *(F.get(v, F.lit(e)).alias(f"{m}_ci95_{name}") for m, v in zip(metrics, vs) for e, name in enumerate(("lo", "hi")))))
    both = got[0].unionByName(got[1]) if len(got) == 2 else got[0]
    both = both.withColumns({c.strip("`"): F.when(~F.isnan(c), F.col(c)) for c in out})
    if not spread:
        return both
    middle = {v: F.when(F.col(f"_k{v}") > 0, F.col(f"_t{v}") / F.col(f"_k{v}")) for v in vs}
    squares = od.same_groups(counted, few(sizes.select(*keys, *(c.alias(f"_c{v}") for v, c in middle.items()))), keys)
    squares = squares.groupBy(*keys).agg(*(F.sum(times * F.pow(F.col(v) - F.col(f"_c{v}"), 2)).alias(f"_q{v}") for v in vs))
    moments = od.same_groups(sizes, squares, keys)
    std = lambda v: F.when(F.col(f"_k{v}") > 0, F.sqrt(F.col(f"_q{v}") / F.col(f"_k{v}")))
    moments = moments.select(*keys, F.col("_size").alias("n"), *(c for m, v in zip(metrics, vs) for c in (middle[v].alias(f"{m}_mean"), std(v).alias(f"{m}_std"))))
    return od.same_groups(moments, both, keys)
