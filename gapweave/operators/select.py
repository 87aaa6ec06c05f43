"""Filters, entropy buckets, sampling, splits and work lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ConfigError
from ..schemas import NOISE_LEVELS
from . import order

BUCKETS = ("low", "medium", "high")


def only(df: DataFrame, split: str | None = None, satellite: str | None = None) -> DataFrame:
    """Rows of a split and a satellite; None takes all."""
    for name, value in (("split", split), ("satellite", satellite)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def bucket_names(names: Iterable[str]) -> list[str]:
    """Names without case and outer spaces; unknown ones are an error."""
    out = [str(n).strip().lower() for n in names]
    if bad := sorted(set(out) - set(BUCKETS)):
        raise ConfigError(f"unknown entropy buckets: {', '.join(bad)}")
    return out


def bucket_mask(value: Column, low: Column | float, high: Column | float, names: Iterable[str]) -> Column:
    """True where the value lies in any of the buckets: low <= lo < medium <= hi < high."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    tests = {"low": value <= low, "medium": (value > low) & (value <= high), "high": value > high}
    out = F.lit(False)
    for n in bucket_names(names):
        out = out | tests[n]
    return out


def cutoffs(df: DataFrame, column: str, quantiles: Sequence[float] = (1 / 3, 2 / 3), by: Sequence[str] = ()) -> DataFrame:
    """One row (for each group of `by`) with the exact, linearly interpolated quantiles lo and hi; none without values."""
    q = order.quantiles(df, column, quantiles, by)
    return q.select(*by, F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))


def in_buckets(df: DataFrame, column: str, bounds: DataFrame, names: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value lies in the buckets; bounds has lo and hi, one row or one a group."""
    # bounds is one row, or one a satellite: its size does not follow the input
    joined = df.join(F.broadcast(bounds), list(by)) if by else df.crossJoin(F.broadcast(bounds))
    return joined.filter(F.col(column).isNotNull() & bucket_mask(F.col(column), F.col("lo"), F.col("hi"), names)).select(*df.columns)


def in_buckets_text(df: DataFrame, column: str, low: float, high: float, names: Iterable[str]) -> DataFrame:
    """The same for text columns: values that are no numbers are skipped, unknown buckets ignored."""
    known = [n for n in (str(x).strip().lower() for x in names) if n in BUCKETS]
    return df.filter(bucket_mask(F.expr(f"try_cast({column} as double)"), low, high, known))


def terciles(df: DataFrame, column: str, out: str, labels: Sequence[str] = BUCKETS) -> DataFrame:
    """Right-closed bins at the data's own terciles, with bin_ord to sort by; null values are dropped."""
    bounds = F.broadcast(cutoffs(df, column))  # one row
    v = F.col(column)
    ordinal = F.when(v <= F.col("lo"), 0).when(v <= F.col("hi"), 1).otherwise(2)
    df = df.filter(v.isNotNull()).crossJoin(bounds).withColumn("bin_ord", ordinal).drop("lo", "hi")
    return df.withColumn(out, F.get(F.array(*map(F.lit, labels)), F.col("bin_ord")))


def available(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, n) of the metrics with any value, in one pass."""
    have = [m for m in metrics if m in df.columns]
    counts = df.agg(*(F.count(m).alias(m) for m in have))
    return counts.unpivot([], have, "metric", "n").filter("n > 0")


def valid_rows(df: DataFrame, cells: int, clean: str = "clean", mask: str = "mask") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): arrays of the right size, mask of 0 and 1, no NaN in clean."""
    good = (F.size(clean) == cells) & (F.size(mask) == cells) & F.forall(mask, lambda m: m.isin(0, 1)) & ~F.exists(clean, lambda v: F.isnan(v) | v.isNull())
    good = F.coalesce(good, F.lit(False))
    return df.filter(good), df.filter(~good)


def noise_rows(manifest: DataFrame, keep: Sequence[str] = ("patch_id", "satellite")) -> DataFrame:
    """One row for each patch and noise level, with the path of the degraded raster."""
    wide = manifest.select(*keep, *(F.col(f"degraded_{n}_path").alias(n) for n in NOISE_LEVELS))
    return wide.unpivot(list(keep), list(NOISE_LEVELS), "noise_level", "degraded_path").filter("degraded_path is not null")


def work_list(patches: DataFrame, methods: DataFrame, noises: DataFrame) -> DataFrame:
    """Every patch with every method and noise level; the two lists come from the configuration."""
    return patches.crossJoin(F.broadcast(noises)).crossJoin(F.broadcast(methods))


def remaining(tasks: DataFrame, done: DataFrame, keys: Sequence[str] = ("seed", "noise_level", "method", "patch_id"), retry_errors: bool = False) -> DataFrame:
    """Tasks that have no row yet; failed rows count as done unless they are to be retried."""
    if retry_errors:
        done = done.filter("status <> 'error'")
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_seed(selections: DataFrame) -> DataFrame:
    """satellite, patch_id and the seed that names the patch first (by seed_pos)."""
    return selections.groupBy("satellite", "patch_id").agg(F.min_by("seed", "seed_pos").alias("seed"))


def outside(selections: DataFrame, train: DataFrame) -> DataFrame:
    """Stored selections (satellite, patch_id) that are no training patches; a valid selection has none."""
    return selections.select("satellite", "patch_id").distinct().join(train.select("satellite", "patch_id").distinct(), ["satellite", "patch_id"], "left_anti")


def hash_split(df: DataFrame, key: str, by: str, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Stratified train, val and test by the order of a hash within each stratum; the rest is test.

    The sizes are exact; places come from counts by ranges of the hash, so no stratum is one task.
    """
    placed = order.hash_places(df, [by], F.concat_ws("|", F.col(by), F.col(key).cast("string")), key)
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    a = F.floor(F.col("_n") * shares[0])
    b = a + F.floor(F.col("_n") * shares[1])
    split = F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "val").otherwise("test")
    return order.same_groups(placed, sizes, [by]).withColumn("split", split).select(*df.columns, "split")


def sample_ids(df: DataFrame, by: str, most: int, seed: int = 42, key: str = "patch_id") -> DataFrame:
    """by, key and draw (from 0): at most `most` ids of each group, drawn without replacement in the order of a seeded hash.

    Any engine with SHA-256 makes the same draw. Ids are placed by counts of hash ranges, so no group is
    gathered or sorted whole, whatever `most` is.
    """
    ids = df.select(by, key).distinct()
    placed = order.hash_places(ids, [by], F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), key)
    return placed.filter(F.col("place") <= most).select(by, key, (F.col("place") - 1).alias("draw"))


def spawned(seeds: Sequence[int]) -> list[int]:
    """An independent seed for the draw of each seed."""
    return [int(child.generate_state(1)[0]) for child in np.random.SeedSequence(list(seeds)).spawn(len(seeds))]


def patch_plan(train: DataFrame, seeds: Sequence[int], most: int | None = None) -> DataFrame:
    """satellite, patch_id and seed of every patch to evaluate, each once, under the first seed that draws it.

    Without a cap all patches come under the first seed. With one, each seed draws at most
    `most` patches a satellite; seeds of the draws are spawned, so they are independent.
    """
    if most is None:
        return train.select("satellite", "patch_id").distinct().withColumn("seed", F.lit(int(seeds[0])))
    draws = None
    for pos, (seed, drawn) in enumerate(zip(seeds, spawned(seeds))):
        got = sample_ids(train, "satellite", most, drawn).select("satellite", "patch_id", F.lit(int(seed)).alias("seed"), F.lit(pos).alias("seed_pos"))
        draws = got if draws is None else draws.unionByName(got)
    return first_seed(draws)


def grid(spark, parameters: dict[str, Sequence]) -> DataFrame:
    """The cartesian product of parameter lists, one row a combination, with sorted-key JSON."""
    df = spark.range(1).select()
    for name, values in parameters.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df.withColumn("params", F.to_json(F.struct(*sorted(parameters))))
