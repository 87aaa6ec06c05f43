"""Linear reconstruction models kept as tables: fitted by grouped sums, applied by a join, judged by scenario.

A gap cell is predicted from features of its own raster. A scenario names entropy buckets; its model is fitted on
the training patches in them and evaluated on the test patches in them, at every noise level. All scenarios go through one plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import let, psnr_of_mse
from ..session import ship
from .select import bucket_mask, cutoffs

BROADCAST_MODELS = 50_000  # rows of a few numbers each
FEATURES = ("near", "whole")


def gap_features(degraded: Column, mask: Column, height: int, width: int, bands: int = 1) -> Column:
    """An array with, for each value of a gap cell, its place p and the features near and whole.

    near is the mean of the known cells around it in its band, whole that of all known cells of the band; near is
    whole where none is around. Without a known cell both are 0.
    """
    around = [[(y + dy) * width + x + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and 0 <= y + dy < height and 0 <= x + dx < width] for y in range(height) for x in range(width)]
    near = F.array(*(F.array(*map(F.lit, a)) for a in around))
    known = lambda places: F.filter(places, lambda j: F.get(mask, j) == 0)

    def mean(places: Column, b: Column, other: Column) -> Column:
        total = lambda k: F.aggregate(k, F.lit(0.0), lambda s, j: s + F.get(degraded, j * bands + b).cast("double"))
        return let(known(places), lambda k: F.when(F.size(k) > 0, total(k) / F.size(k)).otherwise(other))

    cells = F.sequence(F.lit(0), F.lit(height * width - 1))
    wholes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: mean(cells, b, F.lit(0.0)))
    places = F.filter(F.sequence(F.lit(0), F.lit(height * width * bands - 1)), lambda p: F.get(mask, F.floor(p / bands).cast("int")) == 1)

    def described(whole: Column) -> Column:
        one = lambda p: let(F.get(whole, p % bands), lambda w: F.struct(p.alias("p"), mean(F.get(near, F.floor(p / bands).cast("int")), p % bands, w).alias("near"), w.alias("whole")))
        return F.transform(places, one)

    return let(wholes, described)


def fit(rows: DataFrame, by: Sequence[str], features: Sequence[str], target: str, ridge: float = 0.0) -> DataFrame:
    """by, n and coefs (the constant first) of least squares in every group.

    The normal equations are sums that are combined before the shuffle; each group's own small system is
    solved where its row lies. Rows that lack a value are left out. A singular system has its shortest solution.
    """
    ship(rows.sparkSession)
    rows = rows.na.drop(subset=[*by, *features, target])
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    k, y = len(x), F.col(target).cast("double")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(k))).alias("xx"), F.array(*(F.sum(v * y) for v in x)).alias("xy"))
    kinds = dict(rows.dtypes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            penalty = ridge * np.diag([0.0] + [1.0] * (k - 1))
            pdf["coefs"] = [np.linalg.lstsq(np.reshape(a, (k, k)) + penalty, np.asarray(b), rcond=None)[0] for a, b in zip(pdf["xx"], pdf["xy"])]
            yield pdf[[*by, "n", "coefs"]].astype({c: object for c in by if kinds[c] == "string"})

    return sums.mapInPandas(solve, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, coefs array<double>")


def predict(rows: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], out: str = "rec") -> DataFrame:
    """rows with their group's prediction; rows of groups without a model are dropped. Models are broadcast if they were counted to be few."""
    few = F.broadcast if models.count() <= BROADCAST_MODELS else (lambda x: x)
    got = rows.join(few(models.select(*by, "coefs")), list(by))
    value = F.get("coefs", F.lit(0))
    for i, c in enumerate(features, 1):
        value = value + F.get("coefs", F.lit(i)) * F.col(c)
    return got.withColumn(out, value).drop("coefs")


def in_scenarios(patches: DataFrame, bounds: DataFrame, scenarios: Mapping[str, Sequence[str] | None], column: str, out: str = "entropy_scenario") -> DataFrame:
    """Each patch once for every scenario whose buckets hold its value; a scenario of None holds all patches.

    bounds: satellite, lo and hi, one row a satellite.
    """
    v = F.col(column)
    holds = lambda names: F.lit(True) if names is None else F.coalesce(bucket_mask(v, F.col("lo"), F.col("hi"), names), F.lit(False))
    named = F.array(*(F.struct(F.lit(k).alias("name"), holds(b).alias("holds")) for k, b in scenarios.items()))
    met = patches.join(F.broadcast(bounds), "satellite", "left")
    return met.withColumn(out, F.explode(F.transform(F.filter(named, lambda s: s["holds"]), lambda s: s["name"]))).select(*patches.columns, out)


def run_scenarios(patches: DataFrame, scenarios: Mapping[str, Sequence[str] | None], shape: tuple[int, int, int], column: str = "entropy_7", train_noise: str = "inf", name: str = "linear") -> DataFrame:
    """Evaluation rows of a linear model for each scenario, noise level and test patch.

    patches: patch_id, satellite, split, noise_level, the entropy column, clean, degraded and mask. Cutoffs are those of the
    training patches of a satellite. A model is fitted on rows of `train_noise` and applied at every noise level; predictions are
    clipped to [0, 1]. A test patch without gaps has rmse 0 and an infinite psnr; a scenario without training rows has no rows.
    """
    h, w, c = shape
    train = patches.filter((F.col("split") == "train") & (F.col("noise_level") == train_noise))
    bounds = cutoffs(train, column, by=["satellite"])
    keys = ["entropy_scenario", "noise_level", "satellite", "patch_id", column]

    def pixels(part: DataFrame) -> DataFrame:
        chosen = in_scenarios(part, bounds, scenarios, column)
        gaps = F.explode(gap_features(F.col("degraded"), F.col("mask"), h, w, c)).alias("g")
        return chosen.select(*keys, "clean", gaps).select(*keys, F.get("clean", F.col("g.p")).cast("double").alias("clean"), *(F.col(f"g.{f}").alias(f) for f in FEATURES))

    models = fit(pixels(train), ["entropy_scenario"], FEATURES, "clean")
    tests = patches.filter("split = 'test'")
    rec = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rec")))
    errors = predict(pixels(tests), models, ["entropy_scenario"], FEATURES).withColumn("e", F.col("clean") - rec)
    found = errors.groupBy(*keys).agg((F.count("*") / F.lit(float(h * w * c))).alias("gap_fraction"), F.avg(F.col("e") * F.col("e")).alias("mse"))
    whole = in_scenarios(tests.filter(~F.exists("mask", lambda m: m == 1)), bounds, scenarios, column).join(models.select("entropy_scenario"), "entropy_scenario", "left_semi")
    every = found.unionByName(whole.select(*keys, F.lit(0.0).alias("gap_fraction"), F.lit(0.0).alias("mse")))
    more = [F.lit(name).alias("method"), F.lit("linear model").alias("method_category"), F.lit("ok").alias("status")]
    return every.select(*keys, *more, "gap_fraction", F.sqrt("mse").alias("rmse"), psnr_of_mse(F.col("mse")).alias("psnr"))
