"""Sinks: appends with schema growth, staged overwrites, partitioned summaries, JSON and artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import NOISE_LABELS, lookup
from ..operators.raster import channels_last, entropy_map, inverted
from ..operators.summary import extremes
from . import npy
from .tables import exists


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Append rows; readers merge the columns of all files."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def rewrite(df: DataFrame, path: str, key: str = "patch_id") -> None:
    """Overwrite a table, keeping columns only the stored one has; written beside, then swapped in.

    The stored table is moved aside first and deleted last: if the swap stops between, it lies whole under
    `<path>.before` and the next call puts it back. A key that the stored table repeats is an error; rows of a
    null key get no kept columns.
    """
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path
    there, staged, before = (p(path.rstrip("/") + end) for end in ("", ".staged", ".before"))
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())

    def move(a, b):
        if not fs.rename(a, b):
            raise OSError(f"{a} could not be moved to {b}")

    if fs.exists(before) and not fs.exists(there):
        move(before, there)
    stored = exists(spark, path)
    if stored:
        old = spark.read.parquet(path)
        extra = [c for c in old.columns if c not in df.columns]
        if extra:
            kept = old.filter(F.col(key).isNotNull()).select(key, *extra)
            if kept.groupBy(key).count().filter("count > 1").limit(1).count():
                raise ValueError(f"{path} repeats values of {key}")
            df = df.join(kept, key, "left")
    df.write.mode("overwrite").parquet(str(staged.toString()))
    if stored:
        fs.delete(before, True)
        move(there, before)
    move(staged, there)
    fs.delete(before, True)


def patch_arrays(df: DataFrame, path: str, shape: tuple[int, int, int], variants: Sequence[str] = ("clean",), mask: str | None = "mask", overwrite: bool = False) -> None:
    """Band-major rasters as (height, width, bands) array files and a mask of valid cells as one of gaps, all of a job's files or none.

    df: patch_id, the variants' arrays, the mask, and split and satellite (folders) if it has them.
    """
    h, w, c = shape
    places = [F.col(x) for x in ("split", "satellite") if x in df.columns]
    as_float = lambda x: x.cast("array<float>").alias("values")
    each = [F.struct(F.lit(v).alias("variant"), F.array(*map(F.lit, (h, w, c))).alias("shape"), as_float(channels_last(F.col(v), h * w, c))) for v in variants]
    if mask:
        each.append(F.struct(F.lit("mask").alias("variant"), F.array(F.lit(h), F.lit(w)).alias("shape"), as_float(inverted(F.col(mask)))))
    rows = df.select("patch_id", F.concat_ws("/", *places).alias("folder"), F.explode(F.array(*each)).alias("a"))
    npy.write(rows.select("patch_id", "folder", "a.variant", "a.shape", "a.values"), path, overwrite)


def entropy_maps(df: DataFrame, path: str, shape: tuple[int, int, int], windows: Sequence[int] = (7, 15, 31), resume: bool = True) -> DataFrame:
    """Writes each patch's entropy maps (variants entropy_7, ...) and gives patch_id and the mean of each stored map, mean_entropy_7, ...

    df: patch_id and clean. With `resume` stored maps are kept and not computed again; what is there is
    told from names alone. Without it all maps are written anew.
    """
    spark, (h, w, c) = df.sparkSession, shape
    names = [f"entropy_{n}" for n in windows]
    maps = None
    for n, name in zip(windows, names):
        todo = df.select("patch_id", "clean", F.lit(name).alias("variant"))
        if resume and exists(spark, path):
            todo = todo.join(npy.arrays(spark, path, "patch_id long, variant string"), ["patch_id", "variant"], "left_anti")
        got = todo.select("patch_id", "variant", F.array(F.lit(h), F.lit(w)).alias("shape"), entropy_map(F.col("clean"), n, h, w, c).alias("values"))
        maps = got if maps is None else maps.unionByName(got)
    npy.write(maps, path, overwrite=not resume, dtype="float64")
    mean = F.aggregate("values", F.lit(0.0), lambda s, v: s + v) / F.size("values")
    stored = npy.arrays(spark, path, "patch_id long, variant string, values array<double>").filter(F.col("variant").isin(names))
    wide = stored.select("patch_id", "variant", mean.alias("mean")).groupBy("patch_id").pivot("variant", names).agg(F.first("mean"))
    return wide.withColumnsRenamed({n: f"mean_{n}" for n in names})


def by_noise_label(df: DataFrame, path: str) -> None:
    """Evaluation rows as CSV, one folder for each label of a noise level; other levels keep their own name."""
    df.withColumn("noise", lookup(F.col("noise_level"), NOISE_LABELS)).write.mode("overwrite").option("header", True).partitionBy("noise").csv(path)


def summaries(df: DataFrame, path: str) -> None:
    """A long summary (dimension, metric, ...) in one folder for each dimension and metric."""
    df.write.mode("overwrite").partitionBy("dimension", "metric").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def artifacts(reconstructions: DataFrame, path: str, first: int = 0, top_k: int = 0, score: str = "entropy_score") -> None:
    """Reconstructions to keep: the first patches of each noise level and method under the first seed, and those of extreme entropy.

    Keys are chosen first; arrays take part in the last join only.
    """
    names = ["noise_level", "method", "patch_id", "seed"]
    keys = reconstructions.select(*names, score).distinct() if top_k else reconstructions.select(*names).distinct()
    w = Window.partitionBy("noise_level", "method")
    seeded = keys.withColumn("_seed", F.min("seed").over(w)).filter(F.col("seed") == F.col("_seed"))
    chosen = seeded.withColumn("_n", F.row_number().over(w.orderBy("patch_id"))).filter(F.col("_n") <= first).select(*names)
    if top_k:
        ids = extremes(keys.select("noise_level", "patch_id", score).distinct(), "noise_level", score, top_k).select("noise_level", "patch_id").distinct()
        chosen = chosen.unionByName(keys.select(*names).join(ids, ["noise_level", "patch_id"], "left_semi"))
    kept = reconstructions.join(chosen.distinct(), names, "left_semi").dropDuplicates(names)
    kept.write.mode("overwrite").partitionBy("noise_level", "method").parquet(path)
