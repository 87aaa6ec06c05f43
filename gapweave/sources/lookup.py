"""Stored files found by key in several places, the first place that has one first; only chosen files are opened."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import png
from ..session import ship
from . import npy


def resolve(wanted: DataFrame, keys: Sequence[str], places: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """wanted with source and path of the first place that lists its keys, both null where none does.

    places: (name, listing with the keys, or some of them, and path) by rank. Each level takes what the ones before have not found.
    A key listed twice in a place takes the least path.
    """
    out, left = None, wanted
    for name, listing in places:
        on = [k for k in keys if k in listing.columns]
        first = listing.groupBy(*on).agg(F.min("path").alias("path"))
        hit = left.join(first, on).select(*wanted.columns, F.lit(name).alias("source"), "path")
        out = hit if out is None else out.unionByName(hit)
        left = left.join(first, on, "left_anti")
    none = left.select(*wanted.columns, F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("path"))
    return none if out is None else out.unionByName(none)


def listing(spark: SparkSession, root: str, folders: Sequence[str], suffix: str = ".npy") -> DataFrame:
    """path, patch_id and the named levels of folders of the files below a root; none if there is no such folder."""
    files = npy.arrays(spark, root, "path string, folder string, patch_id long", suffix=suffix)
    parts = F.split("folder", "/")
    return files.filter(F.size(parts) == len(folders)).select("path", "patch_id", *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(folders)))


def load(found: DataFrame) -> DataFrame:
    """found with shape, values and error of the file at path: arrays as they are, images as the first three channels in [0, 1]."""
    ship(found.sparkSession)
    extra = "shape array<int>, values array<float>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    if path is None:
                        rows.append((None, None, None))
                        continue
                    fs, at = npy.opened(path)
                    with fs.open_input_file(at) as file:
                        if path.endswith(".png"):
                            a = png.decode(file.readall())[:, :, :3] / np.float32(255)
                        else:
                            dtype, shape, columns_first, _ = npy.header(file)
                            a = np.frombuffer(file.readall(), dtype).reshape(shape, order="F" if columns_first else "C")
                    rows.append((list(a.shape), a.astype(np.float32).ravel(), None))
                except (OSError, ValueError, SyntaxError, KeyError, TypeError) as e:  # the file's own fault is its row
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(shape=[r[0] for r in rows], values=[r[1] for r in rows], error=pd.Series([r[2] for r in rows], dtype=object, index=pdf.index)).astype(dict.fromkeys(texts, object))

    texts = [c for c, t in found.dtypes if t == "string"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return found.mapInPandas(run, f"{kinds}, {extra}")


def reconstructions(wanted: DataFrame, root: str) -> DataFrame:
    """Reconstructions of (noise_level, method, patch_id): the array of the noise level, else the image of the method, else nulls."""
    spark = wanted.sparkSession
    arrays = listing(spark, f"{root}/reconstruction_arrays", ["noise_level", "method"])
    images = listing(spark, f"{root}/reconstruction_images", ["method"], ".png")
    return load(resolve(wanted, ["noise_level", "method", "patch_id"], [("array", arrays), ("image", images)]))
