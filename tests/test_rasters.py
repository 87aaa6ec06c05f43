"""Array expressions for nearest cells and local entropy against plain numpy; artifact choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import raster
from gapweave.plans.evaluate import local_entropy
from gapweave.sources import sinks


def nearest(mask, radius=None):
    h, w = mask.shape
    known = [(y, x) for y in range(h) for x in range(w) if not mask[y, x]]
    out = []
    for y in range(h):
        for x in range(w):
            d, ky, kx = min((((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in known), default=(None, 0, 0))
            out.append(None if d is None or (radius is not None and mask[y, x] and d > radius * radius) else ky * w + kx)
    return out


@pytest.mark.parametrize("radius", [None, 2.0])
def test_nearest_cells_of_all_kinds_of_masks(spark, radius):
    rng = np.random.default_rng(3)
    masks = [rng.random((5, 9)) < p for p in (0.0, 0.3, 0.6, 0.9, 0.97)] + [np.ones((5, 9), bool)]
    values = [rng.random((5, 9, 2)) for _ in masks]
    df = spark.createDataFrame([(k, m.astype(int).ravel().tolist(), v.ravel().tolist()) for k, (m, v) in enumerate(zip(masks, values))], "k int, mask array<int>, v array<double>")
    rows = df.select("k", raster.nearest_cells(F.col("mask"), 5, 9, radius).alias("at"), raster.nearest_fill(F.col("v"), F.col("mask"), 5, 9, 2, radius).alias("filled")).collect()
    for r in rows:
        want = nearest(masks[r["k"]], radius)
        assert r["at"] == want
        flat = values[r["k"]].reshape(-1, 2)
        assert np.allclose(np.array(r["filled"]).reshape(-1, 2), [flat[i if j is None else j] for i, j in enumerate(want)])


@pytest.mark.parametrize("window, bands", [(1, 1), (3, 2), (5, 1), (31, 3)])
def test_entropy_maps_equal_summed_tables(spark, window, bands):
    rng = np.random.default_rng(window)
    patches = [rng.random((7, 10, bands)), np.full((7, 10, bands), 0.4), (rng.random((7, 10, bands)) * 3).round()]
    df = spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(patches)], "k int, v array<double>")
    got = {r["k"]: r["m"] for r in df.select("k", raster.entropy_map(F.col("v"), window, 7, 10, bands).alias("m")).collect()}
    for k, p in enumerate(patches):
        assert np.allclose(got[k], local_entropy(p.mean(2), window).ravel(), atol=1e-12)
    with pytest.raises(ValueError):
        raster.entropy_map(F.col("v"), 4, 7, 10)


def test_stored_entropy_maps_are_kept_on_resume(spark, tmp_path):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, rng.random(36).tolist()) for k in range(6)], "patch_id long, clean array<double>")
    root = str(tmp_path / "maps")
    sinks.entropy_maps(df.filter("patch_id < 3"), root, (6, 6, 1), [3])
    np.save(f"{root}/0000001_entropy_3.npy", np.full((6, 6), 9.0))  # told apart from a computed one
    got = {r["patch_id"]: r["mean_entropy_3"] for r in sinks.entropy_maps(df, root, (6, 6, 1), [3]).collect()}
    want = {r["patch_id"]: local_entropy(np.array(r["clean"]).reshape(6, 6), 3).mean() for r in df.collect()}
    assert all(abs(got[k] - (9.0 if k == 1 else want[k])) < 1e-12 for k in want)
    assert abs(sinks.entropy_maps(df, root, (6, 6, 1), [3], resume=False).filter("patch_id = 1").first()[1] - want[1]) < 1e-12


def test_artifacts_are_chosen_by_key(spark, tmp_path):
    rows = [(s, n, m, p, float((p * 7) % 20), [float(p)]) for s in (42, 43) for n in ("inf", "40") for m in ("idw", "dct") for p in range(20)]
    df = spark.createDataFrame(rows, "seed int, noise_level string, method string, patch_id long, entropy_score double, reconstruction array<double>")
    sinks.artifacts(df, str(tmp_path / "a"), first=2, top_k=1)
    got = spark.read.parquet(str(tmp_path / "a"))
    keys = {(r["seed"], r["noise_level"], r["method"], r["patch_id"]) for r in got.collect()}
    high, low = 17, 0  # the scores 19 and 0
    assert keys == {(s, n, m, p) for s in (42, 43) for n in ("inf", "40") for m in ("idw", "dct") for p in ({0, 1, high, low} if s == 42 else {high, low})} and got.count() == len(keys)
