"""Grouped least squares, gap features and the scenario driver against numpy."""

import numpy as np
from pyspark.sql import functions as F

from gapweave.operators import models, stats
from gapweave.plans.evaluate import local_entropy  # noqa: F401  same rasters, other statistics


def test_fit_and_predict_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, *map(float, x), float(2 + x[0] * k - 3 * x[1] + rng.normal())) for k, g in enumerate(("a", "b", "c")) for x in rng.normal(size=(50, 2))] + [("d", 1.0, 2.0, 5.0), ("a", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, z double, y double")
    table = models.fit(df, ["g"], ["x", "z"], "y")
    got = {r["g"]: (r["n"], r["coefs"]) for r in table.collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"][0] == 50
    for g in "abcd":
        m = np.array([(1.0, r[1], r[2]) for r in rows if r[0] == g and None not in r])
        y = np.array([r[3] for r in rows if r[0] == g and None not in r])
        assert np.allclose(m @ got[g][1], m @ np.linalg.lstsq(m, y, rcond=None)[0], atol=1e-8)
    pred = models.predict(df, table, ["g"], ["x", "z"]).filter("g = 'b'").collect()
    assert all(abs(r["rec"] - np.dot(got["b"][1], (1, r["x"], r["z"]))) < 1e-12 for r in pred)


def features(d, mask):
    h, w, c = d.shape
    out = []
    for y in range(h):
        for x in range(w):
            for b in range(c):
                if mask[y, x]:
                    known = d[:, :, b][mask == 0]
                    whole = known.mean() if len(known) else 0.0
                    around = [d[j, i, b] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if not mask[j, i]]
                    out.append(((y * w + x) * c + b, np.mean(around) if around else whole, whole))
    return out


def test_gap_features_of_several_bands(spark):
    rng = np.random.default_rng(2)
    cases = [(rng.random((4, 5, 3)), rng.random((4, 5)) < p) for p in (0.0, 0.4, 0.9, 1.0)]
    df = spark.createDataFrame([(k, d.ravel().tolist(), m.astype(int).ravel().tolist()) for k, (d, m) in enumerate(cases)], "k int, d array<double>, m array<int>")
    for r in df.select("k", models.gap_features(F.col("d"), F.col("m"), 4, 5, 3).alias("g")).collect():
        want = features(cases[r["k"]][0], cases[r["k"]][1].astype(int))
        assert len(want) == len(r["g"]) and np.allclose([tuple(g) for g in r["g"]] or [()], want or [()])


def test_scenarios_of_unknown_entropy_and_patches_without_gaps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(24):
        v = rng.random(16)
        mask = [0] * 16 if k == 23 else (rng.random(16) < 0.4).astype(int).tolist()
        rows.append((k, "s", "train" if k < 18 else "test", "inf", None if k == 22 else float(k % 6), v.tolist(), v.tolist(), mask))
    df = spark.createDataFrame(rows, "patch_id long, satellite string, split string, noise_level string, entropy_7 double, clean array<double>, degraded array<double>, mask array<int>")
    got = {(r["entropy_scenario"], r["patch_id"]): r for r in models.run_scenarios(df, {"low": ["low"], "all": None, "none": []}, (4, 4, 1)).collect()}
    assert {k for k in got if k[0] == "all"} == {("all", k) for k in range(18, 24)} and {k[1] for k in got if k[0] == "low"} == {18, 19}  # entropies 0 and 1 of 0..5
    assert got["all", 23]["rmse"] == 0 and got["all", 23]["psnr"] == float("inf") and got["all", 23]["gap_fraction"] == 0
    assert got["all", 22]["entropy_7"] is None and 0 < got["all", 22]["rmse"] < 1


def test_pseudo_p_of_constant_rasters_and_gaps(spark):
    rng = np.random.default_rng(4)
    values = {1: np.full(25, 0.5), 2: rng.random(25), 3: np.repeat(np.arange(5.0), 5)}
    rows = [(k, i // 5, i % 5, float(v[i]), int(i % 3 == 0)) for k, v in values.items() for i in range(25)]
    px = spark.createDataFrame(rows, "patch_id long, y int, x int, v double, gap int")
    whole = {r["patch_id"]: r for r in stats.global_p(px, 5, 5, 99).collect()}
    assert whole[1]["p"] == 1 and whole[1]["moran_i"] == 0 and whole[3]["p"] == 0.01 and whole[2]["p"] > 0.01
    cells = {(r["patch_id"], r["y"], r["x"]): r for r in stats.local_p(px, 5, 25, 99).collect()}
    assert len(cells) == 75 and all(r["p"] == 1 and r["quadrant"] == 0 for k, r in cells.items() if k[0] == 1) and cells[3, 4, 2]["p"] < 0.1
    gaps = {r["patch_id"]: r for r in stats.global_p(px, 5, 5, 99, gap="gap").collect()}
    moran = {r["patch_id"]: r["moran_i"] for r in stats.moran(px, gap="gap").collect()}
    assert all(abs(gaps[k]["moran_i"] - moran[k]) < 1e-12 for k in (2, 3))
