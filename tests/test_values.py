"""Values of operators that SQL cannot express, against versions written anew from their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave import catalog
from gapweave.functions import scalars
from gapweave.operators import fills, raster, stats, summary
from gapweave.plans import evaluate as ev

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def patch():
    rng = np.random.default_rng(3)
    clean = rng.random((9, 8))
    mask = rng.random((9, 8)) < 0.3
    return np.where(mask, 0, clean), mask


def test_tv_is_the_stated_iteration(patch):
    v, mask = patch
    h, w = v.shape
    for weight in (0.1, 2.0):
        data = np.where(mask, v[~mask].mean(), v)
        x, bar, px, py = data.copy(), data.copy(), np.zeros((h, w)), np.zeros((h, w))
        for _ in range(30):
            for i in range(h):
                for j in range(w):
                    px[i, j] += 0.125 * (bar[i, j + 1] - bar[i, j] if j + 1 < w else 0)
                    py[i, j] += 0.125 * (bar[i + 1, j] - bar[i, j] if i + 1 < h else 0)
                    size = max(1.0, math.hypot(px[i, j], py[i, j]))
                    px[i, j] /= size
                    py[i, j] /= size
            new = np.zeros((h, w))
            for i in range(h):
                for j in range(w):
                    div = (px[i, j] if j + 1 < w else 0) - (px[i, j - 1] if j else 0) + (py[i, j] if i + 1 < h else 0) - (py[i - 1, j] if i else 0)
                    y = x[i, j] + 0.125 * div
                    new[i, j] = y if mask[i, j] else (y + 0.125 * weight * data[i, j]) / (1 + 0.125 * weight)
            x, bar = new, 2 * new - x
        assert np.allclose(fills.tv(v, mask, weight, 30), x)


def test_lanczos_stops_by_the_gaps(patch):
    v, mask = patch
    few = np.zeros_like(mask)
    few[4, 4] = True
    v = np.where(few, 0, np.random.default_rng(0).random(v.shape))
    low = np.outer(*(np.clip((4 / 6 - np.abs(np.fft.fftfreq(n))) * 3, 0, 1) for n in v.shape))
    x, steps = fills.nearest(v, few), 0
    while True:
        y = np.where(few, np.fft.ifft2(np.fft.fft2(x) * low).real, v)
        change, x, steps = abs(y[4, 4] - x[4, 4]), y, steps + 1
        if change < 1e-3:
            break
    assert steps < 50 and np.allclose(fills.lanczos(v, few, tolerance=1e-3), x)


@pytest.mark.parametrize("window, reach", [(1, 1), (2, 1), (3, 1), (7, 3), (None, 20)])
def test_local_points(window, reach):
    mask = np.zeros((20, 20), bool)
    mask[9:11, 8:12] = True
    got = {tuple(p) for p in fills.local_points(mask, window)}
    assert got == {(i, j) for i in range(20) for j in range(20) if not mask[i, j] and 9 - reach <= i <= 10 + reach and 8 - reach <= j <= 11 + reach}
    assert len(fills.local_points(mask, None, 10)) == 10
    alone = np.ones((5, 5), bool)
    alone[0, 0] = alone[4, 4] = False
    assert len(fills.local_points(alone, 1)) == 2


def test_rasters_without_known_pixels():
    v, mask = np.full((6, 6), 0.25), np.ones((6, 6), bool)
    for name, m in fills.METHODS.items():
        if name == "non_local":
            with pytest.raises(Exception):
                m.apply(v, mask)
        elif name in {n for c in fills.categories().values() for n in c}:
            assert (m.apply(v, mask) == 0.25).all()


def test_dct_is_the_stated_iteration(patch):
    v, mask = patch
    h, w = v.shape
    scale = lambda k, n: math.sqrt((1 if k == 0 else 2) / n)
    wave = [[np.array([[scale(a, h) * scale(b, w) * math.cos(math.pi * (i + 0.5) * a / h) * math.cos(math.pi * (j + 0.5) * b / w) for j in range(w)] for i in range(h)]) for b in range(w)] for a in range(h)]
    x = np.where(mask, v[~mask].mean(), v)
    for _ in range(5):
        c = np.array([[(wave[a][b] * x).sum() for b in range(w)] for a in range(h)])
        t = 0.05 * np.abs(c).max()
        c = np.sign(c) * np.maximum(np.abs(c) - t, 0)
        x = np.where(mask, sum(c[a, b] * wave[a][b] for a in range(h) for b in range(w)), v)
    assert np.allclose(fills.dct(v, mask, iterations=5, tolerance=0), x)


def test_rbf_solves_the_kernel_system(patch):
    v, mask = patch
    known, gaps = np.argwhere(~mask), np.argwhere(mask)
    phi = lambda a, b: (d := math.dist(a, b)) and d * d * math.log(d)
    tail = lambda p: [1.0, p[0], p[1]]
    n = len(known)
    a = np.zeros((n + 3, n + 3))
    for i in range(n):
        for j in range(n):
            a[i, j] = phi(known[i], known[j])
        a[i, n:] = a[n:, i] = tail(known[i])
    c = np.linalg.solve(a, np.append(v[~mask], [0, 0, 0]))
    want = [sum(c[i] * phi(g, known[i]) for i in range(n)) + np.dot(c[n:], tail(g)) for g in gaps]
    assert np.allclose(fills.rbf(v, mask)[mask], want, atol=1e-8) and np.allclose(fills.spline(v, mask)[mask], want, atol=1e-8)


def test_idw_of_pixels_equals_that_of_arrays(spark, patch):
    v, mask = patch
    rows = [(0, i, j, 0, float(v[i, j]), int(mask[i, j])) for i in range(9) for j in range(8)]
    px = spark.createDataFrame(rows, "patch_id long, y int, x int, b int, v double, gap int")
    for radius in (None, 1, 2):
        got = np.zeros(v.shape)
        for r in raster.fill_idw(px, radius=radius).collect():
            got[r["y"], r["x"]] = r["rec"]
        assert np.allclose(got, fills.idw(v, mask, radius=radius))


def test_six_digits(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 0.0001, 0.00001234567, -9.9999996e5, 999999.6, 1e300, 3.14159265, 100.0, -0.1, 1e-7, 12.5, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r["t"] for r in df.select("k", scalars.six_digits(F.col("v")).alias("t")).orderBy("k").collect()]
    assert got == ["none" if v is None else f"{v:.6g}" for v in values]


def test_run_summary_counts_times_of_ok_rows(spark):
    rows = [("a", "ok", 1.0, 10.0), ("a", "ok", 3.0, 20.0), ("a", "error", 6.0, None), ("a", None, 0.0, 1.0), ("b", "error", 2.0, None)]
    df = spark.createDataFrame(rows, "m string, status string, elapsed_s double, psnr double")
    got = {r["m"]: r for r in summary.run_summary(df, ["m"], ["psnr"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["n_rows"], a["n_ok"], a["n_error"], a["error_rate"], a["mean_elapsed"], a["throughput"], a["psnr_mean"]) == (4, 2, 2, 0.5, 2.0, 0.2, 15.0)
    assert abs(a["p95_elapsed"] - 2.9) < 1e-12 and (b["mean_elapsed"], b["p95_elapsed"], b["throughput"], b["psnr_mean"]) == (0, 0, 0, None)
    assert summary.run_summary(df, ["m"], [], 4.0).filter("m = 'a'").first()["throughput"] == 0.5


def test_moran_over_gap_cells_and_without_spread(spark):
    rng = np.random.default_rng(1)
    v, mask = rng.random((6, 5)), rng.random((6, 5)) < 0.6
    rows = [(k, i, j, float(v[i, j]) if k else float(i % 2), int(mask[i, j])) for k in (0, 1) for i in range(6) for j in range(5)]
    px = spark.createDataFrame(rows, "patch_id long, y int, x int, v double, gap int")
    got = {r["patch_id"]: r for r in stats.moran(px, gap="gap").collect()}
    assert got[0]["moran_i"] == got[0]["expected_i"] == 0
    w = np.where(mask, v, v[mask].mean())
    z, total = w - w.mean(), 0.0
    for i in range(6):
        for j in range(5):
            near = [z[a, b] for a in range(max(0, i - 1), min(6, i + 2)) for b in range(max(0, j - 1), min(5, j + 2)) if (a, b) != (i, j)]
            total += z[i, j] * sum(near) / len(near)
    assert abs(got[1]["moran_i"] - total / (z * z).sum()) < 1e-9
    got = stats.moran_permutation(v, mask)
    assert abs(got["i"] - total / (z * z).sum()) < 1e-9 and ((got["local_p"] > 0) & (got["local_p"] <= 0.5005)).all()
    assert stats.moran_permutation(np.tile([0.0, 1.0], (4, 2)))["p"] == 1.0


def test_local_p_holds_its_cell_fixed():
    v = np.zeros((7, 7))
    v[2:5, 2:5], v[0, 0], v[6, 6] = 5.0, 1.0, 2.0
    got = stats.moran_permutation(v, permutations=499)
    # the centre's eight neighbours are all of the other high cells: hardly any deal puts them there
    assert got["local_p"][3, 3] == 1 / 500 and got["labels"][3, 3] == 1


def test_resume_runs_only_what_is_missing(spark):
    row = (0, "inf", 1, "s", 0.2, [0.5] * 16, [0.5] * 16, [0.0] * 15 + [1.0], ["idw"])
    kind = "seed int, noise_level string, patch_id long, satellite string, gap_fraction double, clean array<float>, degraded array<float>, mask array<float>, wanted array<string>"
    df = spark.createDataFrame([row], kind)
    assert [r["method"] for r in ev.evaluate(df, ["nearest", "idw", "dct"], (4, 4, 1)).collect()] == ["idw"]
    done = spark.createDataFrame([(0, "inf", "nearest", 1, "ok")], "seed int, noise_level string, method string, patch_id long, status string")
    got = ev.resume(df.drop("wanted"), done, ["nearest", "idw", "dct"], (4, 4, 1)).collect()
    assert sorted(r["method"] for r in got) == ["dct", "idw"]


@pytest.mark.parametrize("name", [n for n in fills.METHODS if n not in ("nearest", "idw")])
def test_fill_queries_hold_the_metrics_of_their_method(spark, name):
    from gapweave.plans import rasters

    rows = {r["patch_id"]: r for r in rasters._rows(spark, SF).limit(8).collect()}
    got = {r["patch_id"]: r for r in catalog.queries()[f"fill_{name}"](spark, SF).collect()}
    for i, p in rows.items():
        clean, degraded, mask = (np.asarray(p[c], np.float32).reshape(8, 8) for c in ("clean", "degraded", "mask"))
        filled = fills.METHODS[name].apply(degraded, mask != 0)
        e = (clean - filled).astype(float)[mask != 0]
        assert got[i]["status"] == "ok" and abs(got[i]["rmse"] - math.sqrt((e * e).mean())) < 1e-6


def test_samples_are_bounded_and_whole_below(spark):
    got = catalog.queries()["sample_ids"](spark, SF).collect()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1])
    assert by and all(0 < len(v) <= 30 and len(set(v)) == len(v) for v in by.values())
    assert sorted(map(str, got)) == sorted(map(str, catalog.queries()["sample_ids"](spark, SF).collect()))


def test_executors_get_the_package(spark):
    from gapweave.session import ship

    ship(spark)
    assert any("gapweave.zip" in str(f) for f in spark.sparkContext.listFiles)


@pytest.mark.parametrize("model", sorted(fills.RISES))
def test_every_variogram_keeps_known_pixels_and_smooth_fields(model):
    y, x = np.mgrid[:7, :7] / 6
    clean, mask = 0.5 + 0.3 * np.sin(2 * x) * np.cos(y), np.random.default_rng(5).random((7, 7)) < 0.3
    got = fills.kriging(np.where(mask, 0, clean), mask, model=model)
    assert np.array_equal(got[~mask], clean[~mask]) and np.abs(got - clean)[mask].mean() < 0.05


def test_unknown_variogram_is_an_error(patch):
    with pytest.raises(fills.MethodError):
        fills.kriging(*patch, model="cubic")


def test_variogram_finds_the_slope_of_a_line():
    points = np.stack([np.arange(40.0), np.zeros(40)], 1)
    nugget, slope, _ = fills.variogram(points, points[:, 0], 6, "linear")
    assert nugget == 0 and slope > 0
    p = fills.variogram(points, points[:, 0], 6, "power")[2]
    assert 1.6 < p < 2


def test_entropies_without_usable_pixels_are_null(spark):
    rows = [(1, [0.0, 1.0, 0.0, 1.0], float("nan"), None), (2, None, None, None), (3, [1.0], None, 2.0), (4, [0.5] * 4, 3.0, float("nan"))]
    p = spark.createDataFrame(rows, "patch_id long, clean array<double>, mean_entropy_3 double, mean_entropy_5 double")
    got = {r[0]: r[1:] for r in ev.entropies(p, (2, 2, 1), windows=[3, 5]).collect()}
    assert got == {1: (1.0, 1.0), 2: (None, None), 3: (None, 2.0), 4: (3.0, 0.0)}
    stored = spark.createDataFrame([(1, 7.0), (2, 8.0)], "patch_id long, entropy_3 double")
    got = {r[0]: r[1:] for r in ev.entropies(p, (2, 2, 1), stored, [3, 5]).collect()}
    assert got == {1: (7.0, 1.0), 2: (8.0, None), 3: (None, 2.0), 4: (3.0, 0.0)}
    assert ev.entropies(p.limit(0), (2, 2, 1), stored).count() == 0


def test_summary_with_interval_is_the_bootstrap_of_each_group(spark):
    values = {k: np.random.default_rng(i).random(30).round(6) for i, k in enumerate("ab")}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)] + [(None, 0, 1.0), ("c", 0, None)], "method string, i int, psnr double")
    got = {r["method"]: r for r in summary.with_interval(df, ["method"], order=["i"]).collect()}
    assert set(got) == {"a", "b"}
    for k, v in values.items():
        assert np.allclose((got[k]["ci95_lo"], got[k]["ci95_hi"]), summary.bootstrap_mean(v)) and abs(got[k]["mean"] - v.mean()) < 1e-12


def test_preferred_columns():
    assert scalars.preferred(["entropy_31", "entropy_15"]) == "entropy_15" and scalars.preferred(["x", "entropy_9", "entropy_31"]) == "entropy_31"
    assert scalars.preferred(["entropy_7", "entropy_15"], ("entropy_15", "entropy_7")) == "entropy_15" and scalars.preferred(["psnr"]) is None


def test_rewrite_keeps_columns_and_mends_a_stopped_swap(spark, tmp_path):
    import os

    from gapweave.sources import sinks

    path = str(tmp_path / "t")
    sinks.rewrite(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "patch_id int, note string"), path)
    os.rename(path, path + ".before")  # as if the swap had stopped
    sinks.rewrite(spark.createDataFrame([(1, 5), (3, 6), (None, 7)], "patch_id int, v int"), path)
    got = {tuple(r) for r in spark.read.parquet(path).select("patch_id", "v", "note").collect()}
    assert got == {(1, 5, "a"), (3, 6, None), (None, 7, None)} and sorted(os.listdir(tmp_path)) == ["t"]
    sinks.rewrite(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "patch_id int, v int, note string"), path)
    with pytest.raises(ValueError):
        sinks.rewrite(spark.createDataFrame([(1, 5)], "patch_id int, w int"), path)


def test_csv_by_noise_label(spark, tmp_path):
    from gapweave.sources import sinks

    sinks.by_noise_label(spark.createDataFrame([("inf", 1), ("20", 2), ("7", 3)], "noise_level string, n int"), str(tmp_path / "c"))
    got = {(r["noise"], r["n"]) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}
    assert got == {("gap_only", "1"), ("snr20dB", "2"), ("7", "3")}
