import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.errors import ConfigError, DimensionError, MethodError, SchemaError
from gapweave.functions import tails
from gapweave.operators import fills, select, stats, summary
from gapweave.plans.evaluate import evaluate, local_entropy, resume
from gapweave.schemas import MANIFEST, RESULTS
from gapweave.sources import sinks, tables
from gapweave.streaming.checkpoints import incremental


@pytest.fixture
def patch():
    y, x = np.mgrid[0:16, 0:16] / 16
    clean = np.stack([0.5 + 0.3 * np.sin(3 * x + k) * np.cos(2 * y) for k in range(3)], 2).astype(np.float32)
    mask = np.zeros((16, 16), bool)
    mask[4:9, 5:10] = True
    return clean, mask


# ---- contract of the reconstruction methods --------------------------------------------------


@pytest.mark.parametrize("name", sorted(fills.METHODS))
def test_contract(name, patch):
    clean, mask = patch
    m = fills.method(name)
    out = m.apply(np.where(mask[..., None], 0, clean), mask)
    assert out.shape == clean.shape and out.dtype == np.float32
    assert np.isfinite(out).all() and out.min() >= 0 and out.max() <= 1
    if name != "tv":
        assert np.abs(out - clean)[~mask].max() < 1e-6
    assert np.array_equal(m.apply(clean, np.zeros_like(mask)), clean)
    one = np.zeros_like(mask)
    one[7, 7] = True
    single = m.apply(np.where(one, 0, clean[..., 0]), one)
    assert single.shape == (16, 16) and abs(single[7, 7] - clean[7, 7, 0]) < (0.6 if name in ("cs_wavelet", "non_local", "dct", "cs_dct") else 0.2)
    if name == "non_local":  # the one method that refuses a raster without known pixels
        with pytest.raises(MethodError):
            m.apply(clean, np.ones_like(mask))
    else:
        assert m.apply(clean, np.ones_like(mask)).shape == clean.shape
    with pytest.raises(DimensionError):
        m.apply(clean, mask[:8])


@pytest.mark.parametrize("name, least", [("bilinear", 30), ("bicubic", 35), ("rbf", 38), ("spline", 38), ("kriging", 28), ("exemplar", 35), ("idw", 18), ("nearest", 18)])
def test_smooth_surfaces_are_recovered(name, least, patch):
    clean, mask = patch
    assert fills.all_metrics(clean, fills.method(name).apply(np.where(mask[..., None], 0, clean), mask), mask)["psnr"] > least


def test_linear_surfaces_are_exact():
    y, x = np.mgrid[0:12, 0:12]
    plane = 0.2 + 0.02 * x + 0.03 * y
    mask = np.zeros((12, 12), bool)
    mask[3:8, 4:9] = True
    for name in ("bilinear", "bicubic", "rbf"):
        assert np.abs(fills.method(name).apply(plane, mask) - plane).max() < 1e-4


def test_registry():
    assert fills.method("l1_dct").name == "cs_dct" and fills.method("exemplar_based").name == "exemplar"
    with pytest.raises(MethodError):
        fills.method("none")
    fills.register("zero", "spatial", lambda v, m: np.where(m, 0, v))
    assert fills.method("zero").apply(np.ones((4, 4)), np.eye(4)).sum() == 12
    del fills.METHODS["zero"]


def test_wavelets_reconstruct():
    x = np.random.default_rng(0).random((33, 20))
    a, d = fills.wavedec(x, 3)
    assert np.abs(fills.waverec(a, d) - x).max() < 1e-8


def test_metrics_of_known_values():
    clean, mask = np.full((8, 8), 0.5), np.zeros((8, 8), bool)
    assert fills.all_metrics(clean, clean, mask) == {"psnr": math.inf, "ssim": 1.0, "rmse": 0.0, "pixel_acc_002": 1.0, "f1_002": 1.0, "pixel_acc_005": 1.0, "f1_005": 1.0, "pixel_acc_01": 1.0, "f1_01": 1.0}
    mask[2:4, 2:4] = True
    q = fills.all_metrics(clean, clean + 0.1, mask)
    assert q["psnr"] == pytest.approx(20) and q["pixel_acc_005"] == 0


def test_entropy():
    assert local_entropy(np.ones((9, 9)), 7).max() < 1e-12
    x = np.random.default_rng(0).random((20, 20))
    assert np.allclose(local_entropy(x, 5), local_entropy(x * 7 + 3, 5)) and local_entropy(x, 5).min() >= 0
    with pytest.raises(ValueError):
        local_entropy(x, 4)


# ---- statistics -------------------------------------------------------------------------------


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.correlation_p(1.0, 10) == 0 and math.isnan(tails.correlation_p(0.5, 2))


def test_bootstrap_is_deterministic_and_brackets_the_mean(spark):
    v = np.random.default_rng(0).normal(20, 2, 300)
    lo, hi = summary.bootstrap_mean(v)
    assert (lo, hi) == summary.bootstrap_mean(v) and lo < v.mean() < hi
    assert all(map(math.isnan, summary.bootstrap_mean(np.array([np.nan]))))
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "method string, i int, psnr double")
    exact = summary.bootstrap_ci(df, ["method"], order=["i"]).first()
    assert (exact["ci95_lo"], exact["ci95_hi"]) == pytest.approx((lo, hi))
    cells = summary.bootstrap_ci(df, ["method"], order=["i"], most=100).first()
    assert cells["ci95_lo"] < v.mean() < cells["ci95_hi"]


def test_bootstrap_of_large_groups_resamples_all_values(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.lognormal(3, 1, 500), np.full(700, 5.0)])
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, 2.0) for i in range(150)] + [("a", -1, None), ("a", -2, math.nan), (None, 1, 3.0), ("c", 1, math.nan), ("d", 1, 4.0)]
    df = spark.createDataFrame(rows, "method string, i int, psnr double")
    got = {r["method"]: (r["ci95_lo"], r["ci95_hi"]) for r in summary.bootstrap_ci(df, ["method"], order=["i"], most=100).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["b"] == pytest.approx((2, 2)) and got["d"] == (4, 4) and got["c"] == (None, None)
    lo, hi = summary.bootstrap_mean(v)
    assert got["a"] == pytest.approx((lo, hi), abs=0.05 * (hi - lo))
    # without an order, the 700 equal values share a chunk
    assert [*summary.bootstrap_ci(df.filter("method = 'a'"), ["method"], most=100).first()][1:] == pytest.approx((lo, hi), abs=0.05 * (hi - lo))


def test_bootstrap_chunks_share_each_resample():
    parts = [np.full(n, float(k + 1)) for k, n in enumerate((40, 1, 300, 25, 7))]
    paths = summary.bootstrap_paths([len(p) for p in parts])
    sums = [summary.bootstrap_chunk(p, np.ones(len(p), int), k, paths[k]) for k, p in enumerate(parts)]
    counts = np.array([s / (k + 1) for k, s in enumerate(sums)])
    assert counts.shape == (5, summary.RESAMPLES) and (counts.sum(0) == 373).all()  # as many draws as values
    n = np.array([40, 1, 300, 25, 7])
    assert np.allclose(counts.mean(1), n, rtol=0.05) and np.allclose(counts.var(1), n * (1 - n / 373), rtol=0.1)


def test_dummies_refuse_more_levels_than_they_can_hold(spark, monkeypatch):
    df = spark.range(1001).select(F.format_string("v%04d", "id").alias("c"))
    with pytest.raises(ValueError, match="more than 1000 levels"):
        stats.dummies(df, ["c"])
    monkeypatch.setattr(stats, "MAX_LEVELS", 3)
    assert stats.dummies(df.filter("c < 'v0003'"), ["c"])[1] == ["c_v0001", "c_v0002"]
    assert stats.dummies(df, ["c"], {"c": ["a", "b"]})[1] == ["c_b"]


def test_robust_regression_resists_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = 3 - 2 * x + rng.normal(size=400) * 0.1
    y[:40] += 30
    df = spark.createDataFrame([(float(a), float(b), "mn"[i % 2], "30") for i, (a, b) in enumerate(zip(x, y))], "e double, psnr double, method string, noise_level string")
    table, info = stats.robust_regression(df, "psnr", ["e"])
    assert table.set_index("term").loc["e", "coef"] == pytest.approx(-2, abs=0.05) and info["n"] == 400
    assert stats.robust_regression(df.limit(5), "psnr", ["e"])[0].empty


def test_moran():
    y, x = np.mgrid[0:12, 0:12]
    assert stats.moran_permutation(x.astype(float), permutations=99)["i"] > 0.7
    assert stats.moran_permutation(np.ones((5, 5)))["p"] == 1
    noise = stats.moran_permutation(np.random.default_rng(0).random((12, 12)), permutations=99)
    assert abs(noise["i"]) < 0.2 and set(np.unique(noise["labels"])) <= {1, 2, 3, 4}


def test_fdr_leaves_nan_out(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, float("nan")), (5, None)], "i int, p double")
    got = {r["i"]: (r["q"], r["significant"]) for r in stats.fdr(df, "p").collect()}
    assert got[1][0] == pytest.approx(0.03) and got[2][0] == pytest.approx(0.04) and got[4] == got[5] == (None, False)


def test_two_group_kruskal_equals_squared_z(spark):
    df = spark.createDataFrame([("ab"[i % 2], float((i * 37) % 101)) for i in range(60)], "g string, v double")
    assert stats.kruskal_test(df, "g", "v").first()["p"] == pytest.approx(stats.pairwise_test(df, "g", "v").first()["p"], abs=0.02)
    assert stats.kruskal(df.filter("g = 'a'"), "g", "v").first()["h"] is None


# ---- selection, sources, sinks, plans ---------------------------------------------------------


def test_buckets(spark):
    assert select.bucket_names([" Low "]) == ["low"]
    with pytest.raises(ConfigError):
        select.bucket_names(["other"])
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "v double")
    assert select.in_buckets(df, "v", select.cutoffs(df, "v"), ["medium"]).count() == 3
    assert select.terciles(df, "v", "b").groupBy("b").count().count() == 3


def test_sampling(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("satellite"), F.col("id").alias("patch_id"))
    a = select.sample_ids(df, "satellite", 10).collect()
    assert len(a) == 20 and len({r["patch_id"] for r in a}) == 20 and a == select.sample_ids(df.repartition(5), "satellite", 10).collect()


def test_csv_keeps_infinities_and_text_noise_levels(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("seed,noise_level,method,patch_id,psnr,status\n1,40,idw,7,inf,ok\n1,inf,idw,8,nan,error\n")
    rows = tables.results(spark, str(p)).orderBy("patch_id").collect()
    assert rows[0]["psnr"] == math.inf and rows[1]["psnr"] is None and [r["noise_level"] for r in rows] == ["40", "inf"]


def test_ragged_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("method,entropy_7,psnr\nidw,1.5,20\nidw,2.5,3.5,1.0,21\nidw,9\n")
    rows = tables.csv_ragged(spark, str(p)).orderBy("psnr").collect()
    assert [(r["entropy_7"], r["entropy_15"], r["entropy_31"], r["psnr"]) for r in rows] == [(1.5, None, None, 20.0), (2.5, 3.5, 1.0, 21.0)]
    p.write_text("method,psnr\nidw,1,2,3,4,5,6,7,8\n")
    with pytest.raises(SchemaError):
        tables.csv_ragged(spark, str(p))


def test_lenient_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("patch_id,gap_fraction\n1,0.5\nx,y,z\n")
    from pyspark.sql import types as T

    good, bad = tables.csv_lenient(spark, str(p), T.StructType([f for f in MANIFEST if f.name in ("patch_id", "gap_fraction")][:2]))
    assert good.count() + bad.count() == 2 and bad.count() == 1


def test_arrays_and_stems(spark, tmp_path):
    np.save(tmp_path / "0000012_clean.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "0000013_clean.npy").write_bytes(b"no array")
    rows = {r["patch_id"]: r for r in tables.arrays(spark, str(tmp_path)).collect()}
    assert rows[12]["shape"] == [2, 3] and rows[12]["variant"] == "clean" and list(rows[12]["values"]) == [0, 1, 2, 3, 4, 5]
    assert rows[13]["values"] is None and rows[13]["error"]
    assert sorted(r[0] for r in tables.stems(spark, str(tmp_path)).collect()) == [12, 13]


def test_json_sources(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"model_name": "ae", "metadata": {"n": "3"}, "epochs": [{"epoch": 1, "train_loss": 0.5, "val_loss": 0.4, "val_psnr": 20.0}]}))
    row = tables.histories(spark, str(tmp_path)).first()
    assert row["epoch"] == 1 and row["val_metrics"] == {"val_psnr": 20.0}
    for k, doc in enumerate(({"metadata": {"n": "1"}, "selections": {"s2": {"42": [1, 2]}}}, {"s2": {"42": [1, 2]}})):
        p = tmp_path / f"s{k}"
        p.write_text(json.dumps(doc))
        assert sorted((r["satellite"], r["seed"], r["patch_id"]) for r in tables.selections(spark, str(p)).collect()) == [("s2", 42, 1), ("s2", 42, 2)]
    with pytest.raises(ConfigError):
        tables.selections(spark, str(tmp_path / "s0"), {"n": 2})


def test_model_results(spark, tmp_path):
    from pyspark.sql import types as T

    for path in ("eval/low/ae/ae_inf.csv", "eval/unet/unet_inf.csv"):
        (tmp_path / path).parent.mkdir(parents=True)
        (tmp_path / path).write_text("model,architecture,mean_entropy_7,psnr\nae,ae,1.0,20\n")
    schema = T.StructType.fromDDL("model string, architecture string, mean_entropy_7 double, psnr double")
    rows = tables.model_results(spark, str(tmp_path / "eval"), schema).collect()
    assert sorted(r["entropy_scenario"] for r in rows) == ["default", "low"] and rows[0]["method"] == "ae" and rows[0]["entropy_7"] == 1.0


def test_configuration():
    good = {"experiment": {"name": "x", "seeds": [1], "noise_levels": ["inf", 40.0], "satellites": ["s2"]}, "methods": {"spatial": [{"name": "idw", "params": {"power": 1}}]}}
    assert tables.experiment(good).noise_levels == ("inf", "40") and tables.experiment(json.dumps(good)).methods[0] == ("idw", "spatial", {"power": 1})
    for change in ({"noise_levels": ["7"]}, {"seeds": []}, {"entropy_windows": [4]}, {"max_patches": 0}):
        with pytest.raises(ConfigError):
            tables.experiment({**good, "experiment": {**good["experiment"], **change}})


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(1, "a", 0.5)], "patch_id long, satellite string, mean_entropy_7 double").write.parquet(path)
    sinks.rewrite(spark.createDataFrame([(1, "b"), (2, "c")], "patch_id long, satellite string"), path)
    assert {r["patch_id"]: (r["satellite"], r["mean_entropy_7"]) for r in spark.read.parquet(path).collect()} == {1: ("b", 0.5), 2: ("c", None)}
    sinks.append(spark.createDataFrame([(3, 1.0)], "patch_id long, extra double"), path)
    assert tables.parquet(spark, path).count() == 3 and "extra" in tables.parquet(spark, path).columns


def test_evaluation_reports_errors_and_resumes(spark, patch):
    clean, mask = patch
    rows = [(0, "inf", i, "s2", 0.1, clean.ravel().tolist(), np.where(mask[..., None], 0, clean).ravel().tolist(), mask.ravel().astype(int).tolist()[: 256 if i else 10]) for i in range(3)]
    df = spark.createDataFrame(rows, "seed int, noise_level string, patch_id long, satellite string, gap_fraction double, clean array<float>, degraded array<float>, mask array<int>")
    got = evaluate(df, ["idw", "l1_dct"], (16, 16, 3))
    assert got.schema.names == RESULTS.names
    assert got.filter("status = 'error'").count() == 2 and got.filter("psnr > 15").count() == 4
    done = got.filter("method = 'idw'")
    left = resume(df, done, ["idw", "cs_dct"], (16, 16, 3))
    assert {(r["method"], r["patch_id"]) for r in left.collect()} == {("cs_dct", i) for i in range(3)}
    assert resume(df, done, ["idw"], (16, 16, 3), retry_errors=True).count() == 1


def test_stream_adds_no_rows_twice(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.range(10)
    df.write.parquet(src)
    for expected in (10, 10, 20):
        if expected == 20:
            df.write.mode("append").parquet(src)
        incremental(spark, src, df.schema, out, state)
        assert spark.read.parquet(out).count() == expected


def test_report(spark):
    df = spark.createDataFrame([("idw", 1.0)], "method string, mean double")
    assert "idw & 1.0 \\\\" in summary.latex_table(df, "c", "l")
