"""Methods, metrics and entropies on stacks of rasters against one raster at a time."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave import catalog
from gapweave.operators import fills, raster
from gapweave.plans import evaluate as ev, views


@pytest.fixture(scope="module")
def stack():
    rng = np.random.default_rng(8)
    clean, mask = rng.random((30, 9, 8, 2)).astype(np.float32), rng.random((30, 9, 8)) < 0.3
    mask[10:20] = mask[10]
    mask[0], mask[1], clean[2] = False, True, 0.5
    mask[3] = True
    mask[3, :1, :3] = False
    return clean, np.where(mask[..., None], 0, clean), mask


@pytest.mark.parametrize("name", sorted(fills.METHODS))
def test_a_raster_does_not_depend_on_its_stack(stack, name):
    clean, degraded, mask = stack
    m = fills.METHODS[name]
    use = np.arange(30) != 1 if m.needs_known else np.ones(30, bool)
    for d in (degraded[use], degraded[use][..., 0]):
        want = np.stack([m.apply(x, k) for x, k in zip(d, mask[use])])
        assert np.abs(m.apply_many(d, mask[use]) - want).max() < 1e-6


def test_stacks_share_their_steps(stack, monkeypatch):
    calls, real = [], fills.wavedec
    monkeypatch.setattr(fills, "wavedec", lambda x, level: calls.append(len(x)) or real(x, level))
    fills.METHODS["wavelet"].apply_many(stack[1][..., 0], stack[2])
    assert 0 < len(calls) <= 50 and max(calls) == 28


def test_metrics_and_entropies_of_stacks(stack):
    clean, degraded, mask = stack
    for a, b in ((clean, degraded), (clean[..., 0], degraded[..., 0])):
        got = fills.metrics_many(a, b, mask)
        for k in range(30):
            want = fills.all_metrics(a[k], b[k], mask[k])
            e = (a[k] - b[k]).astype(float)[mask[k]]
            assert set(want) == set(got) and np.isclose(want["rmse"], np.sqrt((e * e).mean()) if e.size else 0)
            assert all(np.isclose(want[c], got[c][k]) for c in want)
    want = [[ev.local_entropy(g, n).mean() for n in (3, 7, 15, 31)] for g in clean[..., 0]]
    assert np.allclose(ev.mean_entropies(clean[..., 0], (3, 7, 15, 31)), want, rtol=0, atol=1e-12)


def test_a_failing_patch_fails_alone(spark):
    kind = "seed int, noise_level string, patch_id long, satellite string, gap_fraction double, clean array<float>, degraded array<float>, mask array<int>"
    good, gaps = [0.5 + k / 100 for k in range(16)], [0] * 15 + [1]
    rows = [(0, "inf", k, "s", 0.1, good, good, [1] * 16 if k == 3 else gaps) for k in range(6)] + [(0, "inf", 6, "s", 0.1, good[:5], good, gaps)]
    got = {r["patch_id"]: r for r in ev.evaluate(spark.createDataFrame(rows, kind).coalesce(1), ["non_local"], (4, 4, 1)).collect()}
    assert {k for k, r in got.items() if r["status"] == "error"} == {3, 6} and len(got) == 7
    assert got[3]["psnr"] is None and "no known pixels" in got[3]["error_msg"] and got[3]["seed"] == 0
    assert got[0]["error_msg"] is None and got[0]["rmse"] is not None and got[0]["entropy_15"] is not None


def test_a_patch_searches_its_range_once(spark, tmp_path):
    spark.createDataFrame([(1, [0.0, 2.0] * 32, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for df in (views.patches(spark, str(tmp_path)), views.patches(spark, str(tmp_path)).select(raster.normalised(F.col("raw"), F.col("raw")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "array_min" in plan and not re.search(r"lambdafunction\([^\n]*lambda x\S* - array_min", plan)
    assert views.patches(spark, str(tmp_path)).first()["clean"] == [0.0, 1.0] * 32


def test_tasks_do_not_hang_on_executors_that_have_registered(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 2)
    plan = catalog.queries()["fill_rbf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan


@pytest.mark.parametrize("side", [4, 9])
def test_entropies_in_several_steps(side, monkeypatch):
    grey = np.random.default_rng(side).random((30, side, side))
    want = ev.mean_entropies(grey, (3, 7, 15))
    monkeypatch.setattr(ev, "PAIRS", 7 * side**4)
    assert np.array_equal(ev.mean_entropies(grey, (3, 7, 15)), want)
