"""Permutation tests on stacks of rasters."""

import numpy as np

from gapweave import catalog
from gapweave.operators import stats

SF = "/root/testdata/sf0.001"


def test_local_p_moves_no_cells(spark):
    plan = catalog.queries()["local_moran_p"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_maps_share_their_permutations():
    rng = np.random.default_rng(4)
    maps, mask = rng.random((20, 6, 5)).round(1), rng.random((20, 6, 5)) < 0.7
    maps[3] = 0.5
    for inside in (None, mask):
        got = stats.moran_permutations(maps, inside, 199)
        for k in range(20):
            want = stats.moran_permutation(maps[k], None if inside is None else inside[k], 199)
            assert (got["i"][k], got["p"][k]) == (want["i"], want["p"])
            assert (got["labels"][k] == want["labels"]).all() and (got["local_p"][k] == want["local_p"]).all()


def test_local_p_of_cells_and_of_arrays_agree(spark):
    rng = np.random.default_rng(6)
    v, gap = rng.random((3, 5, 4)).round(2), (rng.random((3, 5, 4)) < 0.6).astype(int)
    rows = [(k, i, j, float(v[k, i, j]), int(gap[k, i, j])) for k in range(3) for i in range(5) for j in range(4)]
    px = spark.createDataFrame(rows, "patch_id long, y int, x int, v double, gap int")
    arrays = spark.createDataFrame([(k, v[k].ravel().tolist(), gap[k].ravel().tolist()) for k in range(3)], "patch_id long, values array<double>, inside array<int>")
    a, b = (sorted(map(tuple, d.collect())) for d in (stats.local_p(px, 4, 20, 49, gap="gap"), stats.local_p_arrays(arrays, 4, 20, 49)))
    assert a == b and len(a) == 60
