"""Intervals of several metrics against resampling each one by itself."""

import math

import numpy as np
import pandas as pd
import pytest

from gapweave import catalog
from gapweave.operators import bootstrap as bs
from gapweave.operators import summary
from gapweave.plans.views import fact

SF = "/root/testdata/sf0.001"


def frame(sizes: dict, rng) -> pd.DataFrame:
    parts = [pd.DataFrame({"g": k, "i": range(n), "x": rng.normal(size=n).round(4), "y": rng.random(n).round(3), "z": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))}) for k, n in sizes.items()]
    return pd.concat(parts, ignore_index=True)


def test_small_groups_replay_each_metric(spark):
    pdf = frame({"a": 40, "b": 7}, np.random.default_rng(1))
    odd = [(None, 0, 2.0, None, None), ("c", 0, None, None, float("nan")), ("c", 1, 1.0, None, None)]
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(odd, "g string, i long, x double, y double, z double"))
    got = {r["g"]: r for r in bs.intervals(df, ["g"], ["x", "y", "z"], ["i"]).collect()}
    assert set(got) == {"a", "b", "c", None} and got[None]["x_ci95_lo"] == got[None]["x_ci95_hi"] == 2.0
    assert got["c"]["y_ci95_lo"] is None and got["c"]["z_ci95_hi"] is None and got["c"]["x_ci95_lo"] == 1.0
    for g in "ab":
        for m in "xyz":
            want = bs.bootstrap_mean(pdf[pdf.g == g].sort_values("i")[m].to_numpy())
            assert np.allclose((got[g][f"{m}_ci95_lo"], got[g][f"{m}_ci95_hi"]), want, rtol=0, atol=1e-12)


def test_chunks_of_large_groups_agree_with_whole_resampling(spark):
    pdf = frame({"a": 2000, "b": 900}, np.random.default_rng(2))
    pdf.loc[pdf.g == "b", "y"] = 0.25  # one value: no spread
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r for r in bs.intervals(df, ["g"], ["x", "y", "z"], ["i"], most=150).collect()}
    for g in "ab":
        for m in "xyz":
            lo, hi = bs.bootstrap_mean(pdf[pdf.g == g][m].to_numpy())
            assert (got[g][f"{m}_ci95_lo"], got[g][f"{m}_ci95_hi"]) == pytest.approx((lo, hi), abs=0.05 * (hi - lo) + 1e-12)
    again = {r["g"]: r for r in bs.intervals(df.repartition(7), ["g"], ["x", "y", "z"], ["i"], most=150).collect()}
    assert all(math.isclose(again[g][c], got[g][c], rel_tol=1e-12) for g in got for c in got[g].asDict() if c != "g")


def test_registered_intervals_are_those_of_their_groups(spark):
    pdf = fact(spark, SF).select("method", "noise_level", "order_id", "line_no", "psnr", "ssim").toPandas()
    got = {(r["method"], r["noise_level"]): r for r in catalog.queries()["combined_intervals"](spark, SF).collect()}
    assert len(got) == 20
    for (m, n), r in list(got.items())[:6]:
        rows = pdf[(pdf.method == m) & (pdf.noise_level == n)]
        for c in ("psnr", "ssim"):
            x = rows.sort_values(["order_id", "line_no", c])[c].dropna().to_numpy()
            assert np.allclose((r[f"{c}_ci95_lo"], r[f"{c}_ci95_hi"], r[f"{c}_mean"], r[f"{c}_std"]), (*bs.bootstrap_mean(x), x.mean(), x.std()))
        assert r["n"] == len(rows)


def test_two_metrics_share_the_drawn_rows():
    x = np.random.default_rng(5).random(300)
    sums = bs.bootstrap_chunk(np.stack([x, 2 * x], 1), np.ones(300, int), 0, [], 50)
    assert np.allclose(sums[:, 1], 2 * sums[:, 0]) and np.allclose(sums[:, 0], bs.bootstrap_chunk(x, np.ones(300, int), 0, [], 50))
    assert summary.bootstrap_mean is bs.bootstrap_mean


def test_equal_values_meet_whatever_their_order(spark):
    pdf = frame({"a": 900}, np.random.default_rng(7))[["g", "i", "y"]]
    got = [bs.intervals(spark.createDataFrame(pdf.assign(i=pdf.i + shift)), ["g"], ["y"], ["i"], most=150).first() for shift in (0, 10_000)]
    assert got[0] == got[1]


def counted_twice(rng, n: int = 1200) -> pd.DataFrame:
    """Values of which some stand three times, and metrics whose orders differ."""
    x = rng.lognormal(0, 1, n).round(6)
    pdf = pd.DataFrame({"g": "a", "x": np.concatenate([x, np.repeat(x[: n // 10], 2)])})
    return pdf.assign(i=range(len(pdf)), y=-pdf.x, z=np.where(pdf.x > 1, pdf.x, np.nan))


def test_metrics_of_the_same_rows_share_draws_whatever_their_order(spark):
    got = bs.intervals(spark.createDataFrame(counted_twice(np.random.default_rng(8))), ["g"], ["x", "y", "z"], ["i"], most=200).first()
    assert (got["y_ci95_lo"], got["y_ci95_hi"]) == pytest.approx((-got["x_ci95_hi"], -got["x_ci95_lo"]), rel=1e-12)
    assert 1 < got["z_ci95_lo"] < got["z_ci95_hi"]


def test_rows_of_large_groups_are_read_once(spark):
    pdf = counted_twice(np.random.default_rng(9))
    seen = spark.sparkContext.accumulator(0)

    def rows(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    df = spark.createDataFrame(pdf)
    got = summary.with_intervals(df.mapInPandas(rows, df.schema), ["g"], ["x", "y"], ["i"], most=200).first()
    assert seen.value == len(pdf)
    assert np.allclose((got["n"], got["x_mean"], got["x_std"], got["y_std"]), (len(pdf), pdf.x.mean(), pdf.x.std(ddof=0), pdf.x.std(ddof=0)), rtol=1e-12)


def test_means_and_spreads_are_those_of_the_rows(spark):
    nan = float("nan")
    rows = [("a", 1.0, None), ("a", 1.0, 2.0), ("a", 4.0, 2.0), ("b", nan, None), ("b", 1.0, None), (None, 5.0, float("inf")), ("c", 1e9, 1e-9), ("c", 1e9 + 1, 3e-9)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, x double, y double, i int")
    for most in (1, 100):
        got = {r["g"]: r for r in summary.with_intervals(df, ["g"], ["x", "y"], ["i"], most=most).collect()}
        want = {r["g"]: r for r in summary.multi_metric(df, ["g"], ["x", "y"]).collect()}
        assert set(got) == set(want)
        for g, r in want.items():
            for c in r.asDict():
                same = got[g][c] == r[c] or None not in (got[g][c], r[c]) and np.allclose(got[g][c], r[c], rtol=1e-9, atol=0, equal_nan=True) if c != "g" else True
                assert same, (most, g, c, got[g][c], r[c])


def test_weighed_draws_have_the_law_of_draws_with_replacement():
    rng = np.random.default_rng(10)
    for weights in (np.full(400, 60), np.where(rng.random(400) < 0.05, 120, 60), rng.integers(1, 40, 400), rng.integers(1, 9000, 40)):
        v, n = rng.lognormal(0, 1, len(weights)), int(weights.sum())
        s = bs.bootstrap_chunk(np.stack([v, np.ones(len(v))], 1), weights, 0, [], 20_000)
        mean = weights @ v / n
        z = (s[:, 0] - n * mean) / np.sqrt(weights @ (v - mean) ** 2)
        assert np.allclose(s[:, 1], n, rtol=1e-12) and abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.04
        one = bs.bootstrap_chunk(np.eye(len(v))[:, :3], weights, 0, [], 20_000)
        assert np.allclose(one.var(0), weights[:3] * (1 - weights[:3] / n), rtol=0.06) and np.allclose(one, np.rint(one), atol=1e-6)
