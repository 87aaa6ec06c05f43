"""Quantiles, ranks, suffix minima and hash places against numpy and pandas."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapweave.operators import order, select, stats

POINTS = [0, 0.1, 1 / 3, 0.5, 2 / 3, 0.95, 1]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    return {f"g{g}": np.round(rng.normal(size=n), 1 if g % 2 else 9) for g, n in enumerate((1, 2, 3, 5, 10, 4000, 30_000))}


@pytest.fixture(scope="module")
def frame(values):
    return pd.concat([pd.DataFrame({"g": k, "v": x}) for k, x in values.items()])


def test_quantiles_are_exact_in_every_group(spark, values, frame):
    odd = spark.createDataFrame([("g4", None), ("g4", float("nan")), ("none", None), (None, 2.0), (None, 4.0)], "g string, v double")
    df = spark.createDataFrame(frame).unionByName(odd)
    got = {r["g"]: r["q"] for r in order.quantiles(df, "v", POINTS, ["g"]).collect()}
    assert set(got) == {*values, None} and got[None][3] == 3.0
    for k, x in values.items():
        assert np.allclose(got[k], np.quantile(x, POINTS), rtol=0, atol=1e-12)


def test_a_narrow_sketch_still_gives_exact_quantiles(spark, frame, monkeypatch):
    monkeypatch.setattr(order, "ACCURACY", 20)  # wide brackets, many rows below and above
    got = order.quantiles(spark.createDataFrame(frame), "v", POINTS).first()["q"]
    assert np.allclose(got, np.quantile(frame.v, POINTS), rtol=0, atol=1e-12)
    assert order.quantiles(spark.createDataFrame(frame).limit(0), "v", POINTS).count() == 0


@pytest.mark.parametrize("ranges", [64, 3])
def test_average_ranks_with_ties(spark, frame, monkeypatch, ranges):
    monkeypatch.setattr(order, "RANGES", ranges)
    got = order.average_ranks(spark.createDataFrame(frame), "v", ["g"]).toPandas().sort_values(["g", "v"])
    want = frame.assign(rank=frame.groupby("g").v.rank()).sort_values(["g", "v"])
    assert np.allclose(got["rank"], want["rank"])
    assert np.allclose(order.average_ranks(spark.createDataFrame(frame), "v").toPandas().sort_values("v")["rank"], frame.v.rank().sort_values())


def test_ranks_among_the_rows_of_a_partner(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False), ("a", 2.0, True), ("a", 5.0, True), ("a", 4.0, False)], "g string, v double, use boolean")
    got = {r["v"]: (r["every"], r["some"]) for r in order.rank_table(df, "v", ["g"], {"every": F.lit(True), "some": F.col("use")}).collect()}
    assert got == {1.0: (1.0, 1.0), 2.0: (2.5, 2.0), 4.0: (4.0, None), 5.0: (5.0, 3.0)}


def test_correlations_of_columns_with_different_gaps(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({c: np.round(rng.normal(size=400), 1) for c in ("x1", "x2", "y1", "y2")})
    for c, share in (("x1", 0.1), ("y1", 0.3), ("y2", 0.2)):
        pdf.loc[rng.random(400) < share, c] = np.nan
    pdf["method"] = np.where(np.arange(400) % 3 == 0, "a", "b")
    got = {(r["method"], r["x_name"], r["y_name"]): r for r in stats.correlations(spark.createDataFrame(pdf), ["x1", "x2"], ["y1", "y2"]).collect()}
    assert len(got) == 8
    for (m, x, y), r in got.items():
        both = pdf[pdf.method == m][[x, y]].dropna()
        assert r["n"] == len(both) and abs(r["r"] - both.corr().iloc[0, 1]) < 1e-12 and abs(r["rho"] - both.rank().corr().iloc[0, 1]) < 1e-12


def test_fdr_with_ties_groups_and_missing(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(np.round(p, 2)) if i % 11 else None) for g in "ab" for i, p in enumerate(rng.random(200) ** 3)] + [("a", 999, float("nan")), ("c", 0, None)]
    got = {(r["g"], r["i"]): r for r in stats.fdr(spark.createDataFrame(rows, "g string, i int, p double"), "p", by=["g"]).collect()}
    assert len(got) == len(rows)
    for g in "ab":
        p = pd.Series({i: v for k, i, v in rows if k == g and v == v}).dropna()
        q = (p * len(p) / p.rank(method="max")).loc[p.sort_values(ascending=False).index].cummin().clip(upper=1)
        for i, v in q.items():
            assert abs(got[g, i]["q"] - v) < 1e-12 and got[g, i]["significant"] == (v <= 0.05)
    assert got["a", 999]["q"] is None and not got["c", 0]["significant"]


def test_draws_and_splits_go_by_the_hash(spark):
    ids = [(f"s{i % 2}", i) for i in range(700)]
    df = spark.createDataFrame(ids + ids[:50], "satellite string, patch_id long")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {(r["satellite"], r["patch_id"]): r["draw"] for r in select.sample_ids(df, "satellite", 120, 7).collect()}
    want = {(s, i): k for s in ("s0", "s1") for k, i in enumerate(sorted((i for t, i in ids if t == s), key=lambda i: (digest(f"7|{i}"), i))[:120])}
    assert got == want
    split = select.hash_split(spark.createDataFrame(ids, "satellite string, patch_id long"), "patch_id", "satellite").groupBy("satellite", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in split} == {(s, k): n for s in ("s0", "s1") for k, n in (("train", 280), ("val", 35), ("test", 35))}
