"""Whitening against numpy's own eigenvectors of the whole covariance matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import whitening


def exact(x: np.ndarray, k: int = 8):
    y = x - x.mean(0)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e, u, y @ u / np.sqrt(e), e / ((y * y).sum() / len(x))


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect()}
    x = {i: np.floor(1024 * np.array(v, float)).astype(int) + 100000 for i, v in rows.items()}
    whole = np.array(list(x.values()))
    n, s = len(whole), whole.sum(0)
    e, _, z, share = exact(whole)
    got = whitening.whiten(table.withColumn("v", F.lit(1)).withColumn("component", F.lit("x"))).toPandas()
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].max() < 1e-10 and got["identity_error"].nunique() == 1
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(x)].to_numpy()
    sign = np.sign((wide * z).sum(0))
    assert np.abs(wide * sign - z).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-10)
    dev = got.groupby("vec_id")["deviation"].first()
    assert all(dev[i] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for i, v in x.items())


@pytest.mark.parametrize("spectrum", [np.r_[9.0, np.ones(99)], np.repeat([5.0, 3.0], 20), np.r_[np.arange(12, 0, -1.0), np.zeros(30)], 0.9 ** np.arange(400)])
def test_lanczos_finds_repeated_eigenvalues_and_survives_breakdown(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    a, calls = q * spectrum @ q.T, []
    e, u = whitening.lanczos(lambda b: calls.append(1) or a @ b, d, 8, 8, most=64)
    assert np.allclose(e, np.sort(spectrum)[::-1][:8], atol=1e-12 * spectrum.max()) and np.abs(u.T @ u - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(a @ u - u * e) < 1e-11 * spectrum.max() and len(calls) < 200


def test_a_small_block_is_widened_to_the_wanted_pairs():
    a = np.diag(np.r_[np.full(6, 2.0), np.full(14, 1.0)])
    e, u = whitening.lanczos(lambda b: a @ b, 20, 6, 2)
    assert np.allclose(e, 2) and np.abs(a @ u - 2 * u).max() < 1e-12


def test_unusable_repeated_equal_and_missing_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, 2.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 0.0, 0.0]), (5, None), (6, [None, 1.0, 2.0]), (7, [2.0, 0.25, 1.0]), (8, [3.0, 3.0, -1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert len(got) == 5 * 3 and (got["n"] == 5).all() and got["identity_error"].max() < 1e-9 and got["vec_id"].isna().sum() == 3
    assert abs(got.groupby("component")["explained"].first().sum() - 1) < 1e-12
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).count() == 0  # no variance
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], schema)).count() == 2  # one component
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_deviations_are_exact_or_an_error():
    x = np.array([[10**6, 1], [5, 7]])
    assert whitening.deviations(x, 2, x.sum(0)).tolist() == [sum((2 * int(a) - int(b)) ** 2 for a, b in zip(r, x.sum(0))) for r in x]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[10**9, 0]]), 10**6, np.array([0, 0]))
