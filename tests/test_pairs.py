"""Statistics of pairs: counted once, without a join of rows with ranks."""

import numpy as np
import pandas as pd

from gapweave import catalog
from gapweave.operators import stats

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_are_ranked_once_for_all_pairs(spark):
    text = plan(catalog.queries()["mannwhitney_u"](spark, SF))
    assert "windowspecdefinition(a" not in text and "lineitem" not in text
    assert "Join" not in plan(catalog.queries()["corr_matrix"](spark, SF))


def test_pairs_of_groups_with_ties(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 300), "v": rng.integers(0, 20, 300).astype(float)})
    got = {(r["a"], r["b"]): r for r in stats.mann_whitney(spark.createDataFrame(pdf), "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in got.items():
        x, y = (pdf[pdf.g == k].v.to_numpy() for k in (a, b))
        u = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
        assert (r["n_a"], r["n_b"], r["u"]) == (len(x), len(y), u)
    assert stats.mann_whitney(spark.createDataFrame(pdf[pdf.g == "a"]), "g", "v").count() == 0


def test_correlations_with_missing_values(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q"], 400), **{c: rng.integers(0, 30, 400).astype(float) for c in "abcd"}})
    for c in "abcd":
        pdf.loc[rng.random(400) < 0.1, c] = np.nan
    for few in (100_000, 0):  # broadcast and shuffled ranks
        monkeypatch.setattr(stats, "FEW", few)
        for r in stats.correlations(spark.createDataFrame(pdf), ["a", "b"], ["c", "d"], ["g"]).collect():
            both = pdf[pdf.g == r["g"]][[r["x_name"], r["y_name"]]].dropna()
            x, y = both.iloc[:, 0], both.iloc[:, 1]
            assert r["n"] == len(both)
            assert abs(r["r"] - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(r["rho"] - np.corrcoef(x.rank(), y.rank())[0, 1]) < 1e-9
