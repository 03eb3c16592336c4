"""Sketch-bounded quantiles and joint binning against NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest

from arealens.operators import quantiles as Q
from arealens.operators.binned import binned_means, trend_table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def frame(spark, n=5000, parts=7):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({
        "even": rng.random(n), "skewed": np.exp(4 * rng.standard_normal(n)), "ties": rng.integers(0, 5, n).astype(float),
        "one": np.full(n, 7.5), "hot": np.where(rng.random(n) < 0.4, 3.0, rng.random(n) * 1e9),
        "holes": np.where(rng.random(n) < 0.3, np.nan, rng.standard_normal(n)), "wide": rng.standard_normal(n) * 1e300,
        "none": np.full(n, np.nan)})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize(("accuracy", "values"), [(10_000, 200_000), (50, 200_000), (50, 3), (4, 200_000)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, values):
    """With wide windows, and with more values than the driver takes."""
    monkeypatch.setattr(Q, "WINDOW_VALUES", values)
    pdf, df = frame(spark)
    got = Q.exact_quantiles(df, list(pdf.columns), PROBS, accuracy=accuracy)
    for c in pdf.columns:
        x = pdf[c].dropna().to_numpy()
        if not len(x):
            assert got[c] == [None] * len(PROBS)
        else:
            np.testing.assert_allclose(got[c], np.quantile(x, PROBS), rtol=1e-12)


def test_a_wrong_window_is_noticed(spark, monkeypatch):
    """Windows that miss the rank do not change the result."""
    right = Q._sketch

    def wrong(values, probs, accuracy):
        return {i: (n, lo, hi, [(hi, hi) for _ in b]) for i, (n, lo, hi, b) in right(values, probs, accuracy).items()}

    monkeypatch.setattr(Q, "_sketch", wrong)
    pdf, df = frame(spark, 800, 3)
    got = Q.exact_quantiles(df, ["even", "ties"], [0.5])
    assert got == {"even": [np.median(pdf["even"])], "ties": [np.median(pdf["ties"])]}


def test_few_rows_and_own_probs(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, 2.0), (None, 3.0)], "a double, b double")
    assert Q.exact_quantiles(df, ["a", "b"], {"a": [0.5], "b": [0.0, 1.0]}) == {"a": [2.5], "b": [2.0, 3.0]}
    assert Q.exact_quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_joint_binning_equals_pandas(spark):
    pdf, df = frame(spark)
    pdf["y"] = pdf["even"] * 3 + pdf["ties"]
    pdf.loc[::11, "y"] = np.nan
    names = ["even", "skewed", "ties", "one", "hot", "holes", "none", "absent"]
    got = trend_table(spark.createDataFrame(pdf).repartition(5), names, "y", q=12, min_rows=20, min_distinct=1, min_bins=1).toPandas()
    for c in names[:-2]:
        d = pdf[[c, "y"]].dropna()
        bins = min(12, d[c].nunique())
        codes = pd.qcut(d[c], q=bins, labels=False, duplicates="drop")
        codes = codes.fillna(0) if c == "one" else codes
        want = d.groupby(codes)[[c, "y"]].mean()
        mine = got[got.feature == c].sort_values("x_mean")
        np.testing.assert_allclose(mine["x_mean"], want[c], rtol=1e-9)
        np.testing.assert_allclose(mine["y_mean"], want["y"], rtol=1e-9)
        assert mine["n"].tolist() == d.groupby(codes).size().tolist()
    assert set(got.feature) == set(names[:-2])
    assert binned_means(df, "ties", "even", q=12, min_rows=20, min_distinct=6, min_bins=1).count() == 0
