"""NumPy cross-checks for the distributed model statistics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arealens.operators.ordering import durbin_watson, permutation_donors, positions
from arealens.plans import linear as L
from arealens.plans.design import build_design, constant_design


def _hc3(X, y):
    xtx_inv = np.linalg.pinv(X.T @ X)
    beta = np.linalg.pinv(X) @ y
    e = y - X @ beta
    h = np.einsum("ij,jk,ik->i", X, xtx_inv, X)
    meat = (X * (e / (1 - h))[:, None] ** 2).T @ X
    return beta, np.sqrt(np.diag(xtx_inv @ meat @ xtx_inv))


def test_ols_hc3_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 300
    a, b = rng.normal(size=n), rng.uniform(0, 10, size=n)
    g = rng.choice(["x", "y", "z"], size=n)
    y = 1 + 0.5 * a - 0.2 * b + (g == "y") * 0.3 + rng.normal(size=n) * (1 + b / 5)
    pdf = pd.DataFrame({"a": a, "b": b, "g": g, "y": y})
    df = spark.createDataFrame(pdf)
    terms = build_design(numeric=["a", "b"], categorical=["g"], level_map={"g": ["x", "y", "z"]})
    res = L.fit_ols(df, terms, "y")
    X = np.column_stack([np.ones(n), g == "y", g == "z", a, b]).astype(float)
    beta, se = _hc3(X, y)
    assert res.names == ["Intercept", "C(g)[T.y]", "C(g)[T.z]", "a", "b"]
    assert np.allclose(res.coef, beta, atol=1e-9)
    assert np.allclose(res.std_err, se, atol=1e-9)
    r2 = 1 - np.sum((y - X @ beta) ** 2) / np.sum((y - y.mean()) ** 2)
    assert abs(res.metrics["rsquared"] - r2) < 1e-10


def test_ols_singular_design_min_norm(spark):
    rng = np.random.default_rng(1)
    n = 200
    a, b, c = rng.normal(size=(3, n))
    y = 2 + a - b + 0.5 * c + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "d": 2 * a, "y": y}))
    res = L.fit_ols(df, constant_design(["a", "b", "c", "d"]), "y")
    X = np.column_stack([np.ones(n), a, b, c, 2 * a])
    # same fitted values as the pseudo-inverse solution, rank 4
    assert res.rank == 4
    pred = np.asarray([r[0] for r in df.select(res.prediction().alias("p")).collect()])
    assert np.allclose(pred, X @ (np.linalg.pinv(X) @ y), atol=1e-8)
    # minimum norm in original units, as pinv(X) gives: d = 2a carries twice a's weight
    ref = np.linalg.pinv(X) @ y
    assert np.allclose(res.coef[1:], ref[1:], atol=1e-8)
    assert abs(res.coef[4] - 2 * res.coef[1]) < 1e-8


def test_ridge_from_sufficient_statistics(spark):
    rng = np.random.default_rng(2)
    n = 150
    X = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 10, 1]
    y = X @ [0.3, -0.1, 4] + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"x0": X[:, 0], "x1": X[:, 1], "x2": X[:, 2], "y": y, "g": 0}))
    s = L.grouped_suff(df, ["x0", "x1", "x2"], "y", ["g"])[(0,)]
    mu, sd = L.scaler_from(s)
    Z = (X - X.mean(0)) / X.std(0)
    for alpha in (0.01, 1.0, 100.0):
        _, _, beta = L.ridge_fit(s, alpha, mu, sd)
        direct = np.linalg.solve(Z.T @ Z + alpha * np.eye(3), Z.T @ (y - y.mean()))
        assert np.allclose(beta, direct, atol=1e-9)


def test_positions_and_durbin_watson(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(5000)
    e = rng.normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "e": e}))
    pos = {r["k"]: r["pos"] for r in positions(df, ["k"], "pos", n_buckets=16).collect()}
    assert all(pos[k] == k for k in range(5000))
    order = np.argsort(keys)
    es = e[order]
    dw = np.sum(np.diff(es) ** 2) / np.sum(es ** 2)
    assert abs(durbin_watson(df, "k", F.col("e"), n_buckets=16) - dw) < 1e-10


def test_permutation_preserves_multiset(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    d = permutation_donors(df, "k", seed=7).collect()
    assert sorted(r["k"] for r in d) == list(range(3000))
    assert sorted(r["donor_key"] for r in d) == list(range(3000))
    assert sum(r["k"] != r["donor_key"] for r in d) > 2900


def test_pca_sign_and_ratio():
    r = np.array([[1.0, 0.6], [0.6, 1.0]])
    ratio, vec, _ = L.pca_from_corr(r, 2)
    assert np.allclose(ratio, [0.8, 0.2])
    assert np.allclose(vec[:, 0], [1 / np.sqrt(2), 1 / np.sqrt(2)])
    assert vec[0, 1] > 0


def test_quantiles_of_many_columns_in_narrow_bins(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"c{i}": rng.lognormal(i / 4, 2, 5000) * (-1) ** i for i in range(27)})
    pdf["flat"], pdf["hot"] = 3.0, np.where(rng.uniform(size=5000) < 0.4, 1.5, pdf["c0"])
    pdf.loc[::7, "c1"] = np.nan
    df = spark.createDataFrame(pdf)
    from arealens.operators.quantiles import exact_quantiles
    got = exact_quantiles(df, pdf.columns, [0.0, 0.1, 0.5, 0.9, 1.0])
    for c in pdf.columns:
        assert np.allclose(got[c], np.nanquantile(pdf[c], [0.0, 0.1, 0.5, 0.9, 1.0]), rtol=1e-12)


def test_gram_and_ols_with_sixty_columns_and_large_offsets(spark):
    rng = np.random.default_rng(6)
    n, k = 800, 60
    X = rng.normal(size=(n, k)) + 1e6
    y = (X - 1e6) @ rng.normal(size=k) + rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(k)]).assign(y=y)
    res = L.fit_ols(spark.createDataFrame(pdf), constant_design([f"x{i}" for i in range(k)]), "y")
    C = np.column_stack([np.ones(n), X - X.mean(0)])
    beta, se = _hc3(C, y)
    assert np.allclose(res.coef[1:], beta[1:], atol=1e-6) and np.allclose(res.std_err[1:], se[1:], rtol=1e-6)


def test_ols_deficient_design_with_shifted_twins_equals_pinv(spark):
    rng = np.random.default_rng(7)
    n = 300
    a, b = rng.normal(size=(2, n))
    pdf = pd.DataFrame({"a": a, "twin": a, "z": (a - 4.0) / 3.0, "b": b, "y": 1 + a - b + rng.normal(size=n)})
    res = L.fit_ols(spark.createDataFrame(pdf), constant_design(["a", "twin", "z", "b"]), "y")
    X = np.column_stack([np.ones(n), a, a, (a - 4.0) / 3.0, b])
    beta, se = _hc3(X, pdf["y"].to_numpy())
    assert res.rank == 3
    assert np.allclose(res.coef, beta, atol=1e-8) and np.allclose(res.std_err, se, atol=1e-8)


def test_ridge_statistics_far_from_zero(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 2, size=(500, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=500)
    pdf = pd.DataFrame({"x0": x[:, 0] + 1e8, "x1": x[:, 1], "y": y + 1e6})
    df, shift = L.centred(spark.createDataFrame(pdf), ["x0", "x1", "y"])
    s = L.grouped_suff(df.withColumn("g", F.lit(0)), ["x0", "x1"], "y", ["g"])[(0,)]
    mu, sd = L.scaler_from(s)
    assert np.allclose(sd, x.std(0), rtol=1e-6)
    _, g, _ = L.ridge_fit(s, 1e-9, mu, sd)
    assert np.allclose(g, np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0][1:], atol=1e-6)


def test_metrics_of_a_constant_target_have_no_r2(spark):
    from arealens.plans.metrics import regression_metrics
    row = regression_metrics(spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "y double, p double"), "y", "p").first()
    assert row["r2_log"] is None and row["mae_log"] == 0.5


def test_boosted_trees_beat_the_line_and_fill_missing_values(spark):
    from arealens.plans.trees import fit_boosted, permutation_importance
    rng = np.random.default_rng(9)
    n = 1200
    x = rng.uniform(-2, 2, n)
    g = np.where(rng.uniform(size=n) < 0.1, None, np.where(rng.uniform(size=n) < 0.7, "a", "b"))
    y = np.abs(x) + np.where(g == "b", 0.5, 0.0) + rng.normal(0, 0.05, n)
    pdf = pd.DataFrame({"k": range(n), "x": x, "noise": rng.normal(size=n), "g": g, "y": y})
    pdf.loc[::11, "noise"] = np.nan
    df = spark.createDataFrame(pdf)
    train, test = df.where("k % 5 <> 0"), df.where("k % 5 = 0")
    model = fit_boosted(train, ["x", "noise"], ["g"], "y", step_size=0.2, max_iter=25, max_leaves=8, min_leaf=5)
    assert model.model.getNumTrees == 25 and model.modes == {"g": "a"}
    r2, rows = permutation_importance(test, "k", ["x", "noise", "g"], "y", model.predict, repeats=2)
    line = np.polyfit(pdf["x"], pdf["y"], 1)
    held = pdf[pdf["k"] % 5 == 0]
    assert r2 > 0.9 > 1 - np.sum((held["y"] - np.polyval(line, held["x"])) ** 2) / np.sum((held["y"] - held["y"].mean()) ** 2)
    assert rows[0][0] == "x" and rows[0][1] > 0.5


def test_one_hot_of_null_and_unseen_level(spark):
    from arealens.plans.preprocess import onehot_columns
    df = spark.createDataFrame([("a",), (None,), ("new",)], "g string").withColumns(onehot_columns("g", ["a", "b"]))
    assert [(r["g_a"], r["g_b"]) for r in df.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_split_and_folds_follow_the_seeded_order(spark):
    from arealens.operators.ordering import perm_hash
    from arealens.plans.preprocess import holdout_split, kfold
    df = spark.range(1000, 1517).withColumnRenamed("id", "k")
    order = [r["k"] for r in df.orderBy(perm_hash(df, "k", 42), "k").collect()]
    split, n = holdout_split(df, "k", 0.2, 42)
    assert {r["k"] for r in split.where("is_test").collect()} == set(order[:104]) and n == 517
    folds = {r["k"]: r["fold"] for r in kfold(df, "k", 5, 42)[0].collect()}
    assert [folds[k] for k in order] == [f for f, size in enumerate([104, 104, 103, 103, 103]) for _ in range(size)]


def test_no_key_is_lost_by_the_postal_code(spark):
    from arealens.functions.scalar import standardize_zip
    from arealens.sources.fixtures import postal_code
    df = spark.range(0, 2_000_000, 977).select(standardize_zip(postal_code(F.col("id")).cast("string")).alias("z"))
    assert df.where("z is null").count() == 0


def test_correlation_without_a_pair_gives_an_empty_table(spark):
    from arealens.plans.moments import high_pairs
    assert high_pairs(spark, ["a", "b"], np.array([[1.0, 0.1], [0.1, 1.0]])).count() == 0
    assert high_pairs(spark, ["a", "b"], np.array([[1.0, np.nan], [np.nan, 1.0]])).count() == 0


def test_harmonise_keeps_the_canonical_column(spark):
    from arealens.sources.tables import first_existing, harmonise
    df = spark.createDataFrame([(1, 2)], "variant int, canonical int")
    assert harmonise(df, {"variant": "canonical"}).columns == ["variant", "canonical"]
    assert first_existing(df, ["none", "canonical", "variant"]) == "canonical" and first_existing(df, ["none"]) is None


def test_required_columns_by_edition(spark):
    import pytest
    from arealens.operators.area import type_listings
    df = spark.createDataFrame([("10", "90001")], "price string, ZIP_CODE string")
    assert type_listings(df, "external").count() == 1
    with pytest.raises(ValueError):
        type_listings(df, "v3")


def test_vif_of_twins_is_infinite():
    from arealens.plans.moments import vif_from_corr
    r = np.array([[1.0, 1.0, 0.2], [1.0, 1.0, 0.2], [0.2, 0.2, 1.0]])
    got = dict(vif_from_corr(["a", "b", "c"], r))
    assert got["a"] == got["b"] == float("inf") and abs(got["c"] - 1 / (1 - 0.04)) < 1e-9
