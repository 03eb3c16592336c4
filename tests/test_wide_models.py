"""Orthogonal least squares, absorbed factors, wide correlation, collinear sets, CSV audit, samples, best iteration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.operators.ordering import perm_hash, seeded_sample
from arealens.plans import trees as T
from arealens.plans.absorb import fit_absorbed
from arealens.plans.design import DesignTerm, build_design, levels
from arealens.plans.linear import fit_ols
from arealens.plans.moments import vif_from_corr
from arealens.plans.qr import fit_ols_qr
from arealens.plans.wide import wide_correlation_pairs
from arealens.sources.tables import csv_counters, read_csv_audited


def frame(spark, data, schema, parts=6):
    return spark.createDataFrame(data, schema).repartition(parts)


# --- orthogonal least squares -----------------------------------------------------

def test_qr_solves_what_the_normal_equations_cannot(spark):
    """Two columns that differ by one part in 1e10: condition about 1e10."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal(400)
    b = a + 1e-10 * rng.standard_normal(400)
    y = 1.0 + 2.0 * a + 3e4 * (b - a)
    df = frame(spark, [(float(p), float(q), float(r)) for p, q, r in zip(a, b, y)], "a double, b double, y double")
    terms = build_design(numeric=["a", "b"])
    res = fit_ols_qr(df, terms, "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(400), a, b]), y, rcond=None)[0]
    assert res.metrics["condition_number"] > 1e9 and res.rank == 3
    fitted = np.column_stack([np.ones(400), a, b]) @ res.coef
    np.testing.assert_allclose(fitted, y, atol=1e-6)
    np.testing.assert_allclose(res.coef, want, rtol=1e-3)
    wrong = fit_ols(df, terms, "y")
    assert np.abs(np.column_stack([np.ones(400), a, b]) @ wrong.coef - y).max() > 1e-6


def test_qr_coefficients_at_condition_1e10(spark):
    """Powers of a variable around 1,000; the truth from exact fractions."""
    from fractions import Fraction
    x = [Fraction(k, 7) + 1000 for k in range(40)]
    beta = [Fraction(3), Fraction(-2), Fraction(5, 4)]
    y = [sum(b * v ** d for d, b in enumerate(beta)) for v in x]
    df = frame(spark, [(float(v), float(w)) for v, w in zip(x, y)], "x double, y double", 3)
    terms = [DesignTerm(f"x^{d}", F.pow("x", F.lit(float(d)))) for d in range(3)]
    res = fit_ols_qr(df, terms, "y")
    scaled = np.column_stack([np.array([float(v) for v in x]) ** d for d in range(3)])
    assert np.linalg.cond(scaled) > 1e10
    np.testing.assert_allclose(scaled @ res.coef, [float(w) for w in y], rtol=1e-12)
    np.testing.assert_allclose(res.coef[2], 1.25, rtol=1e-6)


def test_qr_equals_the_normal_equations_where_both_hold(spark):
    rng = np.random.default_rng(2)
    data = [(float(a), float(b), float(1 + a - 2 * b + e)) for a, b, e in rng.standard_normal((300, 3))]
    df = frame(spark, data, "a double, b double, y double", 40)  # a tree of several levels
    terms = build_design(numeric=["a", "b"])
    one, two = fit_ols_qr(df, terms, "y"), fit_ols(df, terms, "y")
    np.testing.assert_allclose(one.coef, two.coef, rtol=1e-9)
    np.testing.assert_allclose(one.std_err, two.std_err, rtol=1e-8)
    assert one.metrics["rsquared"] == pytest.approx(two.metrics["rsquared"])
    twin = build_design(numeric=["a", "b"]) + [DesignTerm("twin", F.col("a"))]
    assert fit_ols_qr(df, twin, "y").rank == 3


# --- absorbed factors --------------------------------------------------------------

def grouped(n=900, seed=3):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.35, 0, rng.integers(0, 25, n))  # one level with a third of all rows
    h = rng.integers(0, 9, n)
    x = rng.standard_normal((n, 2)) + g[:, None] * 0.1 + h[:, None] * 0.05
    y = x @ [1.5, -0.5] + np.sin(g) * 3 + np.cos(h) * 2 + rng.standard_normal(n) * (1 + np.abs(x[:, 0]))
    return [(f"g{a}", f"h{b}", float(p), float(q), float(r)) for a, b, (p, q), r in zip(g, h, x, y)]


SCHEMA = "g string, h string, x1 double, x2 double, y double"


def test_one_absorbed_factor_equals_the_dense_fit(spark):
    df = frame(spark, grouped() + [(None, "h0", None, 1.0, 2.0)], SCHEMA)
    fit = fit_absorbed(df, ["x1", "x2"], ["g"], "y")
    dense_rows = df.dropna()
    dense = fit_ols(dense_rows, build_design(numeric=["x1", "x2"], categorical=["g"], level_map=levels(dense_rows, ["g"])), "y")
    at = [dense.names.index(n) for n in ("x1", "x2")]
    np.testing.assert_allclose(fit.coef, dense.coef[at], rtol=1e-9)
    np.testing.assert_allclose(np.sqrt(np.diag(fit.cov)), dense.std_err[at], rtol=1e-7)
    assert fit.n == 900 and fit.levels == 25 and fit.ssr == pytest.approx(dense.ssr)
    effects = {r["level"]: r["effect"] for r in fit.effects.collect()}
    base = dense.coef[dense.names.index("Intercept")]
    assert effects["g0"] == pytest.approx(base)
    assert effects["g7"] == pytest.approx(base + dense.coef[dense.names.index("C(g)[T.g7]")])


def test_two_absorbed_factors_equal_the_dense_fit(spark):
    df = frame(spark, grouped(), SCHEMA)
    fit = fit_absorbed(df, ["x1", "x2"], ["g", "h"], "y")
    dense = fit_ols(df, build_design(numeric=["x1", "x2"], categorical=["g", "h"], level_map=levels(df, ["g", "h"])), "y")
    np.testing.assert_allclose(fit.coef, dense.coef[[dense.names.index(n) for n in ("x1", "x2")]], rtol=1e-6)


def test_a_hundred_thousand_levels(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("level"), F.sin(F.col("id").cast("double")).alias("x"))
    df = df.withColumn("y", 2.5 * F.col("x") + F.cos(F.col("level").cast("double")))
    fit = fit_absorbed(df, ["x"], ["level"], "y")
    assert fit.levels == 100_000 and fit.coef[0] == pytest.approx(2.5, abs=1e-9)


# --- wide correlation ----------------------------------------------------------------

def test_blocked_correlation_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 30))
    x[:, 7] = x[:, 3] * 2 + 0.1 * x[:, 7]
    x[:, 29] = -x[:, 0]
    x[:, 11] = 4.0
    names = [f"c{i}" for i in range(30)]
    df = frame(spark, [tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names), 20)
    got = {(r["feature_1"], r["feature_2"]): r["pearson_r"] for r in wide_correlation_pairs(df, names, 0.15, block=7).collect()}
    with np.errstate(invalid="ignore"):
        r = np.corrcoef(x.T)
    want = {(names[i], names[j]): r[i, j] for i in range(30) for j in range(i + 1, 30) if abs(r[i, j]) >= 0.15}
    assert set(got) == set(want)
    for pair in want:
        assert got[pair] == pytest.approx(want[pair])
    assert wide_correlation_pairs(df, names[:1], 0.1).count() == 0


def test_two_thousand_columns(spark):
    base = F.col("id").cast("double")
    df = spark.range(300).repartition(3).select(*[F.sin(base * (1 + i // 2) * 0.37 + (i % 2) * 1e-3).alias(f"c{i}") for i in range(2000)])
    found = wide_correlation_pairs(df, df.columns, 0.9999).collect()
    assert {(f"c{2 * i}", f"c{2 * i + 1}") for i in range(1000)} <= {(r["feature_1"], r["feature_2"]) for r in found}


# --- collinear sets ---------------------------------------------------------------------

def test_vif_of_dependent_sets():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 6))
    x = np.column_stack([x, x[:, 0] + x[:, 1], x[:, 2], np.ones(500)])
    with np.errstate(invalid="ignore"):
        r = np.corrcoef(x.T)
    got = dict(vif_from_corr([f"c{i}" for i in range(9)], r))
    assert all(math.isinf(got[f"c{i}"]) for i in (0, 1, 6, 2, 7)) and math.isnan(got["c8"])
    for i in (3, 4, 5):
        others = [j for j in range(6) if j != i]
        z = np.column_stack([np.ones(500), x[:, others]])
        e = x[:, i] - z @ np.linalg.lstsq(z, x[:, i], rcond=None)[0]
        assert got[f"c{i}"] == pytest.approx(x[:, i].var() / e.var())
    assert vif_from_corr(["a"], np.ones((1, 1))) == [("a", 1.0)]


# --- CSV audit ----------------------------------------------------------------------------

def test_csv_audit(spark, tmp_path):
    path = tmp_path / "edge.csv"
    path.write_text('key,name,segment\n1,plain,A\n2,"with, comma",B\n3,"two\nlines",C\n4,short\n5,long,D,surplus,more\n6,"a ""quote""",\n7\n'
                    '8,"short and\nbroken"\n9,,,surplus\n10,"",A\n')
    got = read_csv_audited(spark, str(path), ["key", "name", "segment"])
    rows = {r["key"]: (r["name"], r["segment"], r["record_state"]) for r in got.collect()}
    assert rows == {"1": ("plain", "A", "ok"), "2": ("with, comma", "B", "ok"), "3": ("two\nlines", "C", "ok"), "4": ("short", None, "short"),
                    "5": ("long", "D", "long"), "6": ('a "quote"', None, "ok"), "7": (None, None, "short"), "8": ("short and\nbroken", None, "short"), "9": (None, None, "long"), "10": (None, "A", "ok")}
    assert csv_counters(got).first().asDict() == {"records": 10, "complete": 5, "short": 3, "long": 2, "with_line_break": 2}


# --- seeded sample ---------------------------------------------------------------------------

def test_sample_does_not_depend_on_the_division(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    one = {r["k"] for r in seeded_sample(df.repartition(9), "k", 50, 7).collect()}
    assert one == {r["k"] for r in seeded_sample(df.coalesce(1), "k", 50, 7).collect()} and len(one) == 50
    assert one == {r["k"] for r in df.orderBy(perm_hash(df, "k", 7), "k").limit(50).collect()}
    assert seeded_sample(df, "k", 5000, 7).count() == 2000


# --- best iteration ---------------------------------------------------------------------------

def test_best_iteration():
    falling = [1 / (i + 1) for i in range(30)]
    assert T.best_iteration(falling) == (29, False)
    assert T.best_iteration([5, 4, 3, 3.5, 3.4, 3.3, 2.9], patience=3) == (2, True)
    assert T.best_iteration([5, 4, 3, 3.5, 3.4, 2.9], patience=3) == (5, False)
    assert T.best_iteration([1.0] * 12) == (0, True)
    assert T.best_iteration([]) == (0, False)


def test_boosting_is_cut_at_the_best_iteration(spark, monkeypatch):
    monkeypatch.setattr(T, "FIRST_TREES", 8)
    rng = np.random.default_rng(12)
    x = rng.random((600, 2))
    y = np.abs(x[:, 0] - 0.5) + rng.standard_normal(600) * 0.3
    df = frame(spark, [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "k bigint, a double, b double, y double")
    fit = T.fit_boosted(df, ["a", "b"], [], "y", step_size=0.3, max_iter=40, max_leaves=8, min_leaf=5, key="k", early=True)
    best, ended = T.best_iteration(fit.losses)
    assert fit.model.getNumTrees == best + 1 and (ended or len(fit.losses) == 40)
    held = df.where(T._held_out("k", T.EARLY_SHARE, 42))
    loss = fit.predict(held).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert loss == pytest.approx(fit.losses[best], rel=1e-6)
    with pytest.raises(ValueError):
        T.fit_boosted(df, ["a"], [], "y", early=True)
