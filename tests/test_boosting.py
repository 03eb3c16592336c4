"""The boosted trees against MLlib's, where they end, and importance without copies of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.plans import boosting as B
from arealens.plans import trees as T


def table(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.random(n), rng.integers(0, 6, n), rng.integers(0, 900, n)
    y = 3 + np.abs(a - 0.5) + (b == 2) * 0.4 + np.sin(c / 90) + rng.standard_normal(n) * 0.2
    rows = [(i, float(p), f"g{q}" if q else None, float(r) if r % 17 else None, float(v)) for i, (p, q, r, v) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, "k bigint, a double, g string, c double, y double")


@pytest.mark.parametrize("held", [False, True])
def test_trees_are_those_of_mllib(spark, held, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    monkeypatch.setattr(B, "BLOCK", 700)
    monkeypatch.setattr(B, "ROWS_PER_TASK", 1400)
    monkeypatch.setattr(B, "RENEW", 2)
    monkeypatch.setattr(B, "REBUILD", 4)
    df = table(spark, 4000)
    data = T.fit_preprocessor(df, ["a", "c"], ["g"]).features(df).select("__features", "y", (F.col("k") % 9 == 0).alias("away"))
    data = data.repartition(3).persist()
    kw = dict(featuresCol="__features", labelCol="y", stepSize=0.1, maxDepth=4, minInstancesPerNode=20, seed=1, maxBins=255, maxIter=7)
    boosting = B.HistogramBoosting(**kw).start("away" if held else None)
    ours = boosting.fit(data)
    theirs = GBTRegressor(**kw).fit(data.where("not away") if held else data)
    both = theirs.transform(data).withColumnRenamed("prediction", "want")
    both = ours.transform(both)
    assert both.agg(F.max(F.abs(F.col("want") - F.col("prediction")))).first()[0] < 1e-9
    assert theirs.getNumTrees == ours.getNumTrees == 7
    if held:
        assert boosting.grower.losses == pytest.approx(list(theirs.evaluateEachIteration(data.where("away"), "squared")), rel=1e-9)
    boosting.grower.close()


def test_bins_of_many_values_follow_mllib(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    df = table(spark, 3000)
    data = T.fit_preprocessor(df, ["a", "c"], []).features(df).select("__features", "y").persist()
    kw = dict(featuresCol="__features", labelCol="y", maxDepth=6, minInstancesPerNode=5, seed=1, maxBins=20)
    want = DecisionTreeRegressor(**kw).fit(data).transform(data).withColumnRenamed("prediction", "want")
    got = B.HistogramBoosting(maxIter=1, **kw).fit(data).transform(want)
    assert got.agg(F.max(F.abs(F.col("want") - F.col("prediction")))).first()[0] < 1e-9


def test_no_tree_is_grown_after_the_end_or_twice(spark, monkeypatch):
    monkeypatch.setattr(T, "FIRST_TREES", 4)
    grown, plain = [], B.Grower._tree
    monkeypatch.setattr(B.Grower, "_tree", lambda self: grown.append(1) or plain(self))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(rng.standard_normal((900, 2)))], "k bigint, a double, y double")
    model = T.fit_boosted(df, ["a"], [], "y", step_size=0.3, max_iter=60, max_leaves=8, min_leaf=5, key="k", early=True)
    best, ended = T.best_iteration(model.losses)
    assert ended and len(grown) == len(model.losses) == best + 1 + T.EARLY_PATIENCE < 60
    assert model.model.getNumTrees == best + 1


def test_importance_by_pairs_is_that_of_copies(spark):
    df = table(spark, 1500)
    # keys that repeat pair as often as before
    df = df.withColumn("k", F.when(F.col("k") < 20, F.col("k") % 10).otherwise(F.col("k")))
    model = T.fit_boosted(df.where("k % 5 <> 0"), ["a", "c"], ["g"], "y", step_size=0.2, max_iter=12, max_leaves=8, min_leaf=5)
    test, calls = df.where("k % 5 = 0"), []

    def predict(rows):
        calls.append(1)
        return model.predict(rows)

    r2, want = T.permutation_importance(test, "k", ["a", "g", "c"], "y", predict, repeats=3)
    calls.clear()
    again, got = T.permutation_importance(test, "k", ["a", "g", "c"], "y", predict, repeats=3, model=model)
    assert len(calls) == 1 and again == pytest.approx(r2, rel=1e-12)
    assert [f for f, *_ in got] == [f for f, *_ in want]
    for (_, *x), (_, *z) in zip(got, want):
        assert x == pytest.approx(z, rel=1e-8, abs=1e-10)
