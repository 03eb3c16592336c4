"""Steps whose work must not grow faster than the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens import catalog
from arealens.operators import ordering as O
from arealens.plans import area_model as AM
from arealens.plans import preprocess as P
from arealens.plans import trees as T
from arealens.plans import wide as W
from arealens.session import METHOD_LIMIT


def test_queries_bound_the_generated_methods(spark, monkeypatch):
    spark.conf.unset(METHOD_LIMIT[0])
    seen = []
    monkeypatch.setitem(catalog.QUERIES, "probe", None)
    catalog.query("probe")(lambda s, d: seen.append(s.conf.get(METHOD_LIMIT[0])))
    catalog.QUERIES["probe"](spark, "")
    assert seen == ["8000"]


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("rank_rows", [5, 20_000])
def test_keys_at_hash_ranks(spark, monkeypatch, kind, rank_rows):
    monkeypatch.setattr(O, "RANK_ROWS", rank_rows)
    monkeypatch.setattr(O, "MOST_BUCKETS", 64)
    df = spark.range(900).select(F.when(F.col("id") % 300 != 7, F.col("id")).cast(kind).alias("k"))
    df = df.withColumn("__h", O.perm_hash(df, "k", 42))
    rows = [tuple(r) for r in df.select("__h", "k").orderBy("__h", "k").collect()]
    placed, counts = O.hash_bins(df, "__h", "k")
    assert sum(counts.values()) == 900
    ranks = [0, 5, 179, 540, 899]
    assert O.keys_at_hash_ranks(placed, counts, "__h", "k", ranks) == {r: rows[r] for r in ranks}


def test_split_and_folds_place_rows_without_comparing_cuts(spark, monkeypatch):
    """More rows than the driver sorts: their bins come from arithmetic, not from a comparison with each cut."""
    monkeypatch.setattr(O, "RANK_ROWS", 100)
    monkeypatch.setattr(O, "add_bucket", None)
    df = spark.range(5000).withColumnRenamed("id", "k")
    split, n = P.holdout_split(df, "k", 0.2, 42)
    assert n == 5000 and split.where("is_test").count() == 1000
    folds, _ = P.kfold(df, "k", 5, 42)
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [1000] * 5


def test_wide_means_and_scales_from_two_passes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 5))
    x[:, 3] = x[:, 0] * 2 + rng.standard_normal(400) * 0.1
    rows = [[None if i % 50 == 1 and j == 1 else float("nan") if i % 50 == 2 and j == 2 else float(v) for j, v in enumerate(r)]
            for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(5))).repartition(5)
    held = np.array([[np.nan if v is None else v for v in r] for r in rows])
    assert W._means(df, df.columns) == pytest.approx(np.nanmean(held, axis=0))
    got = {(r["feature_1"], r["feature_2"]): r["pearson_r"] for r in W.wide_correlation_pairs(df, df.columns, 0.0, block=2).collect()}
    c = np.nan_to_num(held - np.nanmean(held, axis=0))
    r = (c.T @ c) / np.sqrt(np.outer((c * c).sum(axis=0), (c * c).sum(axis=0)))
    assert got == pytest.approx({(f"c{i}", f"c{j}"): r[i, j] for i in range(5) for j in range(i + 1, 5)})


def test_ridge_reads_the_area_rows_twice(spark):
    """Once for the means and once to keep them; folds, positions and sums are passes over the kept rows."""
    read = spark.sparkContext.accumulator(0)

    def note(v):
        read.add(1)
        return v

    noted = F.udf(note, "double").asNondeterministic()
    df = spark.range(200).select(F.col("id").alias("ZIP_CODE"), (F.col("id") % 13).cast("double").alias("a"),
                                 F.log1p(F.col("id") % 29).alias("b"))
    df = df.withColumn("a", noted("a")).withColumn(AM.LOG_TARGET, F.col("b") * 2 + F.col("ZIP_CODE") % 5)
    AM.ridge_cv(df, ["a", "b"])
    assert read.value <= 2 * 200


def test_training_tasks():
    assert [T.training_tasks(n, 12) for n in (10, 50_000, 900_000, 5_000_000)] == [1, 3, 12, 12]
    assert T.training_tasks(30_000_000, 12) == 61  # a task's rows stay bounded


def test_a_fit_has_two_tries_at_most_and_spreads_its_rows(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    monkeypatch.setattr(T, "FIRST_TREES", 2)
    monkeypatch.setattr(T, "ROWS_PER_TASK", 100)
    tries, plain = [], GBTRegressor.fit

    def fit(self, data, *rest):
        tries.append((self.getMaxIter(), data.rdd.getNumPartitions()))
        return plain(self, data, *rest)

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    df = spark.range(0, 600, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("a"))
    df = df.withColumn("y", F.sin("a"))
    model = T.fit_boosted(df, ["a"], [], "y", max_iter=12, max_leaves=4, min_leaf=5, key="k", early=True)
    tasks = T.training_tasks(600, spark.sparkContext.defaultParallelism)
    assert tries == [(2, tasks), (12, tasks)] and len(model.losses) == 12


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_permutation_brings_the_values_of_the_donor_without_a_join(spark, kind):
    rows = [(None if i % 50 == 7 else i // 2 * 2 if i % 30 < 2 else i, float(i) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, v double").select(F.col("k").cast(kind).alias("k"), "v").repartition(3)
    got = O.permutation_donors(df, "k", 5, values=["v"])
    donors = O.permutation_donors(df, "k", 5)
    want = donors.join(df.select(F.col("k").alias("donor_key"), "v"), "donor_key").select("k", "donor_key", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    joins = [d._jdf.queryExecution().optimizedPlan().toString().count("Join ") for d in (got, donors)]
    assert joins[0] == joins[1]


def test_the_permutation_query_derives_its_rows_once(spark, monkeypatch, tmp_path):
    source = str(tmp_path / "rows")
    spark.range(400).select(F.col("id").alias("listing_id"), (F.col("id") * 1.5).alias("price")).write.parquet(source)
    monkeypatch.setattr(catalog, "listings", lambda s, d, e: s.read.parquet(source))
    out = catalog.QUERIES["w02_permutation"](spark, "")
    assert not any(source in f for f in out.inputFiles())
    rows = out.collect()
    assert sorted(r["listing_id"] for r in rows) == sorted(r["donor_key"] for r in rows) == list(range(400))
    assert all(r["permuted_price"] == 1.5 * r["donor_key"] for r in rows)


def test_fits_side_by_side_share_the_cores(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    monkeypatch.setattr(T, "ROWS_PER_TASK", 10)
    tasks, plain = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data: tasks.append(data.rdd.getNumPartitions()) or plain(self, data))
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    T.fit_boosted(df, ["a"], [], "y", max_iter=2, max_leaves=4, min_leaf=5, side_by_side=5)
    assert tasks == [max(1, spark.sparkContext.defaultParallelism // 5)]


def test_boosted_rows_are_derived_once(spark, monkeypatch, tmp_path):
    source, seen = str(tmp_path / "rows"), []
    rows = spark.range(300).select(F.col("id").alias("listing_id"), F.lit("90001").alias("ZIP_CODE"), F.lit("June").alias("month"),
                                   F.sin("id").alias("log_price"), (F.col("id") % 9).cast("double").alias("LATITUDE"))
    rows.write.parquet(source)
    monkeypatch.setattr(catalog, "listings", lambda s, d, e: s.read.parquet(source))
    monkeypatch.setattr(catalog.A, "attach_area", lambda listings, area: listings)
    monkeypatch.setattr(catalog.A, "area_table", lambda *a: None)
    monkeypatch.setattr(catalog.FX, "area_target_raw", lambda *a: None)
    monkeypatch.setattr(catalog.FX, "incidents_raw", lambda *a: None)
    monkeypatch.setattr(T, "fit_boosted", lambda train, *a, **k: seen.append(train))
    _, train, test, features, _, _ = catalog.boosted(spark, "", "external")
    assert features == ["LATITUDE", "month_september"] and train.count() == 240 and test.count() == 60
    assert not any(source in f for d in (seen[0], train, test) for f in d.inputFiles())
