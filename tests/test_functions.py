"""Edge tables from FIXTURES.md section 4: text casts, postal codes, z-scores,
composite indices, rates, flags, quantile bins, duplicate and constant checks."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arealens.functions import scalar as S
from arealens.operators import features as FT
from arealens.operators import selection as SEL
from arealens.operators.binned import binned_means
from arealens.operators.quantiles import exact_quantiles


def test_safe_numeric(spark):
    vals = ["12", " 12 ", "1e3", ".5", "+3", "$100", "1,000", "12d", "1D", "0x10", "1_000", "nan", "inf",
            "", "   ", None, "#DIV/0!"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", S.safe_numeric("v").alias("x")).collect()}
    expect = [12.0, 12.0, 1000.0, 0.5, 3.0] + [None] * 12
    assert [got[i] for i in range(len(vals))] == expect


def test_standardize_zip(spark):
    vals = ["9999", "10000", "99999", "100000", "90210.0", "90210.5", "abc", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r["z"] for r in df.select("i", S.standardize_zip("v").alias("z")).orderBy("i").collect()]
    assert got == [None, 10000, 99999, None, 90210, None, None, None]


def test_zscore_guard_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 1.0), (3, 5.0, 3.0), (4, None, float("nan"))],
                               "i int, c double, m double")
    st = FT.moments(df, ["c", "m"])
    out = df.withColumns({"zc": FT.zscore_expr("c", *st["c"]), "zm": FT.zscore_expr("m", *st["m"])})
    rows = {r["i"]: r for r in out.collect()}
    assert all(rows[i]["zc"] == 0.0 for i in rows)          # constant column -> all zeros, nulls too
    assert rows[1]["zm"] is None and rows[4]["zm"] is None  # NaN is treated as missing
    assert math.isclose(rows[2]["zm"], (1 - 2) / math.sqrt(2)) and math.isclose(rows[3]["zm"], 1 / math.sqrt(2))
    one = spark.createDataFrame([(1.0,)], "x double")
    st1 = FT.moments(one, ["x"])
    assert one.select(FT.zscore_expr("x", *st1["x"]).alias("z")).first()["z"] == 0.0  # single row


def test_composites(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 1.0, None, 3.0), (3, None, None, None)],
                               "i int, a double, b double, c double")
    parts = [F.col("a"), F.col("b"), F.col("c")]
    out = {r["i"]: r for r in df.select("i", FT.composite_strict(parts).alias("s"),
                                        FT.composite_skip_null(parts).alias("k")).collect()}
    assert out[1]["s"] == 2.0 and out[1]["k"] == 2.0
    assert out[2]["s"] is None and out[2]["k"] == 2.0
    assert out[3]["s"] is None and out[3]["k"] is None


def test_rates_and_flags(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0, None), (2, 10.0, None, "shots fired"),
                                (3, None, 5.0, "Stolen VEHICLE assault"), (4, 10.0, 5.0, "nothing")],
                               "i int, c double, p double, d string")
    out = {r["i"]: r for r in df.select(
        "i", S.per_capita("c", "p").alias("r"), S.pattern_flag("d", S.VIOLENT_PATTERN).alias("v"),
        S.pattern_flag("d", S.PROPERTY_PATTERN).alias("pr")).collect()}
    assert out[1]["r"] is None and out[2]["r"] is None and out[3]["r"] is None and out[4]["r"] == 2.0
    assert (out[1]["v"], out[1]["pr"]) == (0, 0)
    assert (out[2]["v"], out[2]["pr"]) == (1, 0)
    assert (out[3]["v"], out[3]["pr"]) == (1, 1)
    assert (out[4]["v"], out[4]["pr"]) == (0, 0)


def test_quantile_bins_example(spark):
    xs = [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(xs)], "x double, y double")
    q = exact_quantiles(df, ["x"], [0, 0.25, 0.5, 0.75, 1.0])["x"]
    assert sorted(set(q)) == [1.0, 3.5, 6.25, 8.0]
    out = binned_means(df, "x", "y", q=4, min_rows=1, min_distinct=1, min_bins=1).orderBy("bin").collect()
    assert [r["n"] for r in out] == [6, 3, 3]


def test_bucketed_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 2.5)])  # a third of the rows share a value
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, ["x"], probs, bins=7)["x"]  # several passes
    assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_drop_null_constant_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, 1.0, 1.0), (1.0, None, 4.0, None, None), (1.0, None, 5.0, 2.0, 2.0)],
                               "k double, n double, v double, a double, b double")
    kept, all_null, constant = SEL.drop_all_null_and_constant(df, df.columns)
    assert all_null == ["n"] and constant == ["k"] and kept == ["v", "a", "b"]
    out, warning, _ = SEL.duplicate_guard(df, "a", "b")
    assert "b" not in out.columns and "identical" in warning


def test_predictor_list_operators():
    preds = ["crime_events", "crime_events_per_capita", "Count_Part_1_Crime", "Population", "room_type_x"]
    pruned = SEL.prune_redundant(preds, [("crime_events", "crime_events_per_capita"),
                                         ("Count_Part_1_Crime", "Crime_Per_Capita")])
    assert pruned == ["crime_events_per_capita", "Count_Part_1_Crime", "Population", "room_type_x"]
    assert SEL.exclude_patterns(["log_population", "ROOM_share", "host_x", "Median_Price"],
                                ["room", "host", "Median_"]) == ["log_population"]
    cols = ["a_Distance_June", "b_distance_Sept", "c", "ZIP_CODE"]
    assert SEL.name_group(cols, exclude_substr=("Sept",)) == ["a_Distance_June"]
    assert SEL.assemble_predictors(["x", "y", "d1", "centrality_index"], ["x", "z", "x"], "all_distances",
                                   ["d1"]) == ["x", "d1"]
