"""Registered queries: one per operator (or operator group) of the inventory.

Every query reads the driver's tables (or data Spark derives from them) and
returns a DataFrame whose column names equal those of the matching SQL in
``oracle_queries``.  Doubles are rounded in both so sums taken in a different
order still compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .functions import scalar as S
from .operators import area as A
from .session import bound_methods
from .sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

LO, HI = FX.TRIM_LOW, FX.TRIM_HIGH

# ---------------------------------------------------------------------------
# The predictor lists of the model editions.
# ---------------------------------------------------------------------------
V1_PREDICTORS = [
    "minimum_nights", "number_of_reviews", "reviews_per_month", "calculated_host_listings_count",
    "availability_365", "number_of_reviews_ltm",
    "Count_Part_1_Crime", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
    "Count_Corrective_Facility", "Count_Education_Facility", "Population", "Crime_Per_Capita",
    "Education_Per_Capita", "Public_Safety_Per_Capita",
    "amenities_index", "crime_index", "education_index",
    "crime_events", "violent_crime_events", "property_crime_events", "part1_events",
    "crime_events_per_capita", "violent_crime_per_capita", "property_crime_per_capita", "part1_events_per_capita",
]
V1_REDUNDANT = [
    ("crime_events", "crime_events_per_capita"), ("violent_crime_events", "violent_crime_per_capita"),
    ("property_crime_events", "property_crime_per_capita"), ("part1_events", "part1_events_per_capita"),
    ("Count_Part_1_Crime", "Crime_Per_Capita"),
]
V1_TRENDS = [
    "Crime_Per_Capita", "Education_Per_Capita", "Public_Safety_Per_Capita", "crime_events_per_capita",
    "violent_crime_per_capita", "property_crime_per_capita", "amenities_index", "education_index", "crime_index",
]
V2_LISTING_CONTROLS = ["minimum_nights", "number_of_reviews", "reviews_per_month",
                       "calculated_host_listings_count", "availability_365", "number_of_reviews_ltm"]
V2_AREA_VARS = ["crime_events_per_capita", "Education_Per_Capita", "Public_Safety_Per_Capita", "amenities_index"]
V2_TRENDS = ["crime_events_per_capita", "Education_Per_Capita", "Public_Safety_Per_Capita", "amenities_index"]
V3_NUMERIC = [new for _, new in A.LOG1P_FEATURES] + ["accommodates", "bedrooms", "beds", "bathrooms",
                                                     "LATITUDE", "LONGITUDE"]
V3_AREA = ["crime_events_z", "Education_z", "Public_Safety_z", "amenities_index"]
V3_RATES = ["crime_events_per_10k", "Education_Per_10k", "Public_Safety_Per_10k"]
# Name fragments that mark a predictor as listing-level, not external.
FORBIDDEN = ["room", "bed", "bath", "accommodates", "review", "availability", "host", "minimum_nights",
             "property_type", "Median_"]
EXTERNAL_CANDIDATES = [
    "LATITUDE", "LONGITUDE",
    "log_population", "crime_z_cleaned", "crime_events_z", "violent_crime_z", "property_crime_z", "education_z",
    "public_safety_z", "external_amenities_index", "crime_per_10k_cleaned", "crime_events_per_10k",
    "violent_crime_per_10k", "property_crime_per_10k", "education_per_10k", "public_safety_per_10k",
    "Count_Corrective_Facility",
]


def query(name: str):
    def deco(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            bound_methods(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (the oracle SQL rounds the same columns);
    adding 0.0 turns a rounded -0.0 into 0.0."""
    return df.withColumns({f.name: F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)
                           for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))})


# ---------------------------------------------------------------------------
# Shared fixture builders
# ---------------------------------------------------------------------------
def typed_listings(spark, sf_dir, edition="v2"):
    june, sept = FX.listing_snapshots(spark, sf_dir)
    return A.type_listings(A.union_snapshots(june, sept), edition)


def listings(spark, sf_dir, edition="v2"):
    return A.clean_listings(typed_listings(spark, sf_dir, edition), edition, LO, HI)


def zip_all(spark, sf_dir, edition="v2", fill=True):
    return A.area_table(FX.area_features_raw(spark, sf_dir), FX.incidents_raw(spark, sf_dir),
                        edition, FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY, fill=fill)


def merged_v2(spark, sf_dir):
    m = A.attach_area(listings(spark, sf_dir, "v2"), zip_all(spark, sf_dir, "v2"))
    return A.require_core(m)


# ---------------------------------------------------------------------------
# Flagship: mean log price and incident rate by category and month
# ---------------------------------------------------------------------------
@query("q01_price_incident_by_category")
def q01(spark, sf_dir):
    m = merged_v2(spark, sf_dir)
    out = m.groupBy("room_type", "month").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.avg("log_price").alias("mean_log_price"),
        F.avg("crime_events_per_capita").alias("mean_incident_rate"),
        F.avg("amenities_index").alias("mean_amenities_index"),
        F.count_distinct("ZIP_CODE").alias("n_areas"),
    )
    return rounded(out)


@query("a01_incident_rollup")
def a01(spark, sf_dir):
    return A.incident_rollup(FX.incidents_raw(spark, sf_dir), FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY)


# ---------------------------------------------------------------------------
# Sources, schema repair, union
# ---------------------------------------------------------------------------
@query("s01_csv_roundtrip")
def s01(spark, sf_dir):
    from .session import scratch_path
    from .sources.tables import read_csv_text, write_table
    raw = FX.area_features_raw(spark, sf_dir)
    untidy = {"ZIP_Code": " ZIP_Code", "Population": "Population "}
    raw = raw.toDF(*[untidy.get(c, c) for c in raw.columns])
    path = write_table(raw, scratch_path(spark, "area_csv"), "csv")
    typed = A.type_area(read_csv_text(spark, path), "v2")
    return rounded(typed.select("ZIP_CODE", "Population", "Crime_Per_Capita", "Education_Per_Capita",
                                "Public_Safety_Per_Capita", "median_household_size"))


@query("s04_source_fallback")
def s04(spark, sf_dir):
    from .sources.tables import resolve_source, table_path
    path = resolve_source(spark, [table_path(sf_dir, "customer_snapshot"), table_path(sf_dir, "customer")])
    df = spark.read.parquet(path).select("c_mktsegment", "c_acctbal")
    return rounded(df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"),
                                                  F.avg("c_acctbal").alias("mean_acctbal")))


@query("s09_alias_harmonise")
def s09(spark, sf_dir):
    from .operators.selection import keep_existing
    from .sources.tables import harmonise
    typed = A.type_area(FX.area_target_raw(spark, sf_dir), "v2")
    kept = keep_existing(typed, ["ZIP_CODE"] + A.AREA_KEEP_EXTERNAL)
    return rounded(harmonise(kept, A.AREA_VARIANTS))


@query("u01_union_snapshots")
def u01(spark, sf_dir):
    june, sept = FX.listing_snapshots(spark, sf_dir)
    u = A.union_snapshots(june, sept)
    return u.groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.count("accommodates").alias("n_accommodates"),
                                  F.count("price").alias("n_price"))


@query("a02_listing_counters")
def a02_listing(spark, sf_dir):
    return A.listing_counters(typed_listings(spark, sf_dir), LO, HI)


@query("a02_incident_counters")
def a02_incident(spark, sf_dir):
    return rounded(A.incident_counters(FX.incidents_raw(spark, sf_dir), FX.FIXTURE_VIOLENT,
                                       FX.FIXTURE_PROPERTY))


# ---------------------------------------------------------------------------
# Projection, filters, scalar functions
# ---------------------------------------------------------------------------
@query("p01_leakage_drop_v1")
def p01_v1(spark, sf_dir):
    return rounded(A.type_area(FX.area_features_raw(spark, sf_dir), "v1"))


@query("p01_leakage_drop_v2")
def p01_v2(spark, sf_dir):
    return rounded(A.type_area(FX.area_features_raw(spark, sf_dir), "v2"))


@query("f01_listings_clean_v2")
def f01(spark, sf_dir):
    df = listings(spark, sf_dir, "v2")
    return rounded(df.select("listing_id", "ZIP_CODE", "room_type", "month", "price", "log_price",
                             "number_of_reviews", "reviews_per_month", "number_of_reviews_ltm",
                             "accommodates"))


@query("f01_listings_clean_external")
def f01_external(spark, sf_dir):
    """Only price and postal code are required: rows without a category stay."""
    return rounded(listings(spark, sf_dir, "external").select("listing_id", "ZIP_CODE", "month", "price", "log_price",
                                                              "LATITUDE", "LONGITUDE"))


@query("s12_first_existing")
def s12(spark, sf_dir):
    """Mean distance by the first facility-count column that the area file has."""
    from .sources.tables import first_existing
    typed = A.type_area(FX.area_target_raw(spark, sf_dir), "v2")
    name = first_existing(typed, ["Count_Education_Facility", "Count_Educational_Facility", "Count_Public_Safety"])
    d = F.col(f"`{FX.landmark_name(1)}`")
    return rounded(typed.groupBy(F.col(name).alias("facilities")).agg(
        F.lit(name).alias("column_used"), F.count(F.lit(1)).alias("n_areas"), F.avg(d).alias("mean_distance")))


@query("c04_listing_features_v3")
def c04(spark, sf_dir):
    df = listings(spark, sf_dir, "v3")
    return rounded(df.select("listing_id", *[new for _, new in A.LOG1P_FEATURES], "accommodates"))


@query("c09_text_flags_documents")
def c09(spark, sf_dir):
    from .sources.tables import load_table
    d = load_table(spark, sf_dir, "documents", ["source", "lang", "text", "n_chars"])
    return d.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(S.pattern_flag("text", S.VIOLENT_PATTERN)).alias("violent_docs"),
        F.sum(S.pattern_flag("text", S.PROPERTY_PATTERN)).alias("property_docs"),
        F.sum(S.pattern_flag("text", S.VIOLENT_PATTERN) * S.pattern_flag("text", S.PROPERTY_PATTERN))
         .alias("both_docs"),
        F.sum("n_chars").alias("total_chars"))


# ---------------------------------------------------------------------------
# Area features, joins and fills
# ---------------------------------------------------------------------------
@query("a03_area_features_v1")
def a03_v1(spark, sf_dir):
    return rounded(A.area_features(FX.area_features_raw(spark, sf_dir), "v1"))


@query("a03_area_features_v3")
def a03_v3(spark, sf_dir):
    return rounded(A.area_features(FX.area_features_raw(spark, sf_dir), "v3"))


@query("a03_area_features_external")
def a03_ext(spark, sf_dir):
    return rounded(A.area_features(FX.area_target_raw(spark, sf_dir), "external"))


@query("j01_area_incident_join_v2")
def j01(spark, sf_dir):
    return rounded(zip_all(spark, sf_dir, "v2", fill=False))


@query("a08_area_median_fill_v2")
def a08_area(spark, sf_dir):
    return rounded(zip_all(spark, sf_dir, "v2"))


@query("j02_listing_area_join_v2")
def j02(spark, sf_dir):
    m = merged_v2(spark, sf_dir)
    return rounded(m.select("listing_id", "ZIP_CODE", "log_price", "Population", "amenities_index",
                            "crime_events_per_capita", "crime_index"))


@query("j03_join_audit")
def j03(spark, sf_dir):
    from .operators.joins import join_audit
    return join_audit(listings(spark, sf_dir, "v2"), zip_all(spark, sf_dir, "v2"), "ZIP_CODE")


def merged_v1(spark, sf_dir):
    m = A.attach_area(listings(spark, sf_dir, "v1"), zip_all(spark, sf_dir, "v1"))
    return A.post_join_fill_v1(m)


@query("a08_listing_fill_v1")
def a08_listing(spark, sf_dir):
    m = merged_v1(spark, sf_dir)
    return rounded(m.select("listing_id", "number_of_reviews", "reviews_per_month", "accommodates",
                            "crime_events", "crime_events_per_capita", "part1_events_per_capita",
                            "amenities_index", "Crime_Per_Capita", "crime_index"))


# ---------------------------------------------------------------------------
# Binned trend, simple regression family (closed-form oracles)
# ---------------------------------------------------------------------------
@query("a12_binned_means_v2")
def a12(spark, sf_dir):
    from .operators.binned import RULES, binned_means
    return rounded(binned_means(merged_v2(spark, sf_dir), "Population", "price", **RULES["v2"]))


@query("a12_binned_means_v1")
def a12_v1(spark, sf_dir):
    from .operators.binned import RULES, binned_means
    return rounded(binned_means(listings(spark, sf_dir, "v2"), "minimum_nights", "price", **RULES["v1"]))


def simple_fit(spark, sf_dir):
    """log_price ~ minimum_nights on the cleaned v2 listings (HC3)."""
    from .plans.design import build_design
    from .plans.linear import fit_ols
    df = listings(spark, sf_dir, "v2").select("listing_id", "log_price", "price", "minimum_nights")
    terms = build_design(numeric=["minimum_nights"])
    return df, fit_ols(df, terms, "log_price")


def wide_simple_fit(spark, sf_dir):
    from .plans.design import build_design
    from .plans.linear import fit_ols
    w = FX.wide_frame(spark, sf_dir)
    return w, fit_ols(w, build_design(numeric=["l_quantity"]), "y")


@query("m03_ols_hc3_one_regressor")
def m03(spark, sf_dir):
    _, res = wide_simple_fit(spark, sf_dir)
    return rounded(res.coefficients(spark).drop("p_value"), 9)


@query("m08_linear_predict")
def m08(spark, sf_dir):
    df, res = simple_fit(spark, sf_dir)
    pred = res.prediction()
    return rounded(df.select("listing_id", pred.alias("pred_log_price"), F.exp(pred).alias("pred_price")))


@query("a14_regression_metrics")
def a14(spark, sf_dir):
    from .plans.metrics import regression_metrics
    df, res = simple_fit(spark, sf_dir)
    pred = res.prediction()
    d = df.select("log_price", "price", pred.alias("pred_log"), F.exp(pred).alias("pred_price"))
    return rounded(regression_metrics(d, "log_price", "pred_log", "price", "pred_price"))


@query("w01_durbin_watson")
def w01(spark, sf_dir):
    from .operators.ordering import durbin_watson
    df, res = simple_fit(spark, sf_dir)
    dw = durbin_watson(df, "listing_id", F.col("log_price") - res.prediction())
    m = res.metrics
    rows = [("durbin_watson", dw), ("skew", m["skew"]), ("kurtosis", m["kurtosis"]),
            ("jarque_bera", m["jarque_bera"]), ("rsquared", m["rsquared"])]
    return rounded(spark.createDataFrame(rows, "metric string, value double"))


@query("w02_permutation")
def w02(spark, sf_dir):
    from .operators.ordering import permutation_donors
    from .session import written
    df = listings(spark, sf_dir, "v2").select("listing_id", F.col("price").alias("permuted_price"))
    donors = permutation_donors(written(df, "permutation"), "listing_id", seed=42, values=["permuted_price"])
    return rounded(donors.select("donor_key", "listing_id", "permuted_price"))


# ---------------------------------------------------------------------------
# Design, full OLS (rows-only checks), preprocessing
# ---------------------------------------------------------------------------
@query("m01_design_sums")
def m01(spark, sf_dir):
    from .plans.design import build_design, levels
    m = merged_v2(spark, sf_dir)
    lv = levels(m, ["room_type", "month"])
    terms = build_design(numeric=["minimum_nights", "amenities_index"], categorical=["room_type", "month"],
                         interactions=[("room_type", "amenities_index")], level_map=lv)
    aggs = []
    for i, t in enumerate(terms):
        aggs += [F.sum(t.expr).alias(f"s{i}"), F.sum(t.expr * F.col("log_price")).alias(f"p{i}")]
    r = m.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    rows = [(t.name, r["n"], r[f"s{i}"], r[f"p{i}"]) for i, t in enumerate(terms)]
    return rounded(spark.createDataFrame(rows, "term string, n bigint, sum_x double, sum_xy double"), 4)


def v2_model(spark, sf_dir):
    from pyspark import StorageLevel
    from .plans.design import build_design, levels
    from .plans.linear import fit_ols
    m = merged_v2(spark, sf_dir)
    cols = ["log_price", "price", "room_type", "month"] + V2_LISTING_CONTROLS + V2_AREA_VARS
    frame = m.select(*cols).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    lv = levels(frame, ["room_type", "month"])
    terms = build_design(numeric=V2_LISTING_CONTROLS + V2_AREA_VARS, categorical=["room_type", "month"],
                         level_map=lv)
    return frame, fit_ols(frame, terms, "log_price")


@query("m05_ols_coefficients_v2")
def m05(spark, sf_dir):
    frame, res = v2_model(spark, sf_dir)
    frame.unpersist()
    coef = res.coefficients(spark)
    return rounded(coef.withColumns({"pct_effect_if_log_model": S.pct_effect("coef"),
                             "abs_coef": F.abs("coef")}).orderBy(F.desc("abs_coef"), "term"))


@query("m06_fit_statistics_v2")
def m06(spark, sf_dir):
    frame, res = v2_model(spark, sf_dir)
    frame.unpersist()
    return rounded(res.fit_table(spark).where(~F.col("metric").isin(NO_SQL_STATISTICS)), 4)


# The F tail, the omnibus test and the condition number have no SQL form.
NO_SQL_STATISTICS = ["f_pvalue", "omnibus", "omnibus_pvalue", "condition_number"]


@query("m07_residual_diagnostics_v2")
def m07(spark, sf_dir):
    frame, res = v2_model(spark, sf_dir)
    frame.unpersist()
    return res.fit_table(spark).where(F.col("metric").isin(NO_SQL_STATISTICS))


@query("m24_significant_terms_v2")
def m24(spark, sf_dir):
    frame, res = v2_model(spark, sf_dir)
    frame.unpersist()
    coef = res.coefficients(spark)
    sig = coef.where((F.col("p_value") < 0.05) & ~F.col("term").contains("Intercept"))
    return rounded((sig.withColumn("pct_effect_if_log_model", S.pct_effect("coef"))
            .orderBy(F.abs("coef").desc(), "term")))


def v1_model(spark, sf_dir):
    """The first edition: every control, count, rate and index, raw totals pruned
    where their rate is present.  Fire and police counts are equal and the indices
    follow from the counts, so the design has not full rank."""
    from pyspark import StorageLevel
    from .operators.selection import existing, prune_redundant
    from .plans.design import build_design, levels
    from .plans.linear import fit_ols
    m = merged_v1(spark, sf_dir)
    preds = prune_redundant(existing(m, V1_PREDICTORS), V1_REDUNDANT)
    frame = m.select("listing_id", "log_price", "price", "room_type", "month", *preds).dropna() \
             .persist(StorageLevel.MEMORY_AND_DISK)
    lv = levels(frame, ["room_type", "month"])
    return frame, preds, fit_ols(frame, build_design(numeric=preds, categorical=["room_type", "month"], level_map=lv),
                                 "log_price")


@query("m05_ols_coefficients_v1")
def m05_v1(spark, sf_dir):
    frame, _, res = v1_model(spark, sf_dir)
    frame.unpersist()
    return rounded(res.coefficients(spark).withColumn("abs_coef", F.abs("coef")).orderBy(F.desc("abs_coef"), "term"))


@query("m24_top_terms_v1")
def m24_v1(spark, sf_dir):
    """The report's twenty strongest significant terms."""
    frame, _, res = v1_model(spark, sf_dir)
    frame.unpersist()
    coef = res.coefficients(spark).withColumn("abs_coef", F.abs("coef"))
    return rounded((coef.where((F.col("p_value") < 0.05) & ~F.col("term").contains("Intercept"))
            .orderBy(F.desc("abs_coef"), "term").limit(20)))


@query("m17_ols_predictions_v1")
def m17_v1(spark, sf_dir):
    """Fitted values do not depend on which solution of a deficient design is taken."""
    frame, _, res = v1_model(spark, sf_dir)
    out = frame.select("listing_id", "price", "log_price", res.prediction().alias("predicted_log_price"))
    frame.unpersist()
    return rounded(out.withColumn("predicted_price", S.back_transform("predicted_log_price")), 5)


@query("m25_trend_tables_v1")
def m25_v1(spark, sf_dir):
    """The nine trend charts' data: mean price by quantile bin of each feature."""
    from .operators.binned import RULES, trend_table
    return rounded(trend_table(merged_v1(spark, sf_dir), V1_TRENDS, "price", **RULES["v1"]), 5)


@query("m25_trend_tables_v2")
def m25_v2(spark, sf_dir):
    from .operators.binned import RULES, trend_table
    return rounded(trend_table(merged_v2(spark, sf_dir), V2_TRENDS, "price", **RULES["v2"]), 5)


@query("s06_diagnostics_report_v2")
def s06(spark, sf_dir):
    """Every counter of the build as one (section, metric, value) table."""
    from pyspark import StorageLevel
    area = zip_all(spark, sf_dir, "v2").persist(StorageLevel.MEMORY_AND_DISK)
    rows = A.build_counters(typed_listings(spark, sf_dir), FX.incidents_raw(spark, sf_dir), area, LO, HI,
                            FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY)
    area.unpersist()
    return rounded(spark.createDataFrame(rows, "section string, metric string, value double"))


def _split(spark, sf_dir):
    from .plans.preprocess import holdout_split
    df = listings(spark, sf_dir, "v2")
    return holdout_split(df, "listing_id", 0.2, 42)[0]


@query("m09_holdout_split")
def m09(spark, sf_dir):
    s = _split(spark, sf_dir)
    return rounded(s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.avg("log_price").alias("mean_log_price")))


@query("m10_kfold_assignment")
def m10(spark, sf_dir):
    from .plans.preprocess import kfold
    f, _ = kfold(listings(spark, sf_dir, "v2"), "listing_id", 5, 42)
    return rounded(f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("log_price").alias("mean_log_price"),
                                         F.min("listing_id").alias("min_key")))


SCALED = ["minimum_nights", "availability_365", "reviews_per_month"]


@query("m11_standard_scaler")
def m11(spark, sf_dir):
    from .plans.preprocess import apply_scaler, fit_scaler
    s = _split(spark, sf_dir)
    params = fit_scaler(s.where(~F.col("is_test")), SCALED)
    t = apply_scaler(s.where(F.col("is_test")), params)
    r = t.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(SCALED)],
              *[F.max(c).alias(f"x{i}") for i, c in enumerate(SCALED)]).first()
    rows = [(c, params[c][0], params[c][1], r[f"a{i}"], r[f"x{i}"]) for i, c in enumerate(SCALED)]
    return rounded(spark.createDataFrame(
        rows, "feature string, train_mean double, train_std double, test_scaled_mean double, test_scaled_max double"))


@query("m12_median_imputer")
def m12(spark, sf_dir):
    from .plans.preprocess import apply_imputer, fit_median_imputer
    s = _split(spark, sf_dir)
    fills = fit_median_imputer(s.where(~F.col("is_test")), ["accommodates", "number_of_reviews"])
    t = apply_imputer(s.where(F.col("is_test")), fills)
    return rounded(t.select("listing_id", "accommodates", "number_of_reviews"))


@query("m13_mode_imputer")
def m13(spark, sf_dir):
    """The most frequent category of the June rows fills the September rows."""
    from .plans.preprocess import apply_imputer, fit_mode
    typed = typed_listings(spark, sf_dir)
    required, trim = A.listing_filters("external", LO, HI)
    rows = typed.where(required & trim)
    mode, _ = fit_mode(rows.where("month = 'June'"), "room_type")
    return apply_imputer(rows.where("month = 'September'"), {"room_type": mode}).select("listing_id", "room_type")


@query("m14_onehot_unknown_level")
def m14(spark, sf_dir):
    from .plans.preprocess import fit_onehot, onehot_columns
    df = listings(spark, sf_dir, "v2").withColumn(
        "price_band", F.floor(F.col("price") / 100).cast("bigint").cast("string"))
    lv = fit_onehot(df.where(F.col("price") < 400), "price_band")
    cols = onehot_columns("price_band", lv)
    enc = df.withColumns(cols)
    zero = sum((F.col(c) for c in cols), F.lit(0.0)) == 0
    aggs = [F.sum(c).alias(c) for c in cols] + [F.count_if(zero).alias("n_all_zero")]
    return rounded(enc.agg(*aggs))


@query("m19_ridge_path")
def m19(spark, sf_dir):
    from .plans.linear import RIDGE_ALPHAS, centred, grouped_suff, ridge_path
    cols = ["minimum_nights", "availability_365", "log_price"]
    df, _ = centred(listings(spark, sf_dir, "v2").select(*cols), cols)
    s = grouped_suff(df.withColumn("__g", F.lit(0)), cols[:2], "log_price", ["__g"])[(0,)]
    rows = [(i, a, float(b[0]), float(b[1])) for i, (a, b) in enumerate(ridge_path(s, RIDGE_ALPHAS))]
    return rounded(spark.createDataFrame(rows, "alpha_index int, alpha double, coef_1 double, coef_2 double"), 9)


# ---------------------------------------------------------------------------
# Area-level model and predictor audit
# ---------------------------------------------------------------------------
def area_model_frame(spark, sf_dir, strategy="all_distances"):
    from pyspark import StorageLevel
    from .plans import area_model as AM
    df, dist, warning = AM.load_area_target(FX.area_target_raw(spark, sf_dir))
    if strategy == "pca":
        df, _, _ = AM.with_distance_scores(df, dist)
    m, kept = AM.prepare(df, AM.predictors(df, dist, strategy))
    return m.persist(StorageLevel.MEMORY_AND_DISK), kept, warning


@query("m02_area_ols_coefficients")
def m02(spark, sf_dir):
    from .plans import area_model as AM
    m, kept, _ = area_model_frame(spark, sf_dir)
    out = AM.run_ols(m, kept).coefficients(spark)
    m.unpersist()
    return rounded(out)


@query("m02_area_ols_pca")
def m02_pca(spark, sf_dir):
    """The same model on three principal components of the distances."""
    from .plans import area_model as AM
    m, kept, _ = area_model_frame(spark, sf_dir, "pca")
    out = AM.run_ols(m, kept).coefficients(spark)
    m.unpersist()
    return out


@query("m02_area_ols_centrality")
def m02_centrality(spark, sf_dir):
    """The same model on the centrality index alone."""
    from .plans import area_model as AM
    m, kept, _ = area_model_frame(spark, sf_dir, "centrality_only")
    out = AM.run_ols(m, kept).coefficients(spark)
    m.unpersist()
    return rounded(out)


@query("a06_centrality_index")
def a06(spark, sf_dir):
    """Unguarded z-scores of the distances, averaged over those present."""
    from .plans import area_model as AM
    df, _, _ = AM.load_area_target(FX.area_target_raw(spark, sf_dir))
    return rounded(df.select("ZIP_CODE", "centrality_index"))


@query("m17_area_ols_predictions")
def m17_area(spark, sf_dir):
    from .plans import area_model as AM
    m, kept, _ = area_model_frame(spark, sf_dir, "centrality_only")
    pred = AM.run_ols(m, kept).prediction()
    out = m.select("ZIP_CODE", F.col(AM.TARGET).alias("price"), pred.alias("predicted_log_price"))
    m.unpersist()
    return rounded(out.withColumn("predicted_price", S.back_transform("predicted_log_price")), 5)


@query("m20_area_ridge_coefficients")
def m20(spark, sf_dir):
    from .plans import area_model as AM
    m, kept, _ = area_model_frame(spark, sf_dir)
    _, coefs, _ = AM.ridge_cv(m, kept)
    m.unpersist()
    return spark.createDataFrame(coefs, "feature string, ridge_coef_standardized double")


@query("m21_area_model_metrics")
def m21(spark, sf_dir):
    from .plans import area_model as AM
    from .plans.metrics import regression_metrics
    m, kept, warning = area_model_frame(spark, sf_dir)
    ols = AM.run_ols(m, kept)
    metrics, _, pred = AM.ridge_cv(m, kept)
    rows = [(f"ols_{k}", float(v)) for k, v in ols.metrics.items()] + [(k, float(v)) for k, v in metrics.items()]
    for name, p in [("ols", ols.prediction()), ("ridge", pred)]:
        d = m.select(F.col(AM.LOG_TARGET).alias("y"), p.alias("p"), F.col(AM.TARGET).alias("price"),
                     F.exp(p).alias("pp"))
        r = regression_metrics(d, "y", "p", "price", "pp").first()
        rows += [(f"{name}_r2_log", r["r2_log"]), (f"{name}_mae_price", r["mae_price"]),
                 (f"{name}_rmse_price", r["rmse_price"])]
    rows.append(("duplicate_column_dropped", 1.0 if warning else 0.0))
    m.unpersist()
    return spark.createDataFrame(rows, "metric string, value double")


@query("m22_pca_two_columns")
def m22(spark, sf_dir):
    from .plans.linear import pca_from_corr
    from .plans.moments import correlation_from_gram, gram_stats
    cols = [FX.landmark_name(1), FX.landmark_name(3)]
    raw = FX.area_target_raw(spark, sf_dir).select(*[F.col(f"`{c}`") for c in cols])
    _, _, g = gram_stats(raw, cols)
    ratio, vec, _ = pca_from_corr(correlation_from_gram(g), 2)
    rows = [(j + 1, float(ratio[j]), float(vec[0, j]), float(vec[1, j])) for j in range(2)]
    return rounded(spark.createDataFrame(
        rows, "component int, explained_variance_ratio double, loading_1 double, loading_2 double"), 9)


@query("m22_pca_scores")
def m22_scores(spark, sf_dir):
    """Three component scores of the six median-filled distances for every area."""
    from .plans import area_model as AM
    df, dist, _ = AM.load_area_target(FX.area_target_raw(spark, sf_dir))
    scored, _, _ = AM.with_distance_scores(df, dist)
    return rounded(scored.select("ZIP_CODE", *[c for c in scored.columns if c.startswith("distance_pc")]))


@query("m22_pca_scores_two_columns")
def m22_scores_two(spark, sf_dir):
    """Closed form: the scores of two columns are their sum and difference over the root of two."""
    from .plans import area_model as AM
    df, dist, _ = AM.load_area_target(FX.area_target_raw(spark, sf_dir))
    scored, _, _ = AM.with_distance_scores(df, [dist[0], dist[2]], 2)
    return rounded(scored.select("ZIP_CODE", "distance_pc1", "distance_pc2"))


@query("m23_collinearity_vif")
def m23_vif(spark, sf_dir):
    from .plans import area_model as AM
    _, _, vif, _, _ = AM.audit(spark, FX.area_target_raw(spark, sf_dir))
    return rounded(vif, 4)


@query("a10_collinearity_pairs")
def a10_pairs(spark, sf_dir):
    from .plans import area_model as AM
    _, pairs, _, _, _ = AM.audit(spark, FX.area_target_raw(spark, sf_dir))
    return rounded(pairs, 9)


@query("o03_report_top_pairs")
def o03(spark, sf_dir):
    """The report's forty strongest pairs, from a threshold that more of them pass."""
    from .plans import area_model as AM
    _, pairs, _, _, _ = AM.audit(spark, FX.area_target_raw(spark, sf_dir), threshold=0.01)
    first = pairs.orderBy(F.round("abs_r", 9).desc(), "feature_1", "feature_2").limit(40)
    return rounded(first, 6)


@query("m23_collinearity_report")
def m23_report(spark, sf_dir):
    from .plans import area_model as AM
    _, pairs, vif, summary, _ = AM.audit(spark, FX.area_target_raw(spark, sf_dir))
    rows = [("input", k, float(v)) for k, v in summary.items()]
    rows += [("pairs", "at_or_above_threshold", float(pairs.count()))]
    rows += [("vif", r["band"], float(r["count"])) for r in vif.groupBy("band").count().collect()]
    return spark.createDataFrame(rows, "section string, metric string, value double")


LANDMARK_X = [FX.landmark_name(j) for j in range(1, FX.N_LANDMARKS + 1)]


def _landmark_corr(spark, sf_dir, cols):
    from .plans.moments import correlation_from_gram, gram_stats
    raw = FX.area_target_raw(spark, sf_dir).select(*[F.col(f"`{c}`") for c in cols])
    _, _, g = gram_stats(raw, cols)
    return correlation_from_gram(g)


@query("a09_correlation_long")
def a09(spark, sf_dir):
    from .plans.moments import correlation_long
    return rounded(correlation_long(spark, LANDMARK_X, _landmark_corr(spark, sf_dir, LANDMARK_X)), 9)


@query("a10_high_correlation_pairs")
def a10(spark, sf_dir):
    from .plans.moments import high_pairs
    return rounded(high_pairs(spark, LANDMARK_X, _landmark_corr(spark, sf_dir, LANDMARK_X), 0.8), 9)


@query("a11_vif_three_predictors")
def a11(spark, sf_dir):
    from .plans.moments import vif_table
    cols = LANDMARK_X[:3]
    return rounded(vif_table(spark, cols, _landmark_corr(spark, sf_dir, cols)), 6)


# ---------------------------------------------------------------------------
# Boosted trees, permutation importance, streaming
# ---------------------------------------------------------------------------
WIDE_NUMERIC = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
GBM_EDITIONS = ("v3", "external", "area")
FOLDS = 5  # of the area model


def boosted(spark, sf_dir, edition):
    """(model, training rows, test rows, predictors, key, target) of an edition, fitted anew for each query."""
    from .operators.selection import exclude_patterns, existing
    from .plans import area_model as AM
    from .plans import trees as T
    from .plans.preprocess import holdout_split
    from .session import written
    if edition == "area":
        m, kept, _ = area_model_frame(spark, sf_dir)
        numeric, categorical, key, y, params = kept, [], "ZIP_CODE", AM.LOG_TARGET, T.GBM_AREA
        train = test = m
    else:
        if edition == "v3":
            area = zip_all(spark, sf_dir, "v3")
        else:
            area = A.area_table(FX.area_target_raw(spark, sf_dir), FX.incidents_raw(spark, sf_dir), "external",
                                FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY)
        m = A.attach_area(listings(spark, sf_dir, edition), area)
        if edition == "v3":
            numeric, categorical = existing(m, V3_NUMERIC + V3_AREA + V3_RATES), ["room_type", "month"]
        else:
            m = m.withColumn("month_september", S.month_flag("month"))
            numeric, categorical = exclude_patterns(existing(m, EXTERNAL_CANDIDATES), FORBIDDEN) + ["month_september"], []
        key, y, params = "listing_id", "log_price", T.GBM_LISTING if edition == "v3" else T.GBM_EXTERNAL
        # the split, every statistic, the fit and the scores read these rows; they are cleaned and joined once
        m = written(m.select(key, y, *numeric, *categorical), "boosted")
        split, _ = holdout_split(m, key, 0.2, 42)
        train, test = split.where(~F.col("is_test")), split.where("is_test")
    model = T.fit_boosted(train, numeric, categorical, y, key=key, **params)
    if edition == "area":
        m.unpersist()
    return model, train, test, numeric + categorical, key, y


def _scores(scored, y, prefix):
    from .plans.metrics import regression_metrics
    d = scored.select(F.col(y).alias("y"), "prediction", F.exp(y).alias("price"), F.exp("prediction").alias("pred_price"))
    r = regression_metrics(d, "y", "prediction", "price", "pred_price").first()
    return [(f"{prefix}_{k}", float(r[k])) for k in ("n", "r2_log", "mae_price", "rmse_price")]


def _area_folds(spark, sf_dir):
    """(area rows with their fold of five, predictors, target); the rows are persisted."""
    from pyspark import StorageLevel
    from .plans import area_model as AM
    from .plans.preprocess import kfold
    m, kept, _ = area_model_frame(spark, sf_dir)
    folded, _ = kfold(m, "ZIP_CODE", FOLDS, 42)
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    folded.count()
    m.unpersist()
    return folded, kept, AM.LOG_TARGET


def _side_by_side(score):
    """``score`` of each of the five folds; folds run side by side."""
    from multiprocessing.pool import ThreadPool
    with ThreadPool(FOLDS) as pool:
        return pool.map(score, range(FOLDS))


def _fold_scores(folded, numeric, y):
    """R^2 of the trees on each of the five folds, everything refitted on the other four."""
    from .plans import trees as T
    from .plans.metrics import regression_metrics

    def score(f):
        model = T.fit_boosted(folded.where(F.col("fold") != f), numeric, [], y, side_by_side=FOLDS, **T.GBM_AREA)
        return regression_metrics(model.predict(folded.where(F.col("fold") == f)), y, "prediction").first()["r2_log"]

    return _side_by_side(score)


def _linear_r2(train, test, numeric, y):
    """R^2 on ``test`` of least squares on the numeric predictors, missing values at their medians."""
    from .plans.design import build_design
    from .plans.linear import fit_ols
    from .plans.metrics import regression_metrics
    from .plans.preprocess import apply_imputer, fit_median_imputer
    fills = fit_median_imputer(train, numeric)
    res = fit_ols(apply_imputer(train, fills), build_design(numeric=numeric), y)
    scored = apply_imputer(test, fills).withColumn("prediction", res.prediction())
    return regression_metrics(scored, y, "prediction").first()["r2_log"]


def _register_boosted(edition):
    from statistics import fmean, pstdev

    @query(f"m16_boosted_metrics_{edition}")
    def metrics(spark, sf_dir):
        model, train, test, features, _, y = boosted(spark, sf_dir, edition)
        if edition == "area":
            folded, numeric, target = _area_folds(spark, sf_dir)
            folds = _fold_scores(folded, numeric, target)
            folded.unpersist()
            rows = [("gbm_cv_r2_log_mean", fmean(folds)), ("gbm_cv_r2_log_std", pstdev(folds))]
            rows += _scores(model.predict(train), y, "gbm_full_fit")
        else:
            rows = _scores(model.predict(train), y, "gbm_train") + _scores(model.predict(test), y, "gbm_test")
        rows.append(("gbm_trees", float(model.model.getNumTrees)))
        return spark.createDataFrame(rows, "metric string, value double")

    @query(f"m17_boosted_predictions_{edition}")
    def predictions(spark, sf_dir):
        from .plans.trees import prediction_table
        model, _, test, _, key, y = boosted(spark, sf_dir, edition)
        return prediction_table(model.predict(test), key, y)

    @query(f"m18_boosted_importance_{edition}")
    def importance(spark, sf_dir):
        from .plans.trees import permutation_importance
        model, _, test, features, key, y = boosted(spark, sf_dir, edition)
        _, rows = permutation_importance(test, key, features, y, model.predict, repeats=10 if edition == "area" else 5, seed=42, model=model)
        return spark.createDataFrame(rows, "feature string, importance_mean double, importance_std double")

    if edition == "area":
        return

    @query(f"m16_boosted_quality_{edition}")
    def quality(spark, sf_dir):
        """Row counts, whether the trees beat the straight line on the same test rows, and whether boosting ended
        at the best iteration of the held-out rows where there are enough rows for that."""
        from .plans.trees import EARLY_ROWS, best_iteration
        model, train, test, features, _, y = boosted(spark, sf_dir, edition)
        numeric = [c for c in features if c in model.numeric]
        r2 = dict(_scores(model.predict(test), y, "t"))["t_r2_log"]
        n, trees = train.count(), model.model.getNumTrees
        cut = model.losses is not None and trees == best_iteration(model.losses)[0] + 1 <= len(model.losses)
        rows = [("train_rows", str(n)), ("test_rows", str(test.count())),
                ("more_than_one_tree", str(trees > 1).lower()),
                ("cut_at_the_best_iteration", str(cut if n > EARLY_ROWS else trees == 400).lower()),
                ("test_r2_at_least_least_squares", str(r2 >= _linear_r2(train, test, numeric, y)).lower())]
        return spark.createDataFrame(rows, "metric string, value string")


@query("m16_boosted_quality_area")
def m16_area_quality(spark, sf_dir):
    """The area model judged out of sample: five shuffled folds, trees against least squares on the same folds."""
    from statistics import fmean
    folded, numeric, y = _area_folds(spark, sf_dir)
    trees = _fold_scores(folded, numeric, y)
    line = _side_by_side(lambda f: _linear_r2(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), numeric, y))
    rows = [("rows", str(folded.count())), ("folds", str(len(trees))),
            ("mean_fold_r2_at_least_least_squares", str(fmean(trees) >= fmean(line)).lower())]
    folded.unpersist()
    return spark.createDataFrame(rows, "metric string, value string")


for _edition in GBM_EDITIONS:
    _register_boosted(_edition)


@query("m18_permutation_importance_linear")
def m18(spark, sf_dir):
    """Importance of both slopes on the test rows; the fit has the training rows only."""
    from .plans.design import build_design
    from .plans.linear import fit_ols
    from .plans.trees import linear_importance
    s = _split(spark, sf_dir).select("listing_id", "log_price", "minimum_nights", "availability_365", "is_test")
    names = ["minimum_nights", "availability_365"]
    res = fit_ols(s.where("not is_test"), build_design(numeric=names), "log_price")
    _, rows = linear_importance(s.where("is_test"), "listing_id", dict(zip(names, res.coef[1:], strict=True)), "log_price",
                                res.prediction(), repeats=5, seed=42)
    return rounded(spark.createDataFrame(rows, "feature string, importance_mean double, importance_std double"), 8)


def _event_stream(spark, sf_dir):
    from .session import scratch_path
    from .sources.tables import load_table, table_path
    from .streaming.rollup import stream_rollup
    out = scratch_path(spark, "incident_rollup_stream")
    counters = stream_rollup(spark, table_path(sf_dir, "events") + "*", load_table(spark, sf_dir, "events").schema, out,
                             scratch_path(spark, "ckpt"), FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY,
                             prepare=FX.incidents_from_events)
    return out, counters


@query("t01_stream_incident_rollup")
def t01(spark, sf_dir):
    from .streaming.rollup import read_rollup
    return read_rollup(spark, _event_stream(spark, sf_dir)[0])


@query("t01_stream_counters")
def t01_counters(spark, sf_dir):
    _, counters = _event_stream(spark, sf_dir)
    return spark.createDataFrame([("rows_read", counters["rows_read"])], "metric string, value bigint")


@query("t01_stream_progress")
def t01_progress(spark, sf_dir):
    """The counters of the micro-batches over a folder of several files, summed for each of three chunks of the
    table; a file, and so a batch, has rows of one chunk."""
    from .session import scratch_path
    from .sources.tables import load_table
    from .streaming.rollup import stream_rollup
    events = load_table(spark, sf_dir, "events").withColumn("chunk", F.pmod("event_id", F.lit(3)).cast("int"))
    folder = scratch_path(spark, "incident_chunks")
    events.write.partitionBy("chunk").parquet(folder)
    found = stream_rollup(spark, folder, events.schema, scratch_path(spark, "incident_rollup_stream"), scratch_path(spark, "ckpt"),
                          FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY, prepare=FX.incidents_from_events,
                          marks={"first_chunk": F.min("chunk"), "last_chunk": F.max("chunk")})
    rows = [(r["first_chunk"], r["first_chunk"] == r["last_chunk"], r["rows_read"], r["rows_with_valid_zip"]) for r in found["progress"]]
    batches = spark.createDataFrame(rows, "chunk int, one_chunk boolean, rows_read bigint, rows_with_valid_zip bigint")
    return batches.groupBy("chunk").agg(F.bool_and("one_chunk").alias("one_chunk"), F.sum("rows_read").alias("rows_read"),
                                        F.sum("rows_with_valid_zip").alias("rows_with_valid_zip"))


@query("m04_ols_hc3_wide")
def m04(spark, sf_dir):
    """log(extendedprice) on 5 numerics + 2 treatment-coded flags (8 terms), HC3."""
    from pyspark import StorageLevel
    from .plans.design import build_design, levels
    from .plans.linear import fit_ols
    w = FX.wide_frame(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    lv = levels(w, ["l_returnflag", "l_linestatus"])
    terms = build_design(numeric=WIDE_NUMERIC, categorical=["l_returnflag", "l_linestatus"], level_map=lv)
    out = fit_ols(w, terms, "y").coefficients(spark)
    w.unpersist()
    return rounded(out)


# ---------------------------------------------------------------------------
# Model editions v3 (interactions) and external-only (pattern exclusion)
# ---------------------------------------------------------------------------


@query("m05_ols_coefficients_v3")
def m05_v3(spark, sf_dir):
    from pyspark import StorageLevel
    from .operators.selection import existing
    from .plans.design import build_design, levels
    from .plans.linear import fit_ols
    m = A.attach_area(listings(spark, sf_dir, "v3"), zip_all(spark, sf_dir, "v3"))
    preds = existing(m, V3_NUMERIC) + existing(m, V3_AREA)
    inter = [("room_type", c) for c in ["crime_events_z", "amenities_index"] if c in m.columns]
    frame = m.select("log_price", "price", "room_type", "month", *preds).dropna() \
             .persist(StorageLevel.MEMORY_AND_DISK)
    lv = levels(frame, ["room_type", "month"])
    res = fit_ols(frame, build_design(numeric=preds, categorical=["room_type", "month"], interactions=inter,
                                      level_map=lv), "log_price")
    frame.unpersist()
    return rounded(res.coefficients(spark))


@query("m05_ols_coefficients_external")
def m05_ext(spark, sf_dir):
    from pyspark import StorageLevel
    from .operators.selection import exclude_patterns, existing
    from .plans.design import build_design, levels
    from .plans.linear import fit_ols
    area = A.area_table(FX.area_target_raw(spark, sf_dir), FX.incidents_raw(spark, sf_dir), "external",
                        FX.FIXTURE_VIOLENT, FX.FIXTURE_PROPERTY)
    m = A.attach_area(listings(spark, sf_dir, "external"), area)
    preds = exclude_patterns(existing(m, EXTERNAL_CANDIDATES), FORBIDDEN,
                             also=("price", "log_price", "ZIP_CODE", "month"))
    frame = m.select("log_price", "price", "month", *preds).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    lv = levels(frame, ["month"])
    res = fit_ols(frame, build_design(numeric=preds, categorical=["month"], level_map=lv), "log_price")
    frame.unpersist()
    return rounded(res.coefficients(spark))


# ---------------------------------------------------------------------------
# Orthogonal least squares, absorbed factors, wide correlation, collinear sets, CSV audit, scatter sample
# ---------------------------------------------------------------------------
POLYNOMIAL_DEGREE = 6


@query("m03_ols_qr_polynomial")
def m03_qr(spark, sf_dir):
    """Fitted values of a raw polynomial in the quantity, whose normal equations have too few digits."""
    from .plans.design import DesignTerm
    from .plans.qr import fit_ols_qr
    w = FX.wide_frame(spark, sf_dir).select("l_quantity", "y")
    q = F.col("l_quantity").cast("double")
    terms = [DesignTerm(f"q^{d}", F.pow(q, F.lit(float(d)))) for d in range(POLYNOMIAL_DEGREE + 1)]
    res = fit_ols_qr(w, terms, "y")
    per_value = w.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return rounded(per_value.select("l_quantity", "n", res.prediction().alias("fitted")), 8)


ABSORBED = ["l_quantity", "l_discount", "l_tax"]


@query("m03_ols_absorbed_factor")
def m03_absorbed(spark, sf_dir):
    """Slopes beside one level for every part: the parts are taken out by centring, not as columns."""
    from .plans.absorb import fit_absorbed
    fit = fit_absorbed(FX.wide_frame(spark, sf_dir).select("l_partkey", "y", *ABSORBED), ABSORBED, ["l_partkey"], "y")
    out = fit.coefficients(spark).select("term", "coef")
    return rounded(out.withColumn("n", F.lit(fit.n)).withColumn("levels", F.lit(fit.levels)), 9)


@query("m01_absorbed_level_effects")
def m01_effects(spark, sf_dir):
    """The effect of every level of the absorbed factor, as a table."""
    from .plans.absorb import fit_absorbed
    fit = fit_absorbed(FX.wide_frame(spark, sf_dir).select("l_partkey", "y", *ABSORBED), ABSORBED, ["l_partkey"], "y")
    return rounded(fit.effects.withColumnRenamed("level", "l_partkey"), 7)


WIDE_COLUMNS = [f"w{j:02d}" for j in range(48)]


def _many_columns(spark, sf_dir):
    """48 columns of the line items, some of them nearly multiples of others."""
    from .sources.tables import load_table
    li = load_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"])
    base = [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")]
    q = F.col("l_quantity").cast("double")
    return li.select(*[((base[j % 3] * (2 * j + 1) + F.col("l_linenumber") * j) % (7 + j % 5) + q * (j % 4)).cast("double").alias(c)
                       for j, c in enumerate(WIDE_COLUMNS)])


@query("a10_wide_correlation_pairs")
def a10_wide(spark, sf_dir):
    """Pairs of 48 columns in blocks of 20, filtered where they are summed."""
    from .plans.wide import wide_correlation_pairs
    return rounded(wide_correlation_pairs(_many_columns(spark, sf_dir), WIDE_COLUMNS, 0.8, block=20), 9)


DEPENDENT = [*LANDMARK_X[:3], "Count_Fire_Stations", "Count_Police_Stations", "Count_Public_Safety"]


@query("a11_vif_dependent_columns")
def a11_dependent(spark, sf_dir):
    """Fire and police counts are equal: their factors are infinite, the others are not."""
    from .plans import area_model as AM
    from .plans.moments import correlation_from_gram, gram_stats, vif_table
    typed = AM.audit_features(FX.area_target_raw(spark, sf_dir)).select(*[F.col(f"`{c}`") for c in DEPENDENT]).dropna()
    _, _, g = gram_stats(typed, DEPENDENT)
    return rounded(vif_table(spark, DEPENDENT, correlation_from_gram(g)))


@query("s01_csv_audit")
def s01_audit(spark, sf_dir):
    """Counters of a file with short and long records and line breaks within quotes, written from the customers."""
    from .session import scratch_path
    from .sources.tables import csv_counters, load_table, read_csv_audited
    cu = load_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.when(k % 13 == 0, quoted(F.concat(name, F.lit("\n"), seg))).when(k % 5 == 0, quoted(F.concat(name, F.lit(', ""x""')))).otherwise(name)
    line = F.when(k % 7 == 0, F.concat_ws(",", k, text)).when(k % 11 == 0, F.concat_ws(",", k, text, seg, F.lit("surplus"))) \
            .otherwise(F.concat_ws(",", k, text, F.when(k % 17 != 0, seg).otherwise("")))
    path = scratch_path(spark, "csv_audit")
    cu.select(line).write.text(path)
    return csv_counters(read_csv_audited(spark, path, ["key", "name", "segment"], header=False))


SCATTER_ROWS = 500


@query("m25_scatter_sample")
def m25_scatter(spark, sf_dir):
    """Actual and predicted price of a repeatable sample of fixed size, for the scatter chart."""
    from .operators.ordering import seeded_sample
    df, res = simple_fit(spark, sf_dir)
    scored = df.select("listing_id", "price", F.exp(res.prediction()).alias("predicted_price"))
    return rounded(seeded_sample(scored, "listing_id", SCATTER_ROWS, 42))


RIDGE_PAIR = ["log_population", LANDMARK_X[0]]


@query("m19_ridge_choice_two_predictors")
def m19_choice(spark, sf_dir):
    """The penalty chosen by inner folds, its coefficients, and the outer folds' scores, for two predictors."""
    from .plans import area_model as AM
    df, _, _ = AM.load_area_target(FX.area_target_raw(spark, sf_dir))
    m, kept = AM.prepare(df, RIDGE_PAIR)
    metrics, coefs, _ = AM.ridge_cv(m, kept)
    rows = [(k, float(v)) for k, v in metrics.items()] + [(f"coef {c}", b) for c, b in coefs]
    return rounded(spark.createDataFrame(rows, "metric string, value double"))


@query("c11_month_flag")
def c11(spark, sf_dir):
    df = listings(spark, sf_dir, "external").withColumn("month_september", S.month_flag("month"))
    return rounded(df.groupBy("month", "month_september").agg(F.count(F.lit(1)).alias("n"), F.avg("log_price").alias("mean_log_price")))


PREPROCESSED = ["accommodates", "number_of_reviews"]


@query("m15_column_preprocessor")
def m15(spark, sf_dir):
    """The features of the test rows as the trees see them: medians, scaling, mode and one-hot from the training rows."""
    from pyspark.ml.functions import vector_to_array
    from .plans.preprocess import holdout_split
    from .plans.trees import fit_preprocessor
    typed = typed_listings(spark, sf_dir)
    required, trim = A.listing_filters("external", LO, HI)
    split, _ = holdout_split(typed.where(required & trim).select("listing_id", "month", "room_type", *PREPROCESSED), "listing_id", 0.2, 42)
    fitted = fit_preprocessor(split.where("not is_test"), PREPROCESSED, ["month", "room_type"])
    x = vector_to_array("__features")
    out = fitted.features(split.where("is_test")).select("listing_id", x.alias("x"))
    return rounded(out.select("listing_id", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(2 + 2 + 5)]))
