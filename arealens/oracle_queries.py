"""Oracle SQL (DuckDB) for the registered queries, keyed like ``catalog.QUERIES``."""

from __future__ import annotations

from . import oracle as O
from .oracle import r, with_

SQL: dict[str, str] = {}

SQL["q01_price_incident_by_category"] = with_(*O.v2_model_ctes()) + f"""
SELECT room_type, month, count(*) AS n_listings,
  {r('avg(log_price)')} AS mean_log_price,
  {r('avg(crime_events_per_capita)')} AS mean_incident_rate,
  {r('avg(amenities_index)')} AS mean_amenities_index,
  count(DISTINCT ZIP_CODE) AS n_areas
FROM merged GROUP BY room_type, month"""

SQL["a01_incident_rollup"] = with_(O.INCIDENTS_RAW, O.INCIDENTS_TYPED, O.ROLLUP) + "SELECT * FROM rollup"

LISTING_BASE = [O.LISTINGS_RAW, O.LISTINGS_TYPED]
AREA_BASE = [O.AREA_RAW, O.AREA_TYPED]
INCIDENT_BASE = [O.INCIDENTS_RAW, O.INCIDENTS_TYPED, O.ROLLUP]
AREA_TYPED_COLS = ["Population", "Count_Part_1_Crime", "Count_Public_Safety", "Count_Fire_Stations",
                   "Count_Police_Stations", "Count_Corrective_Facility", "Count_Education_Facility",
                   "Crime_Per_Capita", "Education_Per_Capita", "Public_Safety_Per_Capita"]

SQL["s01_csv_roundtrip"] = with_(*AREA_BASE) + O.sel(
    ["ZIP_CODE", "Population", "Crime_Per_Capita", "Education_Per_Capita", "Public_Safety_Per_Capita",
     "median_household_size"], "area_typed", ints=("ZIP_CODE",))

SQL["s04_source_fallback"] = """
SELECT c_mktsegment, count(*) AS n_customers, round(avg(c_acctbal), 6) AS mean_acctbal
FROM customer GROUP BY c_mktsegment"""

SQL["s09_alias_harmonise"] = with_(O.AREA_TARGET_RAW, O.AREA_TARGET_TYPED) + """
SELECT ZIP_CODE, round(Population, 6) AS Population, round(Part_1_Crime_Count, 6) AS Count_Part_1_Crime,
  round(Part_1_Crime_Per_Capita, 6) AS Crime_Per_Capita, round(Count_Public_Safety, 6) AS Count_Public_Safety,
  round(Count_Fire_Stations, 6) AS Count_Fire_Stations, round(Count_Police_Stations, 6) AS Count_Police_Stations,
  round(Count_Corrective_Facility, 6) AS Count_Corrective_Facility,
  round(Count_Educational_Facility, 6) AS Count_Education_Facility
FROM area_target_typed"""

SQL["u01_union_snapshots"] = with_(O.LISTINGS_RAW) + """
SELECT month, count(*) AS n_rows, count(accommodates) AS n_accommodates, count(price) AS n_price
FROM listings_raw GROUP BY month"""

_REQ = "price IS NOT NULL AND ZIP_CODE IS NOT NULL AND room_type IS NOT NULL AND month IS NOT NULL"
SQL["a02_listing_counters"] = with_(*LISTING_BASE) + f"""
SELECT count(*) AS airbnb_raw_rows, count(*) FILTER (WHERE {_REQ}) AS airbnb_after_required_filters,
  count(*) FILTER (WHERE {_REQ} AND price BETWEEN {O.LO} AND {O.HI}) AS airbnb_after_price_trim,
  count(DISTINCT ZIP_CODE) FILTER (WHERE {_REQ} AND price BETWEEN {O.LO} AND {O.HI}) AS airbnb_unique_zips
FROM listings_typed"""

SQL["a02_incident_counters"] = with_(O.INCIDENTS_RAW, O.INCIDENTS_TYPED) + """
SELECT count(*) AS crime_total_rows_read, count(ZIP_CODE) AS crime_rows_with_valid_zip,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM incidents WHERE ZIP_CODE IS NOT NULL GROUP BY ZIP_CODE))
    AS crime_aggregated_total_events,
  CAST(sum(CASE WHEN ZIP_CODE IS NOT NULL THEN part1_flag ELSE 0 END) AS BIGINT) AS crime_total_part1_rows,
  count(DISTINCT ZIP_CODE) AS crime_unique_zip_after_aggregation,
  round(count(ZIP_CODE) / count(*), 6) AS share_crime_rows_retained_after_zip_cleaning
FROM incidents"""

SQL["p01_leakage_drop_v1"] = with_(*AREA_BASE) + O.sel(["ZIP_CODE"] + AREA_TYPED_COLS, "area_typed",
                                                       ints=("ZIP_CODE",))
SQL["p01_leakage_drop_v2"] = with_(*AREA_BASE) + O.sel(
    ["ZIP_CODE"] + AREA_TYPED_COLS + ["median_household_size"], "area_typed", ints=("ZIP_CODE",))

SQL["f01_listings_clean_v2"] = with_(*LISTING_BASE, O.listings_clean()) + O.sel(
    ["listing_id", "ZIP_CODE", "room_type", "month", "price", "log_price", "number_of_reviews",
     "reviews_per_month", "number_of_reviews_ltm", "accommodates"], "listings",
    ints=("listing_id", "ZIP_CODE", "room_type", "month"))

_LOGF = [("minimum_nights", "log_minimum_nights"), ("number_of_reviews", "log_number_of_reviews"),
         ("reviews_per_month", "log_reviews_per_month"), ("availability_365", "log_availability_365"),
         ("number_of_reviews_ltm", "log_number_of_reviews_ltm"),
         ("calculated_host_listings_count", "log_host_listings_count")]
SQL["c04_listing_features_v3"] = with_(*LISTING_BASE, O.listings_clean()) + "SELECT listing_id, " + ", ".join(
    f"round({O.log1p0(src)}, 6) AS {new}" for src, new in _LOGF) + \
    ", round(coalesce(accommodates, median(accommodates) OVER ()), 6) AS accommodates FROM listings"

from .functions.scalar import PROPERTY_PATTERN, VIOLENT_PATTERN  # noqa: E402

SQL["c09_text_flags_documents"] = f"""
SELECT source, lang, count(*) AS n_docs,
  CAST(sum({O.flag('text', VIOLENT_PATTERN)}) AS BIGINT) AS violent_docs,
  CAST(sum({O.flag('text', PROPERTY_PATTERN)}) AS BIGINT) AS property_docs,
  CAST(sum({O.flag('text', VIOLENT_PATTERN)} * {O.flag('text', PROPERTY_PATTERN)}) AS BIGINT) AS both_docs,
  CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY source, lang"""

_V1_COLS = ["Count_Part_1_Crime", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
            "Count_Corrective_Facility", "Count_Education_Facility", "Population", "Crime_Per_Capita",
            "Education_Per_Capita", "Public_Safety_Per_Capita", "amenities_index", "crime_index",
            "education_index"]
SQL["a03_area_features_v1"] = with_(*AREA_BASE, O.AREA_V1) + O.sel(["ZIP_CODE"] + _V1_COLS, "area",
                                                                   ints=("ZIP_CODE",))
_V3_COLS = ["Population", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
            "Count_Corrective_Facility", "Count_Education_Facility", "Crime_Per_Capita", "Education_Per_Capita",
            "Public_Safety_Per_Capita", "Education_Per_10k", "Public_Safety_Per_10k", "Crime_Per_10k",
            "Education_z", "Public_Safety_z", "Crime_z", "amenities_index"]
SQL["a03_area_features_v3"] = with_(*AREA_BASE, O.AREA_V3) + O.sel(["ZIP_CODE"] + _V3_COLS, "area",
                                                                   ints=("ZIP_CODE",))
_EXT_COLS = ["Population", "Count_Part_1_Crime", "Crime_Per_Capita", "Count_Public_Safety",
             "Count_Fire_Stations", "Count_Police_Stations", "Count_Corrective_Facility",
             "Count_Education_Facility", "log_population", "crime_per_10k_cleaned", "education_per_10k",
             "public_safety_per_10k", "crime_z_cleaned", "education_z", "public_safety_z",
             "external_amenities_index"]
SQL["a03_area_features_external"] = with_(O.AREA_TARGET_RAW, O.AREA_TARGET_TYPED, O.AREA_EXTERNAL) + O.sel(
    ["ZIP_CODE"] + _EXT_COLS, "area", ints=("ZIP_CODE",))

_INTS = ("ZIP_CODE", "crime_events", "violent_crime_events", "property_crime_events", "part1_events")
_V2_MODEL = O.v2_model_ctes()
SQL["j01_area_incident_join_v2"] = with_(*_V2_MODEL[3:10]) + O.sel(
    ["ZIP_CODE"] + O.ZIP_ALL_V2_COLS, "zip_joined", ints=_INTS)
SQL["a08_area_median_fill_v2"] = with_(*_V2_MODEL[3:11]) + O.sel(
    ["ZIP_CODE"] + O.ZIP_ALL_V2_COLS, "zip_all", ints=("ZIP_CODE",))
SQL["j02_listing_area_join_v2"] = with_(*_V2_MODEL) + O.sel(
    ["listing_id", "ZIP_CODE", "log_price", "Population", "amenities_index", "crime_events_per_capita",
     "crime_index"], "merged", ints=("listing_id", "ZIP_CODE"))
SQL["j03_join_audit"] = with_(*_V2_MODEL[:11]) + """
SELECT count(*) AS rows_before, count(z.ZIP_CODE) AS rows_matched, count(*) - count(z.ZIP_CODE) AS rows_unmatched
FROM listings l LEFT JOIN (SELECT DISTINCT ZIP_CODE FROM zip_all) z ON l.ZIP_CODE = z.ZIP_CODE"""

_MERGED_V1 = [*LISTING_BASE, O.listings_clean(edition="v1"), *AREA_BASE, O.AREA_V1, *INCIDENT_BASE,
              O.ZIP_JOINED_V1, """
merged AS (SELECT l.*, z.* EXCLUDE (ZIP_CODE) FROM listings l LEFT JOIN zip_all z USING (ZIP_CODE)
           WHERE l.ZIP_CODE IS NOT NULL)"""]


def _fill(c, zero=False):
    x = f"coalesce({c}, 0.0)" if zero else c
    return f"round(coalesce({x}, median({x}) OVER ()), 6) AS {c}"


SQL["a08_listing_fill_v1"] = with_(*_MERGED_V1) + "SELECT listing_id, " + ", ".join(
    [_fill("number_of_reviews", True), _fill("reviews_per_month", True)]
    + [_fill(c) for c in ["accommodates", "crime_events", "crime_events_per_capita", "part1_events_per_capita",
                          "amenities_index", "Crime_Per_Capita", "crime_index"]]) + " FROM merged"


def _binned(ctes, src, x, y, q, min_rows=1, min_distinct=1, min_bins=1):
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return with_(*ctes, f"""
d AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""",
                 f"""
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{probs}]))) AS edges FROM d)""", """
bb AS (SELECT x, y, len(list_filter(edges[2:len(edges) - 1], lambda t: t < x)) AS bin FROM d, e)""") + """
SELECT CAST(bin AS BIGINT) AS bin, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean, count(*) AS n
FROM bb GROUP BY bin""" + f"""
HAVING (SELECT count(*) FROM d) >= {min_rows} AND (SELECT count(DISTINCT x) FROM d) >= {min_distinct}
   AND (SELECT count(DISTINCT bin) FROM bb) >= {min_bins}"""


SQL["a12_binned_means_v2"] = _binned(_V2_MODEL, "merged", "Population", "price", 12, 20, 4, 4)
SQL["a12_binned_means_v1"] = _binned([*LISTING_BASE, O.listings_clean()], "listings", "minimum_nights",
                                     "price", 20, 10, 1, 1)

SQL["m03_ols_hc3_one_regressor"] = with_(O.WIDE, *O.simple_fit_ctes("wide", "y", "l_quantity"), """
r AS (SELECT wide.l_quantity AS x, wide.y - b0 - b1 * wide.l_quantity AS e,
        1.0 / n + (wide.l_quantity - mx) * (wide.l_quantity - mx) / sxx AS h, n, mx, sxx FROM wide, b)""", """
w AS (SELECT e * e / ((1 - h) * (1 - h)) AS w, x, n, mx, sxx FROM r)""", """
v AS (SELECT sum(w * ((x - mx) / sxx) * ((x - mx) / sxx)) AS v1,
        sum(w * (1.0 / n - mx * (x - mx) / sxx) * (1.0 / n - mx * (x - mx) / sxx)) AS v0 FROM w)""") + """
SELECT 'Intercept' AS term, round(b0, 9) AS coef, round(sqrt(v0), 9) AS std_err, round(b0 / sqrt(v0), 9) AS z_value
FROM b, v
UNION ALL
SELECT 'l_quantity', round(b1, 9), round(sqrt(v1), 9), round(b1 / sqrt(v1), 9) FROM b, v"""

_SIMPLE = [*LISTING_BASE, O.listings_clean(), *O.simple_fit_ctes()]
SQL["m08_linear_predict"] = with_(*_SIMPLE) + """
SELECT listing_id, round(b0 + b1 * minimum_nights, 6) AS pred_log_price,
  round(exp(b0 + b1 * minimum_nights), 6) AS pred_price FROM listings, b"""

SQL["a14_regression_metrics"] = with_(*_SIMPLE, """
p AS (SELECT log_price, price, b0 + b1 * minimum_nights AS pred_log, exp(b0 + b1 * minimum_nights) AS pred_price
      FROM listings, b)""") + """
SELECT count(*) AS n,
  round(1 - sum((log_price - pred_log) * (log_price - pred_log))
        / (sum(log_price * log_price) - sum(log_price) * sum(log_price) / count(*)), 6) AS r2_log,
  round(avg(abs(log_price - pred_log)), 6) AS mae_log,
  round(sqrt(avg((log_price - pred_log) * (log_price - pred_log))), 6) AS rmse_log,
  round(avg(abs(price - pred_price)), 6) AS mae_price,
  round(sqrt(avg((price - pred_price) * (price - pred_price))), 6) AS rmse_price,
  round(least(min(price), min(pred_price)), 6) AS axis_min,
  round(greatest(max(price), max(pred_price)), 6) AS axis_max
FROM p"""

SQL["w01_durbin_watson"] = with_(*_SIMPLE, """
p AS (SELECT listing_id, log_price - (b0 + b1 * minimum_nights) AS e, log_price FROM listings, b)""", """
d AS (SELECT e, e - lag(e) OVER (ORDER BY listing_id) AS d FROM p)""", """
m AS (SELECT count(*) AS n, avg(e) AS m1 FROM p)""", """
cm AS (SELECT avg(power(e - m1, 2)) AS c2, avg(power(e - m1, 3)) AS c3, avg(power(e - m1, 4)) AS c4, n
       FROM p, m GROUP BY n)""", """
st AS (SELECT c3 / power(c2, 1.5) AS sk, c4 / (c2 * c2) AS ku, n FROM cm)""") + """
SELECT 'durbin_watson' AS metric, round(sum(d * d) / sum(e * e), 6) AS value FROM d
UNION ALL SELECT 'skew', round(sk, 6) FROM st
UNION ALL SELECT 'kurtosis', round(ku, 6) FROM st
UNION ALL SELECT 'jarque_bera', round(n / 6.0 * (sk * sk + (ku - 3) * (ku - 3) / 4.0), 6) FROM st
UNION ALL SELECT 'rsquared', round(1 - (SELECT sum(e * e) FROM p)
   / (SELECT sum((log_price - my) * (log_price - my)) FROM p, b), 6)"""

_HASH = "((listing_id % 1000003) * 7919 + (listing_id // 1000003) * 104729 + 42 * 15485863) % 1000033"
SQL["w02_permutation"] = with_(*LISTING_BASE, O.listings_clean(), f"""
k AS (SELECT listing_id, row_number() OVER (ORDER BY listing_id) AS p FROM listings)""", f"""
h AS (SELECT listing_id AS donor_key, price AS permuted_price,
        row_number() OVER (ORDER BY {_HASH}, listing_id) AS p FROM listings)""") + """
SELECT k.listing_id, h.donor_key, round(h.permuted_price, 6) AS permuted_price FROM k JOIN h USING (p)"""

# ---------------------------------------------------------------------------
# Design sums, splits, preprocessing, ridge path, PCA, correlation, VIF
# ---------------------------------------------------------------------------
_LEVELS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_terms = [("Intercept", "1.0")] + [(f"C(room_type)[T.{lv}]", f"CAST(room_type = '{lv}' AS DOUBLE)")
                                   for lv in _LEVELS] + \
    [("C(month)[T.September]", "CAST(month = 'September' AS DOUBLE)"), ("minimum_nights", "minimum_nights"),
     ("amenities_index", "amenities_index")] + \
    [(f"C(room_type)[T.{lv}]:amenities_index", f"CAST(room_type = '{lv}' AS DOUBLE) * amenities_index")
     for lv in _LEVELS]
SQL["m01_design_sums"] = with_(*_V2_MODEL) + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS term, count(*) AS n, round(sum({e}), 4) AS sum_x, round(sum({e} * log_price), 4) AS sum_xy "
    f"FROM merged" for name, e in _terms)

_HP = [*LISTING_BASE, O.listings_clean(), f"""
hp AS (SELECT *, row_number() OVER (ORDER BY {_HASH}, listing_id) - 1 AS hpos, count(*) OVER () AS nn
       FROM listings)""", """
sp AS (SELECT *, hpos < ceil(CAST(0.2 AS DOUBLE) * nn) AS is_test FROM hp)"""]
SQL["m09_holdout_split"] = with_(*_HP) + """
SELECT is_test, count(*) AS n, round(avg(log_price), 6) AS mean_log_price FROM sp GROUP BY is_test"""

SQL["m10_kfold_assignment"] = with_(*_HP, """
f AS (SELECT *, CASE WHEN hpos < (nn // 5 + 1) * (nn % 5) THEN hpos // (nn // 5 + 1)
                     ELSE (nn % 5) + (hpos - (nn // 5 + 1) * (nn % 5)) // (nn // 5) END AS fold FROM hp)""") + """
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(avg(log_price), 6) AS mean_log_price,
  min(listing_id) AS min_key FROM f GROUP BY fold"""

_SC = ["minimum_nights", "availability_365", "reviews_per_month"]
SQL["m11_standard_scaler"] = with_(*_HP, "\ntr AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in _SC)
    + " FROM sp WHERE NOT is_test)") + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(m_{c}, 6) AS train_mean, round(s_{c}, 6) AS train_std, "
    f"round(avg(({c} - m_{c}) / s_{c}), 6) AS test_scaled_mean, round(max(({c} - m_{c}) / s_{c}), 6) AS test_scaled_max "
    f"FROM sp, tr WHERE is_test GROUP BY m_{c}, s_{c}" for c in _SC)

SQL["m12_median_imputer"] = with_(*_HP, """
med AS (SELECT median(accommodates) AS ma, median(number_of_reviews) AS mr FROM sp WHERE NOT is_test)""") + """
SELECT listing_id, round(coalesce(accommodates, ma), 6) AS accommodates,
  round(coalesce(number_of_reviews, mr), 6) AS number_of_reviews FROM sp, med WHERE is_test"""

SQL["m13_mode_imputer"] = with_(*LISTING_BASE, f"""
typed AS (SELECT * FROM listings_typed WHERE price IS NOT NULL AND ZIP_CODE IS NOT NULL AND price BETWEEN {O.LO} AND {O.HI})""", """
md AS (SELECT room_type AS mode FROM typed WHERE month = 'June' AND room_type IS NOT NULL
       GROUP BY room_type ORDER BY count(*) DESC, room_type LIMIT 1)""") + """
SELECT listing_id, coalesce(room_type, mode) AS room_type FROM typed, md WHERE month = 'September'"""

SQL["m14_onehot_unknown_level"] = with_(*LISTING_BASE, O.listings_clean(), """
bands AS (SELECT CAST(floor(price / 100) AS BIGINT) AS band FROM listings)""") + "SELECT " + ", ".join(
    f"round(sum(CASE WHEN band = {b} THEN 1.0 ELSE 0.0 END), 6) AS price_band_{b}" for b in range(4)) + \
    ", count(*) FILTER (WHERE band >= 4) AS n_all_zero FROM bands"

SQL["m19_ridge_path"] = with_(*LISTING_BASE, O.listings_clean(), """
st AS (SELECT count(*) AS n, corr(minimum_nights, availability_365) AS r,
         covar_pop(minimum_nights, log_price) / stddev_pop(minimum_nights) AS c1,
         covar_pop(availability_365, log_price) / stddev_pop(availability_365) AS c2 FROM listings)""", """
al AS (SELECT CAST(range AS INTEGER) AS alpha_index, power(10, -3 + 6 * range / 24.0) AS alpha FROM range(25))""") + """
SELECT alpha_index, round(alpha, 9) AS alpha,
  round(((n + alpha) * n * c1 - n * r * n * c2) / ((n + alpha) * (n + alpha) - (n * r) * (n * r)), 9) AS coef_1,
  round(((n + alpha) * n * c2 - n * r * n * c1) / ((n + alpha) * (n + alpha) - (n * r) * (n * r)), 9) AS coef_2
FROM st, al"""

_L = [f'"{c}"' for c in O.LANDMARKS]
SQL["m22_pca_two_columns"] = with_(O.AREA_TARGET_RAW, f"""
st AS (SELECT corr({_L[0]}, {_L[2]}) AS r FROM area_target_raw)""") + """
SELECT 1 AS component, round((1 + abs(r)) / 2, 9) AS explained_variance_ratio, round(1 / sqrt(2), 9) AS loading_1,
  round(sign(r) / sqrt(2), 9) AS loading_2 FROM st
UNION ALL
SELECT 2, round((1 - abs(r)) / 2, 9), round(1 / sqrt(2), 9), round(-sign(r) / sqrt(2), 9) FROM st"""

SQL["a09_correlation_long"] = with_(O.AREA_TARGET_RAW) + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr(\"{a}\", \"{b}\"), 9) AS pearson_r FROM area_target_raw"
    for a in O.LANDMARKS for b in O.LANDMARKS)

SQL["a10_high_correlation_pairs"] = with_(O.AREA_TARGET_RAW, "\npr AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr(\"{a}\", \"{b}\") AS r FROM area_target_raw"
    for i, a in enumerate(O.LANDMARKS) for b in O.LANDMARKS[i + 1:]) + ")") + """
SELECT feature_1, feature_2, round(r, 9) AS pearson_r, round(abs(r), 9) AS abs_r FROM pr WHERE abs(r) >= 0.8"""

_a, _b, _c = _L[:3]
SQL["a11_vif_three_predictors"] = with_(O.AREA_TARGET_RAW, f"""
rr AS (SELECT corr({_a}, {_b}) AS r12, corr({_a}, {_c}) AS r13, corr({_b}, {_c}) AS r23 FROM area_target_raw)""", """
v AS (SELECT 1.0 / (1 - (r12 * r12 + r13 * r13 - 2 * r12 * r13 * r23) / (1 - r23 * r23)) AS v1,
             1.0 / (1 - (r12 * r12 + r23 * r23 - 2 * r12 * r13 * r23) / (1 - r13 * r13)) AS v2,
             1.0 / (1 - (r13 * r13 + r23 * r23 - 2 * r12 * r13 * r23) / (1 - r12 * r12)) AS v3 FROM rr)""", """
vv AS (SELECT '""" + O.LANDMARKS[0] + """' AS feature, v1 AS VIF FROM v UNION ALL
       SELECT '""" + O.LANDMARKS[1] + """', v2 FROM v UNION ALL SELECT '""" + O.LANDMARKS[2] + """', v3 FROM v)""") + """
SELECT feature, round(VIF, 6) AS VIF,
  CASE WHEN VIF > 10 THEN 'severe' WHEN VIF > 5 THEN 'warning' ELSE 'ok' END AS band FROM vv"""

SQL["t01_stream_incident_rollup"] = SQL["a01_incident_rollup"]


# ---------------------------------------------------------------------------
# Editions, least squares on many regressors, reports and trends
# ---------------------------------------------------------------------------
from . import oracle_models as OM  # noqa: E402
from .catalog import (EXTERNAL_CANDIDATES, V1_PREDICTORS, V1_REDUNDANT, V1_TRENDS, V2_AREA_VARS, V2_LISTING_CONTROLS,  # noqa: E402
                      V2_TRENDS, V3_AREA, V3_NUMERIC, WIDE_NUMERIC)

SQL["f01_listings_clean_external"] = with_(*LISTING_BASE, O.listings_clean(edition="external")) + O.sel(
    ["listing_id", "ZIP_CODE", "month", "price", "log_price", "LATITUDE", "LONGITUDE"], "listings", ints=("listing_id", "ZIP_CODE", "month"))

SQL["s12_first_existing"] = with_(O.AREA_TARGET_RAW, O.AREA_TARGET_TYPED) + f"""
SELECT round(Count_Educational_Facility, 6) AS facilities, 'Count_Educational_Facility' AS column_used, count(*) AS n_areas,
  round(avg({_L[0]}), 6) AS mean_distance FROM area_target_typed GROUP BY Count_Educational_Facility"""

_CATEGORY = [(f"C(room_type)[T.{lv}]", f"(room_type = '{lv}')::DOUBLE") for lv in _LEVELS]
_MONTH = [("C(month)[T.September]", "(month = 'September')::DOUBLE")]


def _plain(names):
    return [(n, n) for n in names]


def _coef(ctes, src, y, terms, extra="", tail="", intercept="Intercept", digits=6, p=True):
    shown = ["coef", "std_err", "z_value"] + ["p_value"] * p
    return OM.recursive(*ctes, *OM.ols_ctes(src, y, terms), OM.ols_coef(terms, intercept)) + "SELECT term, " + ", ".join(
        f"round({c}, {digits}) + 0.0 AS {c}" for c in shown) + extra + " FROM coef" + tail


_V2_TERMS = _CATEGORY + _MONTH + _plain(V2_LISTING_CONTROLS + V2_AREA_VARS)
_PCT = ", round((exp(coef) - 1) * 100, 6) AS pct_effect_if_log_model"
_ABS = ", round(abs(coef), 6) AS abs_coef"
SQL["m05_ols_coefficients_v2"] = _coef(_V2_MODEL, "merged", "log_price", _V2_TERMS, _PCT + _ABS)
SQL["m24_significant_terms_v2"] = _coef(_V2_MODEL, "merged", "log_price", _V2_TERMS, _PCT,
                                        " WHERE p_value < 0.05 AND term <> 'Intercept'")
SQL["m06_fit_statistics_v2"] = OM.recursive(*_V2_MODEL, *OM.ols_ctes("merged", "log_price", _V2_TERMS),
                                            *OM.fit_stats(len(_V2_TERMS))) + "SELECT metric, round(value, 4) AS value FROM stats"

_WIDE_TERMS = [("C(l_returnflag)[T.N]", "(l_returnflag = 'N')::DOUBLE"), ("C(l_returnflag)[T.R]", "(l_returnflag = 'R')::DOUBLE"),
               ("C(l_linestatus)[T.O]", "(l_linestatus = 'O')::DOUBLE"), *_plain(WIDE_NUMERIC)]
SQL["m04_ols_hc3_wide"] = _coef([O.WIDE], "wide", "y", _WIDE_TERMS)

# v1: listing-level fills, redundant totals pruned
_V1_KEPT = [c for c in V1_PREDICTORS if c not in {raw for raw, rate in V1_REDUNDANT if rate in V1_PREDICTORS}]
_ZERO = ("number_of_reviews", "reviews_per_month", "number_of_reviews_ltm")
_V1_FILLED = [*_MERGED_V1, "\nfilled AS (SELECT listing_id, log_price, price, room_type, month, " + ", ".join(
    f"coalesce({x}, median({x}) OVER ()) AS {c}" for c in V1_PREDICTORS
    for x in [f"coalesce({c}, 0.0)" if c in _ZERO else c]) + " FROM merged)"]
_V1_TERMS = _CATEGORY + _MONTH + _plain(_V1_KEPT)
SQL["m05_ols_coefficients_v1"] = _coef(_V1_FILLED, "filled", "log_price", _V1_TERMS, _ABS)
SQL["m24_top_terms_v1"] = _coef(_V1_FILLED, "filled", "log_price", _V1_TERMS, _ABS,
                                " WHERE p_value < 0.05 AND term <> 'Intercept' ORDER BY abs(coef) DESC, term LIMIT 20")
SQL["m17_ols_predictions_v1"] = OM.recursive(*_V1_FILLED, *OM.ols_ctes("filled", "log_price", _V1_TERMS, "listing_id, price, log_price")) + """
SELECT listing_id, round(price, 5) AS price, round(log_price, 5) AS log_price, round(y - e, 5) AS predicted_log_price,
  round(exp(y - e), 5) AS predicted_price FROM res"""


def _trends(ctes, src, features, **rules):
    """One binned-means query for each feature, stacked."""
    parts = [f"SELECT *, '{x}' AS feature FROM (" + _binned(ctes, src, x, "price", **rules).replace(", 6)", ", 5)") + ")" for x in features]
    return " UNION ALL ".join(parts)


SQL["m25_trend_tables_v1"] = _trends(_V1_FILLED, "filled", V1_TRENDS, q=20, min_rows=10)
SQL["m25_trend_tables_v2"] = _trends(_V2_MODEL, "merged", V2_TRENDS, q=12, min_rows=20, min_distinct=4, min_bins=4)

SQL["s06_diagnostics_report_v2"] = with_(*_V2_MODEL, """
joined AS (SELECT l.*, z.ZIP_CODE AS hit FROM listings l LEFT JOIN zip_all z USING (ZIP_CODE))""") + f"""
SELECT section, metric, round(value::DOUBLE, 6) AS value FROM (
  SELECT 'listings' AS section, unnest(['airbnb_raw_rows', 'airbnb_after_required_filters', 'airbnb_after_price_trim', 'airbnb_unique_zips']) AS metric,
    unnest([count(*), count(*) FILTER (WHERE {_REQ}), count(*) FILTER (WHERE {_REQ} AND price BETWEEN {O.LO} AND {O.HI}),
            count(DISTINCT ZIP_CODE) FILTER (WHERE {_REQ} AND price BETWEEN {O.LO} AND {O.HI})]::DOUBLE[]) AS value FROM listings_typed
  UNION ALL
  SELECT 'incidents', unnest(['crime_total_rows_read', 'crime_rows_with_valid_zip', 'crime_aggregated_total_events', 'crime_total_part1_rows',
      'crime_unique_zip_after_aggregation', 'share_crime_rows_retained_after_zip_cleaning']),
    unnest([count(*), count(ZIP_CODE), (SELECT sum(crime_events) FROM rollup), (SELECT sum(part1_events) FROM rollup), (SELECT count(*) FROM rollup),
            (SELECT sum(crime_events) FROM rollup) / count(*)]::DOUBLE[]) FROM incidents
  UNION ALL
  SELECT 'dimension and merge', unnest(['area_rows', 'area_unique_zips', 'area_zips_with_incidents', 'listings_before_merge', 'listings_with_area',
      'listings_without_area', 'listings_after_core_filter']),
    unnest([(SELECT count(*) FROM zip_all), (SELECT count(DISTINCT ZIP_CODE) FROM zip_all),
            (SELECT count(*) FROM zip_all WHERE ZIP_CODE IN (SELECT ZIP_CODE FROM rollup)), count(*), count(hit), count(*) - count(hit),
            (SELECT count(*) FROM merged)]::DOUBLE[]) FROM joined)"""

# v3: log controls, size medians, z-scores of the incident rate, interactions
_RATES = ["crime_events", "violent_crime_events", "property_crime_events"]
_PER = {"crime_events": "crime_events", "violent_crime_events": "violent_crime", "property_crime_events": "property_crime"}
_V3_AREA_COLS = [*_V3_COLS, "crime_events", "violent_crime_events", "property_crime_events", "part1_events",
                 *[f"{_PER[c]}_per_capita" for c in _RATES], *[f"{_PER[c]}_per_10k" for c in _RATES], "crime_events_z"]
_V3_LISTINGS = "\nlisting3 AS (SELECT listing_id, ZIP_CODE, log_price, price, room_type, month, " + ", ".join(
    f"{O.log1p0(src)} AS {new}" for src, new in _LOGF) + ", " + ", ".join(
    f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in ["accommodates", "bedrooms", "beds", "bathrooms"]) + \
    ", LATITUDE, LONGITUDE FROM listings)"
_V3_MODEL = [*LISTING_BASE, O.listings_clean(), _V3_LISTINGS, *AREA_BASE, O.AREA_V3, *INCIDENT_BASE, """
joined0 AS (SELECT a.*, r.* EXCLUDE (ZIP_CODE), """ + ", ".join(
    f"{O.pc('r.' + c, 'a.Population')} AS {_PER[c]}_per_capita, {O.pc('r.' + c, 'a.Population')} * 10000.0 AS {_PER[c]}_per_10k"
    for c in _RATES) + " FROM area a LEFT JOIN rollup r USING (ZIP_CODE))", f"""
joined AS (SELECT *, {O.z('crime_events_per_capita')} AS crime_events_z FROM joined0)""",
             O.fill_all(_V3_AREA_COLS, "joined", "zip_all"), """
merged AS (SELECT l.*, z.* EXCLUDE (ZIP_CODE) FROM listing3 l LEFT JOIN zip_all z USING (ZIP_CODE))"""]
_V3_TERMS = _CATEGORY + _MONTH + _plain(V3_NUMERIC + V3_AREA) + [
    (f"C(room_type)[T.{lv}]:{c}", f"(room_type = '{lv}')::DOUBLE * {c}") for c in ["crime_events_z", "amenities_index"] for lv in _LEVELS]
SQL["m05_ols_coefficients_v3"] = _coef(_V3_MODEL, "merged", "log_price", _V3_TERMS)

# external: area features and the month only
_EXT_AREA_COLS = [*_EXT_COLS, "crime_events", "violent_crime_events", "property_crime_events", "part1_events",
                  *[f"{_PER[c]}_per_10k" for c in _RATES], "crime_events_z", "violent_crime_z", "property_crime_z"]
_EXT_MODEL = [*LISTING_BASE, O.listings_clean(edition="external"), O.AREA_TARGET_RAW, O.AREA_TARGET_TYPED, O.AREA_EXTERNAL, *INCIDENT_BASE, """
joined0 AS (SELECT a.*, r.* EXCLUDE (ZIP_CODE), """ + ", ".join(
    f"{O.pc('r.' + c, 'a.Population')} * 10000.0 AS {_PER[c]}_per_10k" for c in _RATES) + " FROM area a LEFT JOIN rollup r USING (ZIP_CODE))", """
joined AS (SELECT *, """ + ", ".join(f"{O.z(f'{_PER[c]}_per_10k')} AS {_PER[c]}_z" for c in _RATES) + " FROM joined0)",
              O.fill_all(_EXT_AREA_COLS, "joined", "zip_all"), """
merged AS (SELECT l.*, z.* EXCLUDE (ZIP_CODE) FROM listings l LEFT JOIN zip_all z USING (ZIP_CODE))"""]
SQL["m05_ols_coefficients_external"] = _coef(_EXT_MODEL, "merged", "log_price", _MONTH + _plain(EXTERNAL_CANDIDATES))

# Area-level model
_AREA_MODEL = [O.AREA_TARGET_RAW, O.AREA_TARGET_TYPED, f"""
target AS (
  SELECT *, ln(Median_Price_June) AS y, {O.log1pn('Population')} AS log_population, {O.log1pn('Part_1_Crime_Count')} AS log_part_1_crime_count,
    Part_1_Crime_Per_Capita * 10000.0 AS crime_per_10k FROM area_target_typed WHERE Median_Price_June > 0 AND Median_Price_June < 5000)""",
               "\nscored AS (SELECT *, -(" + " + ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in _L)
               + f") / {len(_L)}.0 AS centrality_index FROM target)"]
_AREA_BASE_TERMS = _plain(["log_population", "log_part_1_crime_count", "crime_per_10k", "Count_Educational_Facility", "Count_Public_Safety",
                           "Count_Fire_Stations", "Count_Corrective_Facility"])
_DIST_TERMS = list(zip(O.LANDMARKS, _L))
SQL["a06_centrality_index"] = with_(*_AREA_MODEL) + "SELECT ZIP_CODE, round(centrality_index, 6) + 0.0 AS centrality_index FROM scored"
SQL["m02_area_ols_coefficients"] = _coef(_AREA_MODEL, "scored", "y", _AREA_BASE_TERMS + _DIST_TERMS, intercept="const")
_CENTRAL = _AREA_BASE_TERMS + _plain(["centrality_index"])
SQL["m02_area_ols_centrality"] = _coef(_AREA_MODEL, "scored", "y", _CENTRAL, intercept="const")
SQL["m17_area_ols_predictions"] = OM.recursive(*_AREA_MODEL, *OM.ols_ctes("scored", "y", _CENTRAL, "ZIP_CODE, Median_Price_June")) + """
SELECT ZIP_CODE, round(Median_Price_June, 5) AS price, round(y - e, 5) AS predicted_log_price, round(exp(y - e), 5) AS predicted_price FROM res"""
SQL["m22_pca_scores_two_columns"] = with_(*_AREA_MODEL, f"""
pz AS (SELECT ZIP_CODE, ({_L[0]} - avg({_L[0]}) OVER ()) / stddev_pop({_L[0]}) OVER () AS a,
         ({_L[2]} - avg({_L[2]}) OVER ()) / stddev_pop({_L[2]}) OVER () AS b, corr({_L[0]}, {_L[2]}) OVER () AS r FROM target)""") + """
SELECT ZIP_CODE, round((a + sign(r) * b) / sqrt(2), 6) + 0.0 AS distance_pc1, round((a - sign(r) * b) / sqrt(2), 6) + 0.0 AS distance_pc2 FROM pz"""

# Audit: June landmarks, raw and derived predictors, medians for missing values
_AUDIT = [*_AREA_MODEL[:3], "\naudit0 AS (SELECT *, " + ", ".join([
    f"{O.z('Part_1_Crime_Per_Capita')} AS crime_z", f"{O.z('Count_Educational_Facility')} AS education_facilities_z",
    f"{O.z('Count_Public_Safety')} AS public_safety_z",
    "(" + " + ".join(O.z(c) for c in ["Count_Educational_Facility", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations"])
    + ") / 4.0 AS external_amenities_index",
    "(" + " + ".join(O.z(c) for c in _L) + f") / {len(_L)}.0 AS avg_landmark_distance_z"]) + " FROM target)", """
audit1 AS (SELECT *, -avg_landmark_distance_z AS centrality_index FROM audit0)"""]
from .plans.area_model import AUDIT_BASE  # noqa: E402

_AUDITED = AUDIT_BASE + O.LANDMARKS
_AUDIT.append("\naudited AS (SELECT " + ", ".join(f'coalesce("{c}", median("{c}") OVER ()) AS "{c}"' for c in _AUDITED) + " FROM audit1)")
_PAIRS = "\npr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr(\"{a}\", \"{b}\") AS r FROM audited"
    for i, a in enumerate(_AUDITED) for b in _AUDITED[i + 1:]) + ")"
SQL["a10_collinearity_pairs"] = with_(*_AUDIT, _PAIRS) + """
SELECT feature_1, feature_2, round(r, 9) AS pearson_r, round(abs(r), 9) AS abs_r FROM pr WHERE abs(r) >= 0.8"""
SQL["m16_boosted_quality_v3"] = with_(*LISTING_BASE, O.listings_clean(), "\nk AS (SELECT count(*) AS n FROM listings)") + """
SELECT unnest(['train_rows', 'test_rows', 'more_than_one_tree', 'cut_at_the_best_iteration', 'test_r2_at_least_least_squares']) AS metric,
  unnest([(n - ceil(0.2::DOUBLE * n))::BIGINT::VARCHAR, ceil(0.2::DOUBLE * n)::BIGINT::VARCHAR, 'true', 'true', 'true']) AS value FROM k"""
SQL["m16_boosted_quality_external"] = with_(*LISTING_BASE, O.listings_clean(edition="external"), "\nk AS (SELECT count(*) AS n FROM listings)") + """
SELECT unnest(['train_rows', 'test_rows', 'more_than_one_tree', 'cut_at_the_best_iteration', 'test_r2_at_least_least_squares']) AS metric,
  unnest([(n - ceil(0.2::DOUBLE * n))::BIGINT::VARCHAR, ceil(0.2::DOUBLE * n)::BIGINT::VARCHAR, 'true', 'true', 'true']) AS value FROM k"""
SQL["m16_boosted_quality_area"] = with_(*_AREA_MODEL, "\nk AS (SELECT count(*) AS n FROM target WHERE " + " AND ".join(
    f"{e} IS NOT NULL" for _, e in _AREA_BASE_TERMS + _DIST_TERMS) + ")") + """
SELECT unnest(['rows', 'folds', 'mean_fold_r2_at_least_least_squares']) AS metric, unnest([n::VARCHAR, '5', 'true']) AS value FROM k"""
SQL["t01_stream_progress"] = """
SELECT CAST(event_id % 3 AS INTEGER) AS chunk, true AS one_chunk, count(*) AS rows_read,
  count(CASE WHEN event_id % 29 <> 7 THEN user_id END) AS rows_with_valid_zip
FROM events GROUP BY event_id % 3"""
SQL["t01_stream_counters"] = "SELECT 'rows_read' AS metric, count(*) AS value FROM events"

# Importance of both slopes of the two-regressor fit on the training rows, scored on the test rows
_TWO = _plain(["minimum_nights", "availability_365"])
SQL["m18_permutation_importance_linear"] = OM.recursive(
    *_HP, "\ntraining AS (SELECT * FROM sp WHERE NOT is_test)", *OM.ols_ctes("training", "log_price", _TWO), """
t0 AS (SELECT listing_id, log_price AS y, [minimum_nights::DOUBLE, availability_365::DOUBLE] AS x FROM sp WHERE is_test)""", """
t AS (SELECT listing_id, y, x, y - b0 - list_dot_product(b, x) AS e FROM t0, full_fit)""", """
k AS (SELECT listing_id, x, e, row_number() OVER (ORDER BY listing_id) AS pos FROM t)""", """
reps AS (SELECT range AS rep FROM range(5))""", """
hsh AS (SELECT rep, x AS dx, row_number() OVER (PARTITION BY rep ORDER BY ((listing_id % 1000003) * 7919
          + (listing_id // 1000003) * 104729 + (42 + rep) * 15485863) % 1000033, listing_id) AS pos FROM t, reps)""", """
base AS (SELECT sum(e * e) AS sse, count(*) * var_pop(y) AS sst FROM t)""", """
ft AS (SELECT range AS f FROM range(1, 3))""", """
perm AS (SELECT rep, f, sum(pow(e + b[f] * (k.x[f] - hsh.dx[f]), 2)) AS s FROM k JOIN hsh USING (pos), slopes, ft GROUP BY rep, f)""", """
dd AS (SELECT f, (s - sse) / sst AS d FROM perm, base)""") + """
SELECT ['minimum_nights', 'availability_365'][f] AS feature, round(avg(d), 8) + 0.0 AS importance_mean, round(stddev_pop(d), 8) + 0.0 AS importance_std
FROM dd GROUP BY f"""

# ---------------------------------------------------------------------------
# Orthogonal least squares, absorbed factors, wide correlation, collinear sets, CSV audit, scatter sample
# ---------------------------------------------------------------------------
from .catalog import ABSORBED, DEPENDENT, POLYNOMIAL_DEGREE, SCATTER_ROWS, WIDE_COLUMNS  # noqa: E402

# The fitted values of a polynomial do not depend on its basis: here Legendre polynomials of the scaled quantity.
_LEGENDRE = ["t", "(3*pow(t,2)-1)/2", "(5*pow(t,3)-3*t)/2", "(35*pow(t,4)-30*pow(t,2)+3)/8", "(63*pow(t,5)-70*pow(t,3)+15*t)/8",
             "(231*pow(t,6)-315*pow(t,4)+105*pow(t,2)-5)/16"][:POLYNOMIAL_DEGREE]
SQL["m03_ols_qr_polynomial"] = OM.recursive(
    O.WIDE, "\nscaled AS (SELECT *, (l_quantity::DOUBLE - 25.5) / 24.5 AS t FROM wide)",
    *OM.ols_ctes("scaled", "y", [(f"p{i}", e) for i, e in enumerate(_LEGENDRE)]), """
points AS (SELECT l_quantity, count(*) AS n, (l_quantity::DOUBLE - 25.5) / 24.5 AS t FROM wide GROUP BY l_quantity)""") + f"""
SELECT l_quantity, points.n, round(b0 + list_dot_product(b, [{", ".join(f"({e})::DOUBLE" for e in _LEGENDRE)}]), 8) + 0.0 AS fitted FROM points, full_fit"""

_WITHIN = [O.WIDE, "\nlm AS (SELECT l_partkey, count(*) AS n_level, avg(y) AS m_y, " + ", ".join(f"avg({c}) AS m_{c}" for c in ABSORBED)
           + " FROM wide GROUP BY l_partkey)",
           "\ncentred AS (SELECT y - m_y AS yw, " + ", ".join(f"{c} - m_{c} AS {c}_w" for c in ABSORBED) + " FROM wide JOIN lm USING (l_partkey))",
           *OM.ols_ctes("centred", "yw", [(c, f"{c}_w") for c in ABSORBED])]
SQL["m03_ols_absorbed_factor"] = OM.recursive(*_WITHIN) + f"""
SELECT unnest({ABSORBED}) AS term, round(unnest(b), 9) + 0.0 AS coef, n, (SELECT count(*) FROM lm) AS levels FROM full_fit"""
SQL["m01_absorbed_level_effects"] = OM.recursive(*_WITHIN) + f"""
SELECT l_partkey, n_level AS rows, round(m_y - list_dot_product(b, [{", ".join(f"m_{c}::DOUBLE" for c in ABSORBED)}]), 7) + 0.0 AS effect
FROM lm, full_fit"""

_base = ["l_orderkey", "l_partkey", "l_suppkey"]
SQL["a10_wide_correlation_pairs"] = "WITH many AS (SELECT " + ", ".join(
    f"(({_base[j % 3]} * {2 * j + 1} + l_linenumber * {j}) % {7 + j % 5} + l_quantity * {j % 4})::DOUBLE AS {c}"
    for j, c in enumerate(WIDE_COLUMNS)) + " FROM lineitem), one AS (SELECT " + ", ".join(
    f"corr({a}, {b}) AS {a}_{b}" for i, a in enumerate(WIDE_COLUMNS) for b in WIDE_COLUMNS[i + 1:]) + """ FROM many),
pairs AS (UNPIVOT one ON COLUMNS(*) INTO NAME pair VALUE r)
SELECT split_part(pair, '_', 1) AS feature_1, split_part(pair, '_', 2) AS feature_2, round(r, 9) + 0.0 AS pearson_r, round(abs(r), 9) AS abs_r
FROM pairs WHERE abs(r) >= 0.8"""


def _vif(rows: str, columns: list[str]) -> list[str]:
    """CTE ``vif`` (feature, v) over the complete rows of a table: a column that others determine has no pivot, and
    those it is determined by have a share in it."""
    k = len(columns)
    corr = "[" + ", ".join("[" + ", ".join(f'corr("{a}", "{b}")' for b in columns) + "]" for a in columns) + "]"
    return [f"\ncm AS (SELECT {corr} AS g FROM {rows})", OM._inverse("ci", "cm", "g"), f"""
vif AS (SELECT {columns!r}[i] AS feature, CASE WHEN NOT used[i] OR len(list_filter(range(1, {k + 1}), lambda p: NOT used[p] AND abs(m[i][p]) > 1e-6)) > 0
          THEN 'inf'::DOUBLE ELSE greatest(a[i][i], 1.0) END AS v FROM ci, range(1, {k + 1}) r(i))"""]


_BANDED = "CASE WHEN v > 10 THEN 'severe' WHEN v > 5 THEN 'warning' ELSE 'ok' END AS band"
SQL["a11_vif_dependent_columns"] = OM.recursive(
    *_AUDIT[:3], "\nchosen AS (SELECT " + ", ".join(f'"{c}"' for c in DEPENDENT) + " FROM target WHERE "
    + " AND ".join(f'"{c}" IS NOT NULL' for c in DEPENDENT) + ")", *_vif("chosen", DEPENDENT)) + f"""
SELECT feature, round(v, 6) AS VIF, {_BANDED} FROM vif"""

SQL["s01_csv_audit"] = """
SELECT count(*) AS records, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) AS complete,
  count(*) FILTER (c_custkey % 7 = 0) AS short, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 11 = 0) AS long,
  count(*) FILTER (c_custkey % 13 = 0) AS with_line_break
FROM customer"""

SQL["m25_scatter_sample"] = with_(*_SIMPLE) + f"""
SELECT listing_id, round(price, 6) AS price, round(exp(b0 + b1 * minimum_nights), 6) AS predicted_price FROM listings, b
ORDER BY ((listing_id % 1000003) * 7919 + (listing_id // 1000003) * 104729 + 42 * 15485863) % 1000033, listing_id LIMIT {SCATTER_ROWS}"""

SQL["m23_collinearity_vif"] = OM.recursive(*_AUDIT, *_vif("audited", _AUDITED)) + f"""
SELECT feature, round(v, 4) AS VIF, {_BANDED} FROM vif"""
SQL["m23_collinearity_report"] = OM.recursive(*_AUDIT, _PAIRS, *_vif("audited", _AUDITED)) + f"""
SELECT 'input' AS section, unnest(['rows', 'predictors', 'dropped_all_null', 'dropped_constant']) AS metric,
  unnest([count(*)::DOUBLE, {len(_AUDITED)}.0, 0.0, 0.0]) AS value FROM audited
UNION ALL SELECT 'pairs', 'at_or_above_threshold', count(*)::DOUBLE FROM pr WHERE abs(r) >= 0.8
UNION ALL SELECT 'vif', band, count(*)::DOUBLE FROM (SELECT {_BANDED} FROM vif) GROUP BY band"""
SQL["o03_report_top_pairs"] = with_(*_AUDIT, _PAIRS) + """
SELECT feature_1, feature_2, round(r, 6) + 0.0 AS pearson_r, round(abs(r), 6) AS abs_r FROM pr WHERE abs(r) >= 0.01
ORDER BY round(abs(r), 9) DESC, feature_1, feature_2 LIMIT 40"""

# Ridge for two predictors from sums over the cells (outer fold o, inner block i); o = -1 is the fit on all rows
from .catalog import RIDGE_PAIR  # noqa: E402
from .plans.linear import RIDGE_ALPHAS  # noqa: E402

_block = lambda pos, n: (f"CASE WHEN {pos} < ({n} // 5 + 1) * ({n} % 5) THEN {pos} // ({n} // 5 + 1) "  # noqa: E731
                         f"ELSE ({n} % 5) + ({pos} - ({n} // 5 + 1) * ({n} % 5)) // ({n} // 5) END")
_SUMS = ["n", "s1", "s2", "sy", "s11", "s12", "s22", "s1y", "s2y", "syy"]
_less = lambda a, b: ", ".join(f"{a}.{c} - {b}.{c} AS {c}" for c in _SUMS)
_RIDGE = """s.s11 / (sc.d1 * sc.d1) - s.n * pow(s.s1 / s.n / sc.d1, 2) AS z11, s.s22 / (sc.d2 * sc.d2) - s.n * pow(s.s2 / s.n / sc.d2, 2) AS z22,
  (s.s12 - s.s1 * s.s2 / s.n) / (sc.d1 * sc.d2) AS z12, (s.s1y - s.s1 * s.sy / s.n) / sc.d1 AS y1, (s.s2y - s.s2 * s.sy / s.n) / sc.d2 AS y2"""
_SOLVED = """((z22 + alpha) * y1 - z12 * y2) / ((z11 + alpha) * (z22 + alpha) - z12 * z12) AS b1,
  ((z11 + alpha) * y2 - z12 * y1) / ((z11 + alpha) * (z22 + alpha) - z12 * z12) AS b2"""
_R2 = """1 - (t.syy - 2 * (f.a * t.sy + f.g1 * t.s1y + f.g2 * t.s2y) + t.n * f.a * f.a + 2 * f.a * (f.g1 * t.s1 + f.g2 * t.s2)
  + f.g1 * f.g1 * t.s11 + 2 * f.g1 * f.g2 * t.s12 + f.g2 * f.g2 * t.s22) / (t.syy - t.sy * t.sy / t.n)"""


def _ridge_fits(name: str, rows: str, alphas: str) -> str:
    """CTE: the fit (a, g1, g2, b1, b2) on each row of sums in ``rows`` (with o, i) for each alpha."""
    return f"""
{name} AS (SELECT *, b1 / d1 AS g1, b2 / d2 AS g2, sy / n - b1 / d1 * s1 / n - b2 / d2 * s2 / n AS a FROM (
  SELECT *, {_SOLVED} FROM (SELECT s.*, sc.d1, sc.d2, al.k, al.alpha, {_RIDGE} FROM {rows} s JOIN scale sc USING (o) JOIN {alphas} al ON al.o = s.o)))"""


SQL["m19_ridge_choice_two_predictors"] = with_(
    *_AREA_MODEL[:3], f"""
base AS (SELECT CAST(ZIP_CODE AS BIGINT) AS z, CAST({RIDGE_PAIR[0]} AS DOUBLE) AS x1, CAST("{RIDGE_PAIR[1]}" AS DOUBLE) AS x2, y FROM target
         WHERE {RIDGE_PAIR[0]} IS NOT NULL AND "{RIDGE_PAIR[1]}" IS NOT NULL)""", """
ranked AS (SELECT *, row_number() OVER (ORDER BY ((z % 1000003) * 7919 + (z // 1000003) * 104729 + 42 * 15485863) % 1000033, z) - 1 AS h,
             count(*) OVER () AS nn FROM base)""", f"""
folded AS (SELECT *, {_block('h', 'nn')} AS fold FROM ranked)""", """
outer_ AS (SELECT range AS o FROM range(-1, 5))""", """
placed AS (SELECT f.*, o, row_number() OVER (PARTITION BY o ORDER BY z) - 1 AS p, count(*) OVER (PARTITION BY o) AS no
           FROM folded f JOIN outer_ ON f.fold <> o)""", f"""
cells AS (SELECT o, {_block('p', 'no')} AS i, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12,
            sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy FROM placed GROUP BY 1, 2)""", f"""
total AS (SELECT o, -1 AS i, {", ".join(f"sum({c}) AS {c}" for c in _SUMS)} FROM cells GROUP BY o)""", """
scale AS (SELECT o, sqrt(s11 / n - pow(s1 / n, 2)) AS d1, sqrt(s22 / n - pow(s2 / n, 2)) AS d2 FROM total)""", f"""
inner_ AS (SELECT t.o, c.i, {_less('t', 'c')} FROM total t JOIN cells c USING (o))""", f"""
alphas AS (SELECT o, unnest(range(0, {len(RIDGE_ALPHAS)})) AS k, unnest({[float(a) for a in RIDGE_ALPHAS]!r}::DOUBLE[]) AS alpha FROM outer_)""",
    _ridge_fits("tried", "inner_", "alphas"), f"""
judged AS (SELECT f.o, f.k, f.alpha, avg({_R2}) AS score FROM tried f JOIN cells t ON t.o = f.o AND t.i = f.i GROUP BY f.o, f.k, f.alpha)""", """
chosen AS (SELECT o, k, alpha FROM judged QUALIFY row_number() OVER (PARTITION BY o ORDER BY score DESC, k) = 1)""",
    _ridge_fits("final", "total", "chosen"), f"""
every AS (SELECT * FROM total WHERE o = -1)""", f"""
tests AS (SELECT t.o, {_less('e', 't')} FROM total t, every e WHERE t.o >= 0)""", f"""
outer_scores AS (SELECT {_R2} AS r2 FROM final f JOIN tests t ON t.o = f.o)""", f"""
full_score AS (SELECT f.alpha, f.b1, f.b2, {_R2} AS r2 FROM final f JOIN every t ON t.o = f.o)""") + f"""
SELECT 'ridge_cv_r2_log_mean' AS metric, round(avg(r2), 6) + 0.0 AS value FROM outer_scores
UNION ALL SELECT 'ridge_cv_r2_log_std', round(stddev_pop(r2), 6) + 0.0 FROM outer_scores
UNION ALL SELECT 'ridge_chosen_alpha', round(alpha, 6) FROM full_score
UNION ALL SELECT 'ridge_full_fit_r2_log', round(r2, 6) + 0.0 FROM full_score
UNION ALL SELECT 'coef {RIDGE_PAIR[0]}', round(b1, 6) + 0.0 FROM full_score
UNION ALL SELECT 'coef {RIDGE_PAIR[1]}', round(b2, 6) + 0.0 FROM full_score"""

SQL["c11_month_flag"] = with_(*LISTING_BASE, O.listings_clean(edition="external")) + """
SELECT month, CAST(month = 'September' AS INTEGER) AS month_september, count(*) AS n, round(avg(log_price), 6) AS mean_log_price FROM listings GROUP BY month"""

# Months and categories in order; a value that the training rows lack cannot occur with these five and two levels
_ALL_LEVELS = ["1-URGENT", *_LEVELS]
_PRE = ["accommodates", "number_of_reviews"]
SQL["m15_column_preprocessor"] = with_(*LISTING_BASE, f"""
typed AS (SELECT * FROM listings_typed WHERE price IS NOT NULL AND ZIP_CODE IS NOT NULL AND price BETWEEN {O.LO} AND {O.HI})""", f"""
hp AS (SELECT *, row_number() OVER (ORDER BY {_HASH}, listing_id) - 1 AS hpos, count(*) OVER () AS nn FROM typed)""", """
sp AS (SELECT *, hpos < ceil(CAST(0.2 AS DOUBLE) * nn) AS is_test FROM hp)""", """
md AS (SELECT """ + ", ".join(f"median({c}) AS m_{c}" for c in _PRE) + """ FROM sp WHERE NOT is_test)""", """
ms AS (SELECT """ + ", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in _PRE)
    + """ FROM sp, md WHERE NOT is_test)""", """
mode AS (SELECT room_type AS mode FROM sp WHERE NOT is_test AND room_type IS NOT NULL GROUP BY room_type ORDER BY count(*) DESC, room_type LIMIT 1)""") + \
    "SELECT listing_id, " + ", ".join([f"round((coalesce({c}, m_{c}) - a_{c}) / s_{c}, 6) + 0.0 AS x{i}" for i, c in enumerate(_PRE, 1)]
    + [f"(month = '{m}')::INT::DOUBLE AS x{i}" for i, m in enumerate(["June", "September"], 3)]
    + [f"(coalesce(room_type, mode) = '{lv}')::INT::DOUBLE AS x{i}" for i, lv in enumerate(_ALL_LEVELS, 5)]) + " FROM sp, md, ms, mode WHERE is_test"
