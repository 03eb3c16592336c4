"""DuckDB SQL building blocks for the oracle queries.

Each CTE repeats one fixture derivation or operator from the library in plain
SQL, so the driver can run our Spark query and this SQL on the same Parquet
tables and compare results.
"""

from __future__ import annotations

from .functions.scalar import NUMERIC_TEXT, ZIP_MAX, ZIP_MIN
from .sources.fixtures import FIXTURE_PROPERTY, FIXTURE_VIOLENT, N_LANDMARKS, TRIM_HIGH, TRIM_LOW, landmark_name


LO, HI = TRIM_LOW, TRIM_HIGH


def num(expr: str) -> str:
    t = f"trim(CAST({expr} AS VARCHAR))"
    return f"(CASE WHEN regexp_full_match({t}, '{NUMERIC_TEXT}') THEN TRY_CAST({t} AS DOUBLE) END)"


def zipc(expr: str) -> str:
    d = num(expr)
    return (f"(CASE WHEN {d} BETWEEN {ZIP_MIN} AND {ZIP_MAX} AND {d} = floor({d}) "
            f"THEN CAST({d} AS BIGINT) END)")


def z(expr: str) -> str:
    sd = f"stddev_samp({expr}) OVER ()"
    return f"(CASE WHEN {sd} IS NULL OR {sd} = 0 THEN 0.0 ELSE ({expr} - avg({expr}) OVER ()) / {sd} END)"


def flag(expr: str, pattern: str) -> str:
    return f"CAST(regexp_matches(upper(coalesce({expr}, '')), '{pattern}') AS INTEGER)"


def pc(count: str, pop: str = "Population") -> str:
    return f"(CAST({count} AS DOUBLE) / nullif({pop}, 0))"


def log1p0(expr: str) -> str:
    return f"ln(1 + greatest(coalesce(CAST({expr} AS DOUBLE), 0.0), 0.0))"


def log1pn(expr: str) -> str:
    return f"(CASE WHEN {expr} IS NOT NULL THEN ln(1 + greatest({expr}, 0.0)) END)"


def r(expr: str, d: int = 6) -> str:
    return f"round({expr}, {d})"


# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------
def code(key: str) -> str:
    return f"CAST(10000 + ({key}) % 90000 AS VARCHAR)"


PRICE = ("55.0::DOUBLE * pow(1.0 + o_orderkey % 8, 0.7::DOUBLE) * (CASE left(o_orderpriority, 1) WHEN '1' THEN 1.6 WHEN '2' THEN 1.25 "
         "WHEN '3' THEN 1.0 ELSE 0.75 END)::DOUBLE * exp(0.06::DOUBLE * (o_custkey % 5) - 0.015::DOUBLE * (o_custkey % 23) "
         "+ 0.9::DOUBLE * (abs(o_custkey % 100 - 50) / 50.0::DOUBLE - 0.5::DOUBLE)) "
         "* pow(o_totalprice / 100, 0.12::DOUBLE)")

# The wide frame's target, as in ``sources.fixtures.wide_frame``.
WIDE = """
wide AS (
  SELECT 0.1::DOUBLE * ln(l_extendedprice) + 0.04::DOUBLE * abs(l_quantity - 25) + 0.01::DOUBLE * l_quantity
         + (CASE WHEN p_size > 25 THEN 6.0 ELSE 1.0 END)::DOUBLE * l_discount
         + (CASE WHEN l_returnflag = 'R' THEN 0.3 ELSE 0.0 END)::DOUBLE AS y,
         l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
         l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CUSTOMERS = f"""
areas AS (
  SELECT {code('c_custkey')} AS zip_text, min(c_custkey) AS c_custkey, min(c_nationkey) AS c_nationkey, avg(c_acctbal) AS c_acctbal
  FROM customer GROUP BY ALL)"""

LISTINGS_RAW = f"""
listings_raw AS (
  SELECT o_orderkey AS listing_id,
    CASE WHEN o_orderkey % 53 <> 0 THEN {PRICE} END AS price,
    CASE WHEN o_orderkey % 41 <> 0 THEN o_orderpriority END AS room_type,
    CAST(1 + o_orderkey % 30 AS DOUBLE) AS minimum_nights,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_custkey * 31 + o_orderkey) % 250 AS DOUBLE) END AS number_of_reviews,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_custkey * 31 + o_orderkey) % 250 AS DOUBLE) / (6 + o_custkey % 13) END AS reviews_per_month,
    CAST(1 + o_custkey % 20 AS DOUBLE) AS calculated_host_listings_count,
    CAST(dayofyear(o_orderdate) AS DOUBLE) AS availability_365,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS number_of_reviews_ltm,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1 + o_orderkey % 5 AS DOUBLE) END AS bedrooms,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(1 + o_orderkey % 6 AS DOUBLE) END AS beds,
    CAST(1 + o_orderkey % 4 AS DOUBLE) * 0.5 AS bathrooms,
    CAST(o_custkey % 100 AS DOUBLE) / 100 + 34 AS LATITUDE,
    CAST(o_orderkey % 90 AS DOUBLE) / 100 - 118 AS LONGITUDE,
    CASE WHEN o_orderkey % 23 = 5 THEN 'N/A' WHEN o_orderkey % 97 = 4 THEN '9990'
         WHEN o_orderkey % 10 = 3 THEN {code('o_custkey + 45000')} ELSE {code('o_custkey')} END AS zip_text,
    CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 17 <> 0 THEN CAST(1 + o_orderkey % 8 AS DOUBLE) END AS accommodates,
    CASE WHEN o_orderkey % 2 = 0 THEN 'June' ELSE 'September' END AS month
  FROM orders)"""

LISTINGS_TYPED = f"""
listings_typed AS (
  SELECT * EXCLUDE (zip_text), {zipc('zip_text')} AS ZIP_CODE FROM listings_raw)"""


def listings_clean(lo=LO, hi=HI, edition="v2") -> str:
    fill = "" if edition == "v1" else (
        ", coalesce(number_of_reviews, 0.0) AS number_of_reviews"
        ", coalesce(reviews_per_month, 0.0) AS reviews_per_month"
        ", coalesce(number_of_reviews_ltm, 0.0) AS number_of_reviews_ltm")
    required = "" if edition == "external" else " AND room_type IS NOT NULL AND month IS NOT NULL"
    excl = "" if edition == "v1" else " EXCLUDE (number_of_reviews, reviews_per_month, number_of_reviews_ltm)"
    return f"""
listings AS (
  SELECT *{excl}{fill}, ln(price) AS log_price FROM listings_typed
  WHERE price IS NOT NULL AND ZIP_CODE IS NOT NULL{required}
    AND price BETWEEN {lo} AND {hi})"""


def _ratio(pop: str, digits: str, prefix: str) -> str:
    return f"CASE WHEN {pop} = 0 THEN '#DIV/0!' ELSE '{prefix}' || CAST({digits} AS VARCHAR) END"


_POP = "floor(greatest(c_acctbal, 0.0))"

AREA_RAW = CUSTOMERS + "," + f"""
area_raw AS (
  SELECT zip_text,
    CAST(CAST({_POP} AS BIGINT) AS VARCHAR) AS Population,
    CAST(c_custkey % 23 AS VARCHAR) AS Count_Part_1_Crime,
    CAST(c_custkey % 7 AS VARCHAR) AS Count_Public_Safety,
    CAST(c_custkey % 5 AS VARCHAR) AS Count_Fire_Stations,
    CAST(c_custkey % 5 AS VARCHAR) AS Count_Police_Stations,
    CAST(c_custkey % 3 AS VARCHAR) AS Count_Corrective_Facility,
    CAST((c_custkey * 7) % 11 AS VARCHAR) AS Count_Education_Facility,
    {_ratio(_POP, "lpad(CAST((c_custkey * 13) % 1000 AS VARCHAR), 4, '0')", '0.')} AS Crime_Per_Capita,
    {_ratio(_POP, '(c_custkey * 3) % 97', '0.00')} AS Education_Per_Capita,
    {_ratio(_POP, 'c_nationkey', '0.0')} AS Public_Safety_Per_Capita,
    CAST(40 + (c_custkey * 17) % 400 AS VARCHAR) AS Median_Price_June,
    CAST(1 + c_custkey % 4 AS VARCHAR) AS median_household_size
  FROM areas)"""

AREA_TYPED = f"""
area_typed AS (
  SELECT ZIP_CODE, {num('Population')} AS Population,
    {num('Count_Part_1_Crime')} AS Count_Part_1_Crime,
    {num('Count_Public_Safety')} AS Count_Public_Safety,
    {num('Count_Fire_Stations')} AS Count_Fire_Stations,
    {num('Count_Police_Stations')} AS Count_Police_Stations,
    {num('Count_Corrective_Facility')} AS Count_Corrective_Facility,
    {num('Count_Education_Facility')} AS Count_Education_Facility,
    {num('Crime_Per_Capita')} AS Crime_Per_Capita,
    {num('Education_Per_Capita')} AS Education_Per_Capita,
    {num('Public_Safety_Per_Capita')} AS Public_Safety_Per_Capita,
    {num('median_household_size')} AS median_household_size
  FROM (SELECT *, {zipc('zip_text')} AS ZIP_CODE FROM area_raw) WHERE ZIP_CODE IS NOT NULL)"""

# v2 area features: keep list, amenities (3 parts), crime and education indices
AREA_V2 = f"""
area AS (
  SELECT ZIP_CODE, Population, Count_Public_Safety, Count_Fire_Stations, Count_Police_Stations,
    Count_Corrective_Facility, Count_Education_Facility, Crime_Per_Capita, Education_Per_Capita,
    Public_Safety_Per_Capita,
    ({z('Count_Fire_Stations')} + {z('Count_Police_Stations')} + {z('Count_Education_Facility')}) / 3.0 AS amenities_index,
    {z('Crime_Per_Capita')} AS crime_index,
    {z('Education_Per_Capita')} AS education_index
  FROM area_typed)"""

INCIDENTS_RAW = f"""
incidents_raw AS (
  SELECT CASE WHEN event_id % 29 = 7 THEN 'unknown' ELSE {code('user_id')} END AS ZIP_CODE,
    CASE WHEN event_id % 37 <> 0 THEN event_type END AS "Crm Cd Desc",
    CAST(1 + event_id % 2 AS VARCHAR) AS "Part 1-2"
  FROM events)"""

INCIDENTS_TYPED = f"""
incidents AS (
  SELECT {zipc('ZIP_CODE')} AS ZIP_CODE,
    {flag('"Crm Cd Desc"', FIXTURE_VIOLENT)} AS violent_flag,
    {flag('"Crm Cd Desc"', FIXTURE_PROPERTY)} AS property_flag,
    CAST(coalesce({num('"Part 1-2"')} = 1.0, false) AS INTEGER) AS part1_flag
  FROM incidents_raw)"""

ROLLUP = """
rollup AS (
  SELECT ZIP_CODE, count(*) AS crime_events,
    CAST(sum(violent_flag) AS BIGINT) AS violent_crime_events,
    CAST(sum(property_flag) AS BIGINT) AS property_crime_events,
    CAST(sum(part1_flag) AS BIGINT) AS part1_events
  FROM incidents WHERE ZIP_CODE IS NOT NULL GROUP BY ZIP_CODE)"""

ZIP_ALL_V2 = f"""
zip_joined AS (
  SELECT a.*, r.crime_events, r.violent_crime_events, r.property_crime_events, r.part1_events,
    {pc('r.crime_events', 'a.Population')} AS crime_events_per_capita,
    {pc('r.violent_crime_events', 'a.Population')} AS violent_crime_per_capita,
    {pc('r.property_crime_events', 'a.Population')} AS property_crime_per_capita
  FROM area a LEFT JOIN rollup r USING (ZIP_CODE))"""


def fill_all(cols, src: str, name: str, keep=("ZIP_CODE",)) -> str:
    parts = list(keep) + [f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in cols]
    return f"\n{name} AS (SELECT {', '.join(parts)} FROM {src})"


ZIP_ALL_V2_COLS = [
    "Population", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
    "Count_Corrective_Facility", "Count_Education_Facility", "Crime_Per_Capita", "Education_Per_Capita",
    "Public_Safety_Per_Capita", "amenities_index", "crime_index", "education_index",
    "crime_events", "violent_crime_events", "property_crime_events", "part1_events",
    "crime_events_per_capita", "violent_crime_per_capita", "property_crime_per_capita",
]


def with_(*ctes) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def v2_model_ctes(lo=LO, hi=HI):
    """Everything up to the v2 merged frame ``merged`` (core-variable drop applied)."""
    merged = """
merged AS (
  SELECT l.*, z.* EXCLUDE (ZIP_CODE) FROM listings l LEFT JOIN zip_all z USING (ZIP_CODE)
  WHERE z.amenities_index IS NOT NULL AND z.crime_events_per_capita IS NOT NULL
    AND z.Education_Per_Capita IS NOT NULL AND z.Public_Safety_Per_Capita IS NOT NULL)"""
    return [LISTINGS_RAW, LISTINGS_TYPED, listings_clean(lo, hi), AREA_RAW, AREA_TYPED, AREA_V2,
            INCIDENTS_RAW, INCIDENTS_TYPED, ROLLUP, ZIP_ALL_V2,
            fill_all(ZIP_ALL_V2_COLS, "zip_joined", "zip_all"), merged]


def sel(cols, src: str, ints=(), d: int = 6, extra: str = "") -> str:
    """SELECT with doubles rounded (integer/text columns listed in ``ints``)."""
    parts = [c if c in ints else f"round({c}, {d}) AS {c}" for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}{extra}"


def _lm(j: int) -> str:
    return (f"abs(c_acctbal) / 1000 * CAST('{1 + j / 10!r}' AS DOUBLE) + ((c_custkey * {j + 2}) % 13) / 10 "
            f"+ c_nationkey * {j % 3}")


AREA_TARGET_RAW = CUSTOMERS + "," + f"""
area_target_raw AS (
  SELECT zip_text,
    CASE WHEN c_custkey % 29 = 0 THEN '0' WHEN c_custkey % 31 = 0 THEN '#N/A'
         ELSE CAST(CAST(floor(60 + abs(c_acctbal) / 20 + (c_custkey * 17) % 150 + 40 * abs((c_custkey * 7) % 11 - 5)) AS BIGINT) AS VARCHAR) END
      AS Median_Price_June,
    CAST(CAST({_POP} AS BIGINT) AS VARCHAR) AS Population,
    CAST(c_custkey % 23 AS VARCHAR) AS Part_1_Crime_Count,
    {_ratio(_POP, "lpad(CAST((c_custkey * 13) % 1000 AS VARCHAR), 4, '0')", '0.')} AS Part_1_Crime_Per_Capita,
    CAST((c_custkey * 7) % 11 AS VARCHAR) AS Count_Educational_Facility,
    CAST(c_custkey % 7 AS VARCHAR) AS Count_Public_Safety,
    CAST(c_custkey % 5 AS VARCHAR) AS Count_Fire_Stations,
    CAST(c_custkey % 5 AS VARCHAR) AS Count_Police_Stations,
    CAST(c_custkey % 3 AS VARCHAR) AS Count_Corrective_Facility,
    {', '.join(f'{_lm(j)} AS "{landmark_name(j)}"' for j in range(1, N_LANDMARKS + 1))},
    abs(c_acctbal) / 900 + (c_custkey % 7) / 10 AS "Landmark_01_Median_Distance_Sept_(KM)"
  FROM areas)"""

LANDMARKS = [landmark_name(j) for j in range(1, N_LANDMARKS + 1)]

AREA_TARGET_TYPED = f"""
area_target_typed AS (
  SELECT ZIP_CODE, {num('Median_Price_June')} AS Median_Price_June, {num('Population')} AS Population,
    {num('Part_1_Crime_Count')} AS Part_1_Crime_Count,
    {num('Part_1_Crime_Per_Capita')} AS Part_1_Crime_Per_Capita,
    {num('Count_Educational_Facility')} AS Count_Educational_Facility,
    {num('Count_Public_Safety')} AS Count_Public_Safety,
    {num('Count_Fire_Stations')} AS Count_Fire_Stations,
    {num('Count_Police_Stations')} AS Count_Police_Stations,
    {num('Count_Corrective_Facility')} AS Count_Corrective_Facility,
    {', '.join(f'"{c}"' for c in LANDMARKS)}, "Landmark_01_Median_Distance_Sept_(KM)"
  FROM (SELECT *, {zipc('zip_text')} AS ZIP_CODE FROM area_target_raw) WHERE ZIP_CODE IS NOT NULL)"""

AREA_V1 = f"""
area AS (
  SELECT ZIP_CODE, Count_Part_1_Crime, Count_Public_Safety, Count_Fire_Stations, Count_Police_Stations,
    Count_Corrective_Facility, Count_Education_Facility, Population, Crime_Per_Capita, Education_Per_Capita,
    Public_Safety_Per_Capita,
    ({z('Count_Fire_Stations')} + {z('Count_Police_Stations')} + {z('Count_Education_Facility')}
      + {z('Count_Public_Safety')}) / 4.0 AS amenities_index,
    {z('Crime_Per_Capita')} AS crime_index,
    {z('Education_Per_Capita')} AS education_index
  FROM area_typed)"""

AREA_V3 = f"""
area AS (
  SELECT ZIP_CODE, Population, Count_Public_Safety, Count_Fire_Stations, Count_Police_Stations,
    Count_Corrective_Facility, Count_Education_Facility, Crime_Per_Capita, Education_Per_Capita,
    Public_Safety_Per_Capita,
    Education_Per_Capita * 10000.0 AS Education_Per_10k, Public_Safety_Per_Capita * 10000.0 AS Public_Safety_Per_10k,
    Crime_Per_Capita * 10000.0 AS Crime_Per_10k,
    {z('Education_Per_Capita')} AS Education_z, {z('Public_Safety_Per_Capita')} AS Public_Safety_z,
    {z('Crime_Per_Capita')} AS Crime_z,
    ({z('Count_Fire_Stations')} + {z('Count_Police_Stations')} + {z('Count_Education_Facility')}) / 3.0 AS amenities_index
  FROM area_typed)"""

AREA_EXTERNAL = f"""
area_ext0 AS (
  SELECT ZIP_CODE, Population, Part_1_Crime_Count AS Count_Part_1_Crime, Part_1_Crime_Per_Capita AS Crime_Per_Capita,
    Count_Public_Safety, Count_Fire_Stations, Count_Police_Stations, Count_Corrective_Facility,
    Count_Educational_Facility AS Count_Education_Facility
  FROM area_target_typed),
area_ext1 AS (
  SELECT *, {log1pn('Population')} AS log_population, Crime_Per_Capita * 10000.0 AS crime_per_10k_cleaned,
    {pc('Count_Education_Facility')} * 10000.0 AS education_per_10k,
    {pc('Count_Public_Safety')} * 10000.0 AS public_safety_per_10k
  FROM area_ext0),
area AS (
  SELECT *, {z('Crime_Per_Capita')} AS crime_z_cleaned, {z('education_per_10k')} AS education_z,
    {z('public_safety_per_10k')} AS public_safety_z,
    ({z('Count_Public_Safety')} + {z('Count_Fire_Stations')} + {z('Count_Police_Stations')}
      + {z('Count_Education_Facility')}) / 4.0 AS external_amenities_index
  FROM area_ext1)"""

ZIP_JOINED_V1 = f"""
zip_all AS (
  SELECT a.*, r.crime_events, r.violent_crime_events, r.property_crime_events, r.part1_events,
    {pc('r.crime_events', 'a.Population')} AS crime_events_per_capita,
    {pc('r.violent_crime_events', 'a.Population')} AS violent_crime_per_capita,
    {pc('r.property_crime_events', 'a.Population')} AS property_crime_per_capita,
    {pc('r.part1_events', 'a.Population')} AS part1_events_per_capita
  FROM area a LEFT JOIN rollup r USING (ZIP_CODE))"""


def simple_fit_ctes(src="listings", y="log_price", x="minimum_nights"):
    return [f"""
s AS (SELECT count(*) AS n, avg({x}) AS mx, avg({y}) AS my FROM {src})""", f"""
c AS (SELECT sum(({x} - mx) * ({x} - mx)) AS sxx, sum(({x} - mx) * ({y} - my)) AS sxy FROM {src}, s)""", """
b AS (SELECT n, mx, my, sxx, sxy / sxx AS b1, my - sxy / sxx * mx AS b0 FROM s, c)"""]
