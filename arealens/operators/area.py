"""Listing cleaning, area features, the incident rollup and the two area joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.tables import harmonise, rename_aliases, require_columns
from . import features as FT
from .quantiles import median_fill
from .selection import drop_leakage, existing, numeric_columns

# ---------------------------------------------------------------------------
# Column lists and aliases as the reference defines them.
# ---------------------------------------------------------------------------
LISTING_ALIASES = {"latitude": "LATITUDE", "longitude": "LONGITUDE", "zip_code": "ZIP_CODE"}
AREA_ALIASES = {"ZIP_Code": "ZIP_CODE"}
AREA_VARIANTS = {
    "Part_1_Crime_Count": "Count_Part_1_Crime",
    "Part_1_Crime_Per_Capita": "Crime_Per_Capita",
    "Count_Educational_Facility": "Count_Education_Facility",
}
_FULL = ["price", "room_type", "minimum_nights", "number_of_reviews", "reviews_per_month",
         "calculated_host_listings_count", "availability_365", "number_of_reviews_ltm", "ZIP_CODE", "month"]
LISTING_REQUIRED = {"v1": _FULL, "v2": _FULL, "v3": ["price", "room_type", "ZIP_CODE", "month"],
                    "external": ["price", "ZIP_CODE"]}
LISTING_NON_NULL = {"v1": ["price", "ZIP_CODE", "room_type", "month"], "v2": ["price", "ZIP_CODE", "room_type", "month"],
                    "v3": ["price", "ZIP_CODE", "room_type", "month"], "external": ["price", "ZIP_CODE"]}
LISTING_NUMERIC = [
    "price", "minimum_nights", "number_of_reviews", "reviews_per_month",
    "calculated_host_listings_count", "availability_365", "number_of_reviews_ltm",
    "accommodates", "bedrooms", "beds", "bathrooms", "LATITUDE", "LONGITUDE",
]
REVIEW_ZERO_FILL = ["reviews_per_month", "number_of_reviews", "number_of_reviews_ltm"]
SIZE_COLUMNS = ["accommodates", "bedrooms", "beds", "bathrooms"]
LOG1P_FEATURES = [
    ("minimum_nights", "log_minimum_nights"),
    ("number_of_reviews", "log_number_of_reviews"),
    ("reviews_per_month", "log_reviews_per_month"),
    ("availability_365", "log_availability_365"),
    ("number_of_reviews_ltm", "log_number_of_reviews_ltm"),
    ("calculated_host_listings_count", "log_host_listings_count"),
]
AREA_KEEP_V1 = [
    "Count_Part_1_Crime", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
    "Count_Corrective_Facility", "Count_Education_Facility", "Population", "Crime_Per_Capita",
    "Education_Per_Capita", "Public_Safety_Per_Capita",
]
AREA_KEEP_V2 = [
    "Population", "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
    "Count_Corrective_Facility", "Count_Education_Facility", "Crime_Per_Capita",
    "Education_Per_Capita", "Public_Safety_Per_Capita",
]
AREA_KEEP_EXTERNAL = [
    "Population", "Count_Part_1_Crime", "Part_1_Crime_Count", "Crime_Per_Capita",
    "Part_1_Crime_Per_Capita", "Count_Public_Safety", "Count_Fire_Stations",
    "Count_Police_Stations", "Count_Corrective_Facility", "Count_Education_Facility",
    "Count_Educational_Facility", "Education_Per_Capita", "Public_Safety_Per_Capita",
]
AMENITY_PARTS = {
    "v1": ["Count_Fire_Stations", "Count_Police_Stations", "Count_Education_Facility", "Count_Public_Safety"],
    "v2": ["Count_Fire_Stations", "Count_Police_Stations", "Count_Education_Facility"],
    "v3": ["Count_Fire_Stations", "Count_Police_Stations", "Count_Education_Facility"],
    "external": ["Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations",
                 "Count_Education_Facility"],
}
INCIDENT_COLUMNS = ["ZIP_CODE", "Crm Cd Desc", "Part 1-2"]
CORE_AREA_V2 = ["amenities_index", "crime_events_per_capita", "Education_Per_Capita",
                "Public_Safety_Per_Capita"]


def _dtype(df: DataFrame, c: str):
    return df.schema[c].dataType


def _typed(df: DataFrame, c: str):
    return S.safe_numeric(F.col(f"`{c}`"), _dtype(df, c))


# ---------------------------------------------------------------------------
# Listings
# ---------------------------------------------------------------------------
def union_snapshots(june: DataFrame, sept: DataFrame, tag: bool = True) -> DataFrame:
    """Union by name; a column missing from one snapshot is NULL there."""
    if tag:
        june = june.withColumn("month", F.lit("June"))
        sept = sept.withColumn("month", F.lit("September"))
    return june.unionByName(sept, allowMissingColumns=True)


def type_listings(raw: DataFrame, edition: str = "v2") -> DataFrame:
    """Alias rename, the edition's required-column check, coercing casts, postal code."""
    df = rename_aliases(raw, LISTING_ALIASES)
    require_columns(df, LISTING_REQUIRED[edition], "listing")
    casts = {c: _typed(df, c) for c in existing(df, LISTING_NUMERIC)}
    casts["ZIP_CODE"] = S.standardize_zip(F.col("ZIP_CODE"), _dtype(df, "ZIP_CODE"))
    return df.withColumns(casts)


def listing_filters(edition: str = "v2", lo=S.MIN_PRICE, hi=S.MAX_PRICE):
    """(no NULL in the edition's required columns, price within the trim bounds)."""
    required = F.lit(True)
    for c in LISTING_NON_NULL[edition]:
        required = required & F.col(c).isNotNull()
    return required, S.price_in_range(F.col("price"), lo, hi)


def clean_listings(typed: DataFrame, edition: str = "v2", lo=S.MIN_PRICE, hi=S.MAX_PRICE) -> DataFrame:
    required, trim = listing_filters(edition, lo, hi)
    df = typed.where(required & trim)
    if edition != "v1":  # v1 zero-fills after the area join
        df = df.fillna(0.0, subset=existing(df, REVIEW_ZERO_FILL))
    df = df.withColumn("log_price", S.log_target("price"))
    if edition == "v3":
        df = df.withColumns({new: S.log1p_clipped_zero_fill(src)
                             for src, new in LOG1P_FEATURES if src in df.columns})
        size = existing(df, SIZE_COLUMNS)
        if size:
            df = median_fill(df, size)
    if edition == "external":
        df = df.select(*existing(df, ["listing_id", "price", "log_price", "ZIP_CODE", "month",
                                      "LATITUDE", "LONGITUDE"]))
    return df


def listing_counters(typed: DataFrame, lo=S.MIN_PRICE, hi=S.MAX_PRICE) -> DataFrame:
    """Stage counters from one aggregate over the typed union."""
    required, trim = listing_filters("v2", lo, hi)
    kept = required & trim
    return typed.agg(
        F.count(F.lit(1)).alias("airbnb_raw_rows"),
        F.count_if(required).alias("airbnb_after_required_filters"),
        F.count_if(kept).alias("airbnb_after_price_trim"),
        F.count_distinct(F.when(kept, F.col("ZIP_CODE"))).alias("airbnb_unique_zips"),
    )


# ---------------------------------------------------------------------------
# Area features
# ---------------------------------------------------------------------------
def type_area(raw: DataFrame, edition: str = "v2") -> DataFrame:
    df = rename_aliases(raw, AREA_ALIASES)
    if "ZIP_CODE" not in df.columns:
        raise ValueError("area file must contain ZIP_Code or ZIP_CODE")
    df = df.withColumn("ZIP_CODE", S.standardize_zip(F.col("ZIP_CODE"), _dtype(df, "ZIP_CODE")))
    df = df.where(F.col("ZIP_CODE").isNotNull())
    df = df.withColumns({c: _typed(df, c) for c in df.columns if c != "ZIP_CODE"})
    return drop_leakage(df, "Median_", case_insensitive=(edition == "v1"))


def area_features(raw: DataFrame, edition: str = "v2") -> DataFrame:
    df = type_area(raw, edition)
    if edition == "v1":
        df = df.select("ZIP_CODE", *existing(df, AREA_KEEP_V1))
    elif edition in ("v2", "v3"):
        df = df.select("ZIP_CODE", *existing(df, AREA_KEEP_V2))
    else:
        df = harmonise(df.select("ZIP_CODE", *existing(df, AREA_KEEP_EXTERNAL)), AREA_VARIANTS)

    parts = existing(df, AMENITY_PARTS[edition])
    zsrc = {f"__z_{c}": c for c in parts}
    new = {}
    if edition in ("v1", "v2"):
        crime = FT.fallback_rate(df, "Crime_Per_Capita", "Count_Part_1_Crime") if edition == "v1" \
            else (F.col("Crime_Per_Capita") if "Crime_Per_Capita" in df.columns else None)
        edu = FT.fallback_rate(df, "Education_Per_Capita", "Count_Education_Facility") if edition == "v1" \
            else (F.col("Education_Per_Capita") if "Education_Per_Capita" in df.columns else None)
        if crime is not None:
            new["__crime"] = crime
        if edu is not None:
            new["__edu"] = edu
    elif edition == "v3":
        for c, stem in [("Education_Per_Capita", "Education"), ("Public_Safety_Per_Capita", "Public_Safety"),
                        ("Crime_Per_Capita", "Crime")]:
            if c in df.columns:
                new[f"{stem}_Per_10k"] = S.per_10k(F.col(c))
    else:
        if "Population" in df.columns:
            new["log_population"] = S.log1p_clipped("Population")
        if "Crime_Per_Capita" in df.columns:
            new["crime_per_10k_cleaned"] = S.per_10k(F.col("Crime_Per_Capita"))
        for rate, cnt, stem in [("Education_Per_Capita", "Count_Education_Facility", "education"),
                                ("Public_Safety_Per_Capita", "Count_Public_Safety", "public_safety")]:
            if rate in df.columns:
                new[f"{stem}_per_10k"] = S.per_10k(F.col(rate))
            elif cnt in df.columns and "Population" in df.columns:
                new[f"{stem}_per_10k"] = S.per_10k(S.per_capita(cnt, "Population"))
    df = df.withColumns(new) if new else df

    zspec = dict(zsrc)
    if edition in ("v1", "v2"):
        if "__crime" in df.columns:
            zspec["crime_index"] = "__crime"
        if "__edu" in df.columns:
            zspec["education_index"] = "__edu"
    elif edition == "v3":
        for c, z in [("Education_Per_Capita", "Education_z"), ("Public_Safety_Per_Capita", "Public_Safety_z"),
                     ("Crime_Per_Capita", "Crime_z")]:
            if c in df.columns:
                zspec[z] = c
    else:
        if "Crime_Per_Capita" in df.columns:
            zspec["crime_z_cleaned"] = "Crime_Per_Capita"
        if "Education_Per_Capita" in df.columns:
            zspec["education_z"] = "Education_Per_Capita"
        elif "education_per_10k" in df.columns:
            zspec["education_z"] = "education_per_10k"
        if "Public_Safety_Per_Capita" in df.columns:
            zspec["public_safety_z"] = "Public_Safety_Per_Capita"
        elif "public_safety_per_10k" in df.columns:
            zspec["public_safety_z"] = "public_safety_per_10k"
    df = FT.with_zscores(df, zspec)
    if parts:
        name = "external_amenities_index" if edition == "external" else "amenities_index"
        df = df.withColumn(name, FT.composite_strict([F.col(z) for z in zsrc]))
    return df.drop(*zsrc.keys(), "__crime", "__edu")


# ---------------------------------------------------------------------------
# Incidents
# ---------------------------------------------------------------------------
def typed_incidents(raw: DataFrame, violent=S.VIOLENT_PATTERN, prop=S.PROPERTY_PATTERN) -> DataFrame:
    """Postal code, the two description flags and the part-1 flag (rows kept)."""
    d = F.col("`Crm Cd Desc`")
    return raw.select(
        S.standardize_zip(F.col("ZIP_CODE"), _dtype(raw, "ZIP_CODE")).alias("ZIP_CODE"),
        S.pattern_flag(d, violent).alias("violent_flag"),
        S.pattern_flag(d, prop).alias("property_flag"),
        S.equality_flag(F.col("`Part 1-2`"), 1).alias("part1_flag"),
    )


def incident_rollup(raw: DataFrame, violent=S.VIOLENT_PATTERN, prop=S.PROPERTY_PATTERN) -> DataFrame:
    """Per-area totals. Hash aggregate with map-side partial sums: a hot area
    collapses to one row per input partition before the shuffle."""
    t = typed_incidents(raw, violent, prop).where(F.col("ZIP_CODE").isNotNull())
    return t.groupBy("ZIP_CODE").agg(
        F.count(F.lit(1)).alias("crime_events"),
        F.sum("violent_flag").alias("violent_crime_events"),
        F.sum("property_flag").alias("property_crime_events"),
        F.sum("part1_flag").alias("part1_events"),
    )


def incident_counters(raw: DataFrame, violent=S.VIOLENT_PATTERN, prop=S.PROPERTY_PATTERN) -> DataFrame:
    """Counters of the rows read and, from the rollup itself, of what it holds:
    its events must be the rows with a valid code."""
    read = typed_incidents(raw, violent, prop).agg(
        F.count(F.lit(1)).alias("crime_total_rows_read"), F.count("ZIP_CODE").alias("crime_rows_with_valid_zip"))
    held = incident_rollup(raw, violent, prop).agg(
        F.coalesce(F.sum("crime_events"), F.lit(0)).alias("crime_aggregated_total_events"),
        F.coalesce(F.sum("part1_events"), F.lit(0)).alias("crime_total_part1_rows"),
        F.count(F.lit(1)).alias("crime_unique_zip_after_aggregation"))
    share = F.try_divide(F.col("crime_aggregated_total_events").cast("double"), F.col("crime_total_rows_read").cast("double"))
    both = read.unionByName(held, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn(
        "share_crime_rows_retained_after_zip_cleaning", share)


def build_counters(typed: DataFrame, incidents: DataFrame, area: DataFrame, lo=S.MIN_PRICE, hi=S.MAX_PRICE,
                   violent=S.VIOLENT_PATTERN, prop=S.PROPERTY_PATTERN, core=CORE_AREA_V2) -> list:
    """Every counter of the build as (section, metric, value) rows, from one action.

    Rows are counted where they pass (``observe``): listings as typed, incidents as read.  Listings, area and
    incidents then are one row for each postal code each; their outer join gives the counters of the merge,
    since a listing finds its area by the code alone.  A step that is repeated after a lost executor may be
    counted twice by ``observe``; the counters from the join are not affected."""
    required, trim = listing_filters("v2", lo, hi)
    seen, read = Observation("listings"), Observation("incidents")
    typed = typed.observe(seen, F.count(F.lit(1)).alias("airbnb_raw_rows"),
                          F.count_if(required).alias("airbnb_after_required_filters"),
                          F.count_if(required & trim).alias("airbnb_after_price_trim"))
    zip_code = S.standardize_zip(F.col("ZIP_CODE"), _dtype(incidents, "ZIP_CODE"))
    incidents = incidents.observe(read, F.count(F.lit(1)).alias("rows"), F.count(zip_code).alias("valid"))
    kept = typed.where(required & trim).groupBy("ZIP_CODE").agg(F.count(F.lit(1)).alias("listings"))
    complete = F.lit(True)
    for c in existing(area, core):
        complete = complete & F.col(c).isNotNull()
    areas = area.groupBy("ZIP_CODE").agg(F.count(F.lit(1)).alias("areas"), F.bool_or(complete).alias("complete"))
    rollup = incident_rollup(incidents, violent, prop).select("ZIP_CODE", "crime_events", "part1_events")
    codes = kept.join(areas, "ZIP_CODE", "full").join(rollup, "ZIP_CODE", "full")
    has = lambda c: F.col(c).isNotNull()
    total = lambda c, cond=None: F.coalesce(F.sum(c if cond is None else F.when(cond, F.col(c))), F.lit(0))
    r = codes.agg(
        F.count("listings").alias("airbnb_unique_zips"), total("areas").alias("area_rows"), F.count("areas").alias("area_unique_zips"),
        F.count_if(has("areas") & has("crime_events")).alias("area_zips_with_incidents"),
        total("crime_events").alias("crime_aggregated_total_events"), total("part1_events").alias("crime_total_part1_rows"),
        F.count("crime_events").alias("crime_unique_zip_after_aggregation"),
        total("listings").alias("listings_before_merge"), total("listings", has("areas")).alias("listings_with_area"),
        total("listings", ~has("areas")).alias("listings_without_area"),
        total("listings", has("areas") & F.col("complete")).alias("listings_after_core_filter")).first()
    rows = [("listings", k, v) for k, v in seen.get.items()] + [("listings", "airbnb_unique_zips", r["airbnb_unique_zips"])]
    n = read.get
    rows += [("incidents", "crime_total_rows_read", n["rows"]), ("incidents", "crime_rows_with_valid_zip", n["valid"])]
    rows += [("incidents", k, r[k]) for k in ("crime_aggregated_total_events", "crime_total_part1_rows", "crime_unique_zip_after_aggregation")]
    share = r["crime_aggregated_total_events"] / n["rows"] if n["rows"] else None
    rows.append(("incidents", "share_crime_rows_retained_after_zip_cleaning", share))
    rows += [("dimension and merge", k, r[k]) for k in ("area_rows", "area_unique_zips", "area_zips_with_incidents", "listings_before_merge",
                                                       "listings_with_area", "listings_without_area", "listings_after_core_filter")]
    return [(section, metric, None if v is None else float(v)) for section, metric, v in rows]


RATE_SPECS = {
    "v1": [("crime_events", "crime_events_per_capita"), ("violent_crime_events", "violent_crime_per_capita"),
           ("property_crime_events", "property_crime_per_capita"), ("part1_events", "part1_events_per_capita")],
    "v2": [("crime_events", "crime_events_per_capita"), ("violent_crime_events", "violent_crime_per_capita"),
           ("property_crime_events", "property_crime_per_capita")],
    "v3": [("crime_events", "crime_events_per_capita"), ("violent_crime_events", "violent_crime_per_capita"),
           ("property_crime_events", "property_crime_per_capita")],
    "external": [],
}


def attach_incidents(area: DataFrame, rollup: DataFrame, edition: str = "v2") -> DataFrame:
    """Area LEFT JOIN rollup (1:1 on the postal code), then incident rates."""
    z = area.join(rollup, "ZIP_CODE", "left")
    if "Population" not in z.columns:
        return z
    new = {}
    for cnt, rate in RATE_SPECS[edition]:
        new[rate] = S.per_capita(cnt, "Population")
    if edition == "v3":
        new["crime_events_per_10k"] = S.per_10k(new["crime_events_per_capita"])
        new["violent_crime_per_10k"] = S.per_10k(new["violent_crime_per_capita"])
        new["property_crime_per_10k"] = S.per_10k(new["property_crime_per_capita"])
    if edition == "external":
        for cnt, stem in [("crime_events", "crime_events"), ("violent_crime_events", "violent_crime"),
                          ("property_crime_events", "property_crime")]:
            new[f"{stem}_per_10k"] = S.per_10k(S.per_capita(cnt, "Population"))
    z = z.withColumns(new)
    if edition == "v3":
        z = FT.with_zscores(z, {"crime_events_z": "crime_events_per_capita"})
    if edition == "external":
        z = FT.with_zscores(z, {"crime_events_z": "crime_events_per_10k",
                                "violent_crime_z": "violent_crime_per_10k",
                                "property_crime_z": "property_crime_per_10k"})
    return z


def fill_area(zip_all: DataFrame) -> DataFrame:
    """Median-fill every numeric area column (areas without incidents get the
    median area's values, not zero)."""
    return median_fill(zip_all, numeric_columns(zip_all, exclude=("ZIP_CODE",)))


def attach_area(listings: DataFrame, zip_all: DataFrame) -> DataFrame:
    """Listing LEFT JOIN area (N:1).  Codes that several area rows name keep
    their first row in the order of all columns, so no listing is multiplied."""
    rest = [c for c in zip_all.columns if c != "ZIP_CODE"]
    once = zip_all.groupBy("ZIP_CODE").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_r")) \
        .select("ZIP_CODE", "_r.*")
    return listings.join(once, "ZIP_CODE", "left")


def post_join_fill_v1(df: DataFrame, key_cols=("listing_id",)) -> DataFrame:
    """v1 order: drop NULL keys, zero-fill review counts, then listing-weighted
    medians for every other numeric column."""
    df = df.where(F.col("ZIP_CODE").isNotNull())
    df = df.fillna(0.0, subset=existing(df, REVIEW_ZERO_FILL))
    skip = {"room_type", "month", "log_price", "price", "ZIP_CODE", *key_cols}
    return median_fill(df, [c for c in numeric_columns(df) if c not in skip])


def require_core(df: DataFrame, core=CORE_AREA_V2) -> DataFrame:
    c = existing(df, core)
    return df.dropna(subset=c) if c else df


def area_table(area_raw: DataFrame, incidents: DataFrame, edition: str = "v2",
               violent=S.VIOLENT_PATTERN, prop=S.PROPERTY_PATTERN, fill: bool = True) -> DataFrame:
    """Area features with the incident rates, median-filled except in v1."""
    z = attach_incidents(area_features(area_raw, edition), incident_rollup(incidents, violent, prop), edition)
    return fill_area(z) if (fill and edition != "v1") else z
