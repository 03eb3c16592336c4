"""Map the driver's TPC-H-style tables onto the reference's data model.

* listings      <- orders      (two monthly snapshots, even / odd order keys)
* area features <- customer    (text columns, as read from a CSV export)
* area target   <- customer    (one row per area with landmark distances)
* incidents     <- events      (postal code text, description, part text)
* wide frame    <- lineitem JOIN part

All derivations are deterministic expressions of the source rows, so the work
grows with the tables.  ``oracle_sql`` repeats each one as a DuckDB CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load_table

# Patterns used when the incident descriptions come from ``events.event_type``.
FIXTURE_VIOLENT = "ERROR|PURCHASE"
FIXTURE_PROPERTY = "CLICK|VIEW|PURCHASE"
N_LANDMARKS = 6
# Trim bounds of the fixture prices (about 30 to 1,600), so that rows drop on both sides.
TRIM_LOW, TRIM_HIGH = 60, 900


def _s(c):
    return c.cast("string")


def _dbl(c):
    return c.cast("double")


def postal_code(key):
    """Every key has a five-digit code, at any number of keys."""
    return F.lit(10000) + F.pmod(key, F.lit(90000))


def listing_price(key, cust, total, priority):
    """Price with a stated dependence on the listing's size and category, the
    area's facilities, crime count and distance from the middle latitude (not
    linear: prices rise to both sides), and the table's own total as noise."""
    size = F.pow(1.0 + key % 8, F.lit(0.7))
    category = F.when(priority.startswith("1"), 1.6).when(priority.startswith("2"), 1.25).when(
        priority.startswith("3"), 1.0).otherwise(0.75)
    area = F.exp(0.06 * (cust % 5) - 0.015 * (cust % 23) + 0.9 * (F.abs(cust % 100 - 50) / 50 - 0.5))
    return 55.0 * size * category * area * F.pow(total / 100, F.lit(0.12))


def listing_snapshots(spark: SparkSession, sf_dir: str):
    """Two snapshots (June: even keys, September: odd keys).

    The September file lacks ``accommodates`` so the union must align by name.
    One listing in 23 has a code that is no number, one in 97 a code out of
    range, and one in ten lies away from its customer's area."""
    o = load_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reviews = F.when(k % 7 != 0, _dbl((c * 31 + k) % 250))
    zip_text = (F.when(k % 23 == 5, F.lit("N/A")).when(k % 97 == 4, F.lit("9990"))
                .when(k % 10 == 3, _s(postal_code(c + 45000))).otherwise(_s(postal_code(c))))
    price = listing_price(k, c, F.col("o_totalprice"), F.col("o_orderpriority"))
    cols = [
        k.alias("listing_id"),
        F.when(k % 53 != 0, price).alias("price"),
        F.when(k % 41 != 0, F.col("o_orderpriority")).alias("room_type"),
        _dbl(1 + k % 30).alias("minimum_nights"),
        reviews.alias("number_of_reviews"),
        (reviews / (6 + c % 13)).alias("reviews_per_month"),
        _dbl(1 + c % 20).alias("calculated_host_listings_count"),
        _dbl(F.dayofyear("o_orderdate")).alias("availability_365"),
        F.when(k % 9 != 0, _dbl(k % 40)).alias("number_of_reviews_ltm"),
        F.when(k % 13 != 0, _dbl(1 + k % 5)).alias("bedrooms"),
        F.when(k % 19 != 0, _dbl(1 + k % 6)).alias("beds"),
        (_dbl(1 + k % 4) * 0.5).alias("bathrooms"),
        (_dbl(c % 100) / 100 + 34).alias("latitude"),
        (_dbl(k % 90) / 100 - 118).alias("longitude"),
        zip_text.alias("ZIP_CODE"),
    ]
    june = o.where(k % 2 == 0).select(
        *cols, F.when(k % 17 != 0, _dbl(1 + k % 8)).alias("accommodates"))
    sept = o.where(k % 2 == 1).select(*cols)
    return june, sept


def _area_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each postal code: the smallest key and nation and the mean
    balance of its customers (a code has several from 90,000 customers on)."""
    cu = load_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    return cu.groupBy(postal_code(F.col("c_custkey")).alias("code")).agg(
        F.min("c_custkey").alias("c_custkey"), F.min("c_nationkey").alias("c_nationkey"), F.avg("c_acctbal").alias("c_acctbal"))


def _pop(cb):
    return F.floor(F.greatest(cb, F.lit(0.0)))


def _ratio_text(pop, digits_expr, prefix):
    return F.when(pop == 0, F.lit("#DIV/0!")).otherwise(F.concat(F.lit(prefix), _s(digits_expr)))


def area_features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area file as text (header ``ZIP_Code``; ratio cells hold ``#DIV/0!``
    where population is 0; two leakage columns, one lower-case)."""
    ck, nk, bal = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    pop = _pop(bal)
    return _area_base(spark, sf_dir).select(
        _s(F.col("code")).alias("ZIP_Code"),
        _s(pop.cast("long")).alias("Population"),
        _s(ck % 23).alias("Count_Part_1_Crime"),
        _s(ck % 7).alias("Count_Public_Safety"),
        _s(ck % 5).alias("Count_Fire_Stations"),
        _s(ck % 5).alias("Count_Police_Stations"),
        _s(ck % 3).alias("Count_Corrective_Facility"),
        _s((ck * 7) % 11).alias("Count_Education_Facility"),
        _ratio_text(pop, F.lpad(_s((ck * 13) % 1000), 4, "0"), "0.").alias("Crime_Per_Capita"),
        _ratio_text(pop, (ck * 3) % 97, "0.00").alias("Education_Per_Capita"),
        _ratio_text(pop, nk, "0.0").alias("Public_Safety_Per_Capita"),
        _s(40 + (ck * 17) % 400).alias("Median_Price_June"),
        _s(1 + ck % 4).alias("median_household_size"),
    )


def area_target_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per area: target, variant column names and landmark distances.  The target rises with the distance
    of the number of educational facilities from 5, to both sides."""
    ck, nk, bal = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    pop = _pop(bal)
    target = (F.when(ck % 29 == 0, F.lit("0"))
              .when(ck % 31 == 0, F.lit("#N/A"))
              .otherwise(_s(F.floor(60 + F.abs(bal) / 20 + (ck * 17) % 150 + 40 * F.abs((ck * 7) % 11 - 5)).cast("long"))))
    cols = [
        _s(F.col("code")).alias("ZIP_Code"),
        target.alias("Median_Price_June"),
        _s(pop.cast("long")).alias("Population"),
        _s(ck % 23).alias("Part_1_Crime_Count"),
        _ratio_text(pop, F.lpad(_s((ck * 13) % 1000), 4, "0"), "0.").alias("Part_1_Crime_Per_Capita"),
        _s((ck * 7) % 11).alias("Count_Educational_Facility"),
        _s(ck % 7).alias("Count_Public_Safety"),
        _s(ck % 5).alias("Count_Fire_Stations"),
        _s(ck % 5).alias("Count_Police_Stations"),
        _s(ck % 3).alias("Count_Corrective_Facility"),
    ]
    for j in range(1, N_LANDMARKS + 1):
        d = F.abs(bal) / 1000 * (1 + j / 10) + ((ck * (j + 2)) % 13) / 10 + nk * (j % 3)
        cols.append(d.alias(landmark_name(j)))
    cols.append((F.abs(bal) / 900 + (ck % 7) / 10).alias("Landmark_01_Median_Distance_Sept_(KM)"))
    return _area_base(spark, sf_dir).select(*cols)


def landmark_name(j: int) -> str:
    return f"Landmark_{j:02d}_Median_Distance_June_(KM)"


def incidents_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_events(load_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]))


def incidents_from_events(ev: DataFrame) -> DataFrame:
    """Batch or streaming: the same derivation applies to both."""
    eid = F.col("event_id")
    return ev.select(
        F.when(eid % 29 == 7, F.lit("unknown")).otherwise(_s(postal_code(F.col("user_id")))).alias("ZIP_CODE"),
        F.when(eid % 37 != 0, F.col("event_type")).alias("Crm Cd Desc"),
        _s(1 + eid % 2).alias("Part 1-2"),
    )


def wide_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem JOIN part, the benchmark-size regression input.

    The target depends on the predictors in a stated way, not linear in the
    quantity and with an interaction, plus the logarithm of the price as noise."""
    li = load_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    pa = load_table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_retailprice"])
    q, size = F.col("l_quantity"), F.col("p_size").cast("double")
    y = (0.1 * F.log("l_extendedprice") + 0.04 * F.abs(q - 25) + 0.01 * q
         + F.when(size > 25, 6.0).otherwise(1.0) * F.col("l_discount")
         + F.when(F.col("l_returnflag") == "R", 0.3).otherwise(0.0))
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", y.alias("y"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        size.alias("p_size"), "p_retailprice", "l_returnflag", "l_linestatus")
