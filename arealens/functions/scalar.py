"""Row-level column functions (all built-in expressions, no UDFs).

Every function takes and returns ``Column`` objects so Catalyst keeps them in
whole-stage codegen and can push filters on their inputs down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Numeric text accepted by the coercing cast: optional sign, digits with an
# optional fraction (or a bare fraction), optional exponent.
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Postal codes are five-digit integers.
ZIP_MIN, ZIP_MAX = 10000, 99999
# Incident description classes (matched against the upper-cased description).
VIOLENT_PATTERN = (
    "ASSAULT|ROBBERY|RAPE|SEX|HOMICIDE|MANSLAUGHTER|KIDNAP|"
    "SHOTS FIRED|SHOOTING|FIREARM|WEAPON|BATTERY|CHILD ABUSE|"
    "INTIMATE PARTNER|CRUELTY"
)
PROPERTY_PATTERN = (
    "BURGLARY|THEFT|STOLEN|VANDALISM|SHOPLIFTING|BIKE|VEHICLE|"
    "AUTO|IDENTITY|EMBEZZLEMENT|FRAUD|ARSON|TRESPASS"
)
# Listing price trim bounds, inclusive.
MIN_PRICE, MAX_PRICE = 10, 5000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_numeric(c, data_type=None) -> Column:
    """Text -> double; anything that is not plain numeric text becomes NULL.

    Numeric inputs pass through (NaN becomes NULL so aggregates skip it, as
    missing values are skipped in the reference)."""
    col = _col(c)
    if data_type is not None and isinstance(data_type, NumericType):
        d = col.cast("double")
        return F.when(~F.isnan(d), d)
    t = F.trim(col.cast("string"))
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))


def standardize_zip(c, data_type=None) -> Column:
    """Five-digit integral postal code as LONG, else NULL."""
    d = safe_numeric(c, data_type)
    ok = d.between(ZIP_MIN, ZIP_MAX) & (d == F.floor(d))
    return F.when(ok, d.cast("long"))


def log_target(c) -> Column:
    return F.log(_col(c))


def log1p_clipped_zero_fill(c) -> Column:
    """log1p(max(0, coalesce(x, 0))): missing counts read as zero."""
    return F.log1p(F.greatest(F.coalesce(_col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def log1p_clipped(c) -> Column:
    """log1p(max(0, x)) with missing kept missing (greatest() skips NULL, so guard)."""
    x = _col(c).cast("double")
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def per_capita(count, population) -> Column:
    """count / population with population 0 treated as missing."""
    pop = _col(population).cast("double")
    return F.try_divide(_col(count).cast("double"), F.nullif(pop, F.lit(0.0)))


def per_10k(rate) -> Column:
    return _col(rate) * F.lit(10000.0)


def pattern_flag(desc, pattern: str) -> Column:
    """1 when the upper-cased description contains any alternative, else 0."""
    return F.upper(F.coalesce(_col(desc), F.lit(""))).rlike(pattern).cast("int")


def equality_flag(c, value=1) -> Column:
    """1 when the coerced value equals ``value``; missing -> 0."""
    return F.coalesce(safe_numeric(c) == F.lit(float(value)), F.lit(False)).cast("int")


def month_flag(c, month: str = "september") -> Column:
    return (F.lower(_col(c)) == F.lit(month)).cast("int")


def back_transform(c) -> Column:
    return F.exp(_col(c))


def pct_effect(beta) -> Column:
    """Percent effect of a log-model coefficient: (exp(b) - 1) * 100."""
    return (F.exp(_col(beta)) - F.lit(1.0)) * F.lit(100.0)


def price_in_range(c, lo=MIN_PRICE, hi=MAX_PRICE) -> Column:
    return _col(c).between(lo, hi)


def open_range(c, lo=0, hi=5000) -> Column:
    return (_col(c) > lo) & (_col(c) < hi)
