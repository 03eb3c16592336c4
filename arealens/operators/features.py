"""Standardisation and composite indices.

Column statistics come from one multi-column aggregate (one row returned to the
driver); the transforms are then plain column expressions with literal
constants, so they stay inside whole-stage codegen and add no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import per_capita


def _num(c) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def moments(df: DataFrame, cols) -> dict:
    """{col: (mean, sample std)} in one pass."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_num(c)).alias(f"m{i}"), F.stddev_samp(_num(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def zscore_expr(c, mean, sd, guard: bool = True) -> Column:
    """(x - mean) / sd.  Guarded: when sd is missing or 0 every row is 0.0
    (missing rows included).  Unguarded: sd 0 gives NULL."""
    if sd is None or sd == 0 or mean is None:
        return F.lit(0.0) if guard else F.lit(None).cast("double")
    return (_num(c) - F.lit(mean)) / F.lit(sd)


def with_zscores(df: DataFrame, spec: dict, guard: bool = True, stats: dict | None = None) -> DataFrame:
    """spec: {new_col: source_col}."""
    stats = stats if stats is not None else moments(df, spec.values())
    return df.withColumns({new: zscore_expr(src, *stats[src], guard=guard) for new, src in spec.items()})


def composite_strict(parts) -> Column:
    """Mean of the parts; NULL when any part is NULL."""
    parts = list(parts)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(float(len(parts)))


def composite_skip_null(parts) -> Column:
    """Mean over the parts that are present; NULL when none is."""
    parts = list(parts)
    s = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("double") for p in parts[1:]), parts[0].isNotNull().cast("double"))
    return F.try_divide(s, F.nullif(n, F.lit(0.0)))


def fallback_rate(df: DataFrame, rate_col: str, count_col: str, pop_col: str = "Population"):
    """The rate column when present, else count / population, else None."""
    if rate_col in df.columns:
        return F.col(rate_col)
    if count_col in df.columns and pop_col in df.columns:
        return per_capita(count_col, pop_col)
    return None
