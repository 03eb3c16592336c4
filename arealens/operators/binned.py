"""Quantile-binned means (the data behind trend charts) and axis bounds.

All features go together: one aggregate counts rows and distinct values, one
quantile call gives the edges of every feature, and one grouped pass over the
stacked features gives the means of all bins."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# The two editions' guards on the binned chart.
RULES = {
    "v1": dict(q=20, min_rows=10, min_distinct=1, min_bins=1),
    "v2": dict(q=12, min_rows=20, min_distinct=4, min_bins=4),
}
_SCHEMA = "feature string, bin bigint, x_mean double, y_mean double, n bigint"


def _number(c: str):
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _edges_below(x, edges):
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x)) if edges else F.lit(0)


def _bin_counts(d: DataFrame, k: int, q: int, min_rows: int, min_distinct: int) -> dict:
    """{feature number: how many bins it asks for}, without those that fail a guard on rows or distinct values.

    The approximate count settles the common case; only small distinct counts are counted exactly."""
    row = d.agg(*[a for i in range(k) for a in (F.count(f"x{i}").alias(f"n{i}"),
                                                F.approx_count_distinct(f"x{i}", 0.05).alias(f"a{i}"))]).first()
    few = [i for i in range(k) if row[f"a{i}"] <= 2 * q and row[f"n{i}"]]
    exact = d.agg(*[F.count_distinct(f"x{i}").alias(f"d{i}") for i in few]).first() if few else {}
    out = {}
    for i in range(k):
        distinct = exact[f"d{i}"] if i in few else row[f"a{i}"]
        if row[f"n{i}"] >= min_rows and min(q, distinct) >= max(1, min_distinct):
            out[i] = min(q, distinct)
    return out


def trend_table(df: DataFrame, features, y: str, q: int = 12, min_rows: int = 20,
                min_distinct: int = 4, min_bins: int = 4) -> DataFrame:
    """For every feature that is a column: equal-count bins (exact interpolated quantile edges, duplicate edges
    dropped, right-closed, lowest edge included), then mean x, mean y and the row count of each bin that has rows.
    A feature that fails a guard has no rows; rows without x or y take no part."""
    names = [f for f in features if f in df.columns]
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], _SCHEMA)
    value = _number(y)
    d = df.select(value.alias("y"), *[F.when(value.isNotNull(), _number(f)).alias(f"x{i}") for i, f in enumerate(names)])
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bins = _bin_counts(d, len(names), q, min_rows, min_distinct)
        edges = exact_quantiles(d, [f"x{i}" for i in bins], {f"x{i}": [j / b for j in range(b + 1)] for i, b in bins.items()})
        parts = []
        for i in bins:
            x = F.col(f"x{i}")
            at = _edges_below(x, sorted(set(edges[f"x{i}"]))[1:-1])
            parts.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("f"), at.cast("bigint").alias("bin"), x.alias("x"))))
        rows = []
        if parts:
            stacked = d.select("y", F.explode(F.array_compact(F.array(*parts))).alias("s"))
            rows = stacked.groupBy("s.f", "s.bin").agg(F.avg("s.x").alias("x"), F.avg("y").alias("y"),
                                                       F.count(F.lit(1)).alias("n")).collect()
    finally:
        d.unpersist()
    held = [i for i in bins if sum(r["f"] == i for r in rows) >= min_bins]
    # at most q rows for each feature: the result is built from the collected bins
    return spark.createDataFrame([(names[r["f"]], r["bin"], r["x"], r["y"], r["n"]) for r in rows if r["f"] in held], _SCHEMA)


def binned_means(df: DataFrame, x: str, y: str, **rules) -> DataFrame:
    """The bins of one feature."""
    return trend_table(df, [x], y, **rules).drop("feature")
