"""Moment matrices from one distributed pass each.

The columns of a row are one array; every task adds up its part of the matrix
with NumPy on Arrow batches and hands on k x k numbers, which are summed by
place.  Columns are centred in a second pass (means from the first) so the
driver never sees an ill-conditioned raw cross-product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _as_cols(df: DataFrame, cols):
    return [c if isinstance(c, Column) else F.col(f"`{c}`").cast("double") for c in cols]


def means(df: DataFrame, exprs) -> tuple[int, np.ndarray]:
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(e).alias(f"m{i}") for i, e in enumerate(exprs)]).first()
    return row["n"], np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0
                               for i in range(len(exprs))], dtype=float)


def matrix_sums(df: DataFrame, exprs, part, shape, group_cols=()):
    """Sum over all tasks (and for each group) of ``part(rows) -> array of ``shape``.

    ``rows`` is an (n, k) array of the expressions' values, NaN for NULL.  Returns
    the array, or {group: array} with ``group_cols`` (integers, few groups)."""
    k, size, n_groups = len(exprs), int(np.prod(shape)), len(group_cols)

    def add(batches):
        sums = {}
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, k)
            if not n_groups:
                sums[()] = sums.get((), 0.0) + part(rows)
                continue
            keys = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(n_groups)], axis=1)
            for key in np.unique(keys, axis=0):
                sums[tuple(key.tolist())] = sums.get(tuple(key.tolist()), 0.0) + part(rows[(keys == key).all(axis=1)])
        for key, value in sums.items():
            columns = [pa.array([x] * size, pa.int64()) for x in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(size), pa.int32()), pa.array(np.ravel(value))],
                                             names=[*[f"g{i}" for i in range(n_groups)], "at", "v"])

    names = [f"g{i}" for i in range(n_groups)]
    schema = ", ".join([*[f"{g} bigint" for g in names], "at int", "v double"])
    rows = df.select(F.array(*[F.coalesce(e.cast("double"), F.lit(float("nan"))) for e in exprs]).alias("x"),
                     *[F.col(g).cast("bigint").alias(n) for g, n in zip(group_cols, names, strict=True)])
    out = {}
    for r in rows.mapInArrow(add, schema).groupBy(*names, "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(tuple(r[g] for g in names), np.zeros(size))[r["at"]] = r["v"]
    if n_groups:
        return {key: v.reshape(shape) for key, v in out.items()}
    return out.get((), np.zeros(size)).reshape(shape)


def centered_gram(df: DataFrame, exprs, mu: np.ndarray) -> np.ndarray:
    """Sum of (x - mu)(x - mu)' over rows; a NULL counts as the mean in its products."""
    k = len(exprs)

    def part(rows):
        c = np.nan_to_num(rows - mu, nan=0.0, posinf=np.inf, neginf=-np.inf)
        return c.T @ c

    return matrix_sums(df, exprs, part, (k, k))


def gram_stats(df: DataFrame, cols):
    """(n, means, centred Gram) for the given columns/expressions."""
    exprs = _as_cols(df, cols)
    n, mu = means(df, exprs)
    return n, mu, centered_gram(df, exprs, mu)


def correlation_from_gram(g: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(g))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = g / np.outer(d, d)
    r[~np.isfinite(r)] = np.nan
    return r


def correlation_long(spark, names, r: np.ndarray):
    """Correlation matrix as (feature_1, feature_2, pearson_r) rows."""
    rows = [(names[i], names[j], None if np.isnan(r[i, j]) else float(r[i, j]))
            for i in range(len(names)) for j in range(len(names))]
    return spark.createDataFrame(rows, "feature_1 string, feature_2 string, pearson_r double")


def high_pairs(spark, names, r: np.ndarray, threshold: float = 0.8):
    """Upper-triangle pairs with |r| >= threshold, strongest first (empty table if none)."""
    rows = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            v = r[i, j]
            if not np.isnan(v) and abs(v) >= threshold:
                rows.append((names[i], names[j], float(v), float(abs(v))))
    df = spark.createDataFrame(rows, "feature_1 string, feature_2 string, pearson_r double, abs_r double")
    return df.orderBy(F.desc("abs_r"), "feature_1", "feature_2")


def independent_columns(r: np.ndarray, tol: float = 1e-10) -> list:
    """A largest set of columns without linear dependence, by Cholesky with diagonal pivoting: the column with
    the most variance left goes next, until no column has more than ``tol`` left."""
    k = len(r)
    left, chosen = np.array(r, dtype=float), []
    rest = list(range(k))
    while rest:
        j = max(rest, key=lambda i: (left[i, i], -i))
        if not left[j, j] > tol:
            break
        chosen.append(j)
        rest.remove(j)
        left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return chosen


def vif_from_corr(names, r: np.ndarray, tol: float = 1e-10):
    """VIF_j = 1 / (1 - R^2_j), R^2_j from regressing column j on the others (standardised, with intercept).

    One factorisation gives all of them: the diagonal of the inverse over an independent set of columns.  A
    column outside the set is a combination of some inside it; it and those have an infinite VIF.  A column
    without variance (NaN) has none."""
    known = [i for i in range(len(names)) if np.isfinite(r[i, i])]
    sub = r[np.ix_(known, known)]
    inside = independent_columns(sub, tol)
    outside = [i for i in range(len(known)) if i not in inside]
    inverse = np.linalg.inv(sub[np.ix_(inside, inside)]) if inside else np.zeros((0, 0))
    shares = inverse @ sub[np.ix_(inside, outside)]
    vif = np.full(len(names), np.nan)
    for at, i in enumerate(inside):
        infinite = bool((np.abs(shares[at]) > 1e-6).any())
        vif[known[i]] = math.inf if infinite else max(float(inverse[at, at]), 1.0)
    for i in outside:
        vif[known[i]] = math.inf
    return [(n, float(v)) for n, v in zip(names, vif)]


def vif_table(spark, names, r: np.ndarray):
    rows = vif_from_corr(names, r)
    df = spark.createDataFrame(rows, "feature string, VIF double")
    band = (F.when(F.col("VIF") > 10.0, F.lit("severe"))
             .when(F.col("VIF") > 5.0, F.lit("warning")).otherwise(F.lit("ok")))
    return df.withColumn("band", band).orderBy(F.desc("VIF"), "feature")
