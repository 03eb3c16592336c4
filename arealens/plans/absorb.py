"""Least squares on factors of very many levels.

The levels never become columns and are never collected: within-group centring
takes a factor out of every variable, with a joined table of level means.  One
factor needs one centring; several are taken out by alternating projections,
each round written to the shared folder, until no variable changes any more.
The slopes then come from the small normal equations of what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import stats as ST
from .moments import matrix_sums, means

ROUNDS = 200


class AbsorbedFit:
    """Slopes with their errors, and the rows' level effects as a table."""

    def __init__(self, names, coef, cov, n, levels, ssr, effects):
        self.names, self.coef, self.cov, self.n, self.levels, self.ssr = names, coef, cov, n, levels, ssr
        self.effects = effects

    def coefficients(self, spark) -> DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0.0)) if self.cov is not None else [None] * len(self.names)
        return spark.createDataFrame([(n, float(b), None if s is None else float(s)) for n, b, s in zip(self.names, self.coef, se)],
                                     "term string, coef double, std_err double")


def _level_means(df: DataFrame, factor: str, cols) -> DataFrame:
    """One row for each level: rows and means; partial sums first, so a level with a third of all rows is small."""
    return df.groupBy(F.col(factor).alias("__level")).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.avg(c).alias(f"__mean_{c}") for c in cols])


def centred_within(df: DataFrame, factor: str, cols) -> DataFrame:
    """``cols`` less their means in each level of ``factor`` (NULL is a level)."""
    level = _level_means(df, factor, cols)
    met = df.join(level, F.col(factor).eqNullSafe(F.col("__level")))
    return met.withColumns({c: F.col(c) - F.col(f"__mean_{c}") for c in cols}).drop("__level", *[f"__mean_{c}" for c in cols])


def fit_absorbed(df: DataFrame, numeric, factors, y: str, tol: float = 1e-10) -> AbsorbedFit:
    """OLS of ``y`` on ``numeric`` and the levels of ``factors``; rows with a NULL in a number take no part.

    With one factor the errors are HC3 with the leverages of the full design, and ``effects`` has one row for
    each level: (level, rows, effect).  With several factors only slopes are given."""
    numeric, factors = list(numeric), list(factors)
    k = len(numeric)
    work = [f"__x{i}" for i in range(k + 1)]
    start = df.select(*[F.col(f).alias(f"__f{i}") for i, f in enumerate(factors)],
                      *[F.col(f"`{c}`").cast("double").alias(w) for c, w in zip([*numeric, y], work)]).dropna(subset=work)
    if len(factors) == 1:
        rows = written(centred_within(start, "__f0", work), "absorbed")
    else:
        rows = written(start, "absorbed")
        size = np.sqrt(np.maximum(_variances(rows, work), 0.0))
        for _ in range(ROUNDS):
            was = _variances(rows, work)
            for i in range(len(factors)):
                rows = centred_within(rows, f"__f{i}", work).drop("__rows")
            rows = written(rows, "absorbed")
            # a projection takes away squares: when none are taken away any more, it changes nothing
            if (np.abs(was - _variances(rows, work)) <= tol * np.maximum(size, 1e-300) ** 2).all():
                break
    exprs = [F.col(w) for w in work]
    gram = matrix_sums(rows, exprs, lambda x: x.T @ x, (k + 1, k + 1))
    n = rows.count()
    scale = np.sqrt(np.maximum(np.diag(gram)[:k], 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    inverse, _, _ = ST.psd_pinv(gram[:k, :k] / np.outer(scale, scale))
    bread = inverse / np.outer(scale, scale)
    coef = bread @ gram[:k, k]
    ssr = float(gram[k, k] - coef @ gram[:k, k])
    if len(factors) > 1:
        return AbsorbedFit(numeric, coef, None, n, None, ssr, None)

    def meat(x):
        c, size = x[:, :k], x[:, k + 1]
        h = 1.0 / size + np.einsum("ij,jk,ik->i", c, bread, c)
        e = x[:, k] - c @ coef
        w = np.where(h < 1 - 1e-12, (e / np.where(h < 1 - 1e-12, 1 - h, 1.0)) ** 2, 0.0)  # a level of one row fits itself
        return (c * w[:, None]).T @ c

    cov = bread @ matrix_sums(rows, [*exprs, F.col("__rows")], meat, (k, k)) @ bread
    table = _level_means(start, "__f0", work)
    effect = F.col(f"__mean_{work[k]}")
    for c, b in zip(work, coef):
        effect = effect - F.col(f"__mean_{c}") * F.lit(float(b))
    effects = table.select(F.col("__level").alias("level"), F.col("__rows").alias("rows"), effect.alias("effect"))
    return AbsorbedFit(numeric, coef, cov, n, table.count(), ssr, effects)


def _variances(rows: DataFrame, cols) -> np.ndarray:
    n, mean = means(rows, [F.col(c) for c in cols])
    return matrix_sums(rows, [F.col(c) for c in cols], lambda x: ((x - mean) ** 2).sum(axis=0), (len(cols),))
