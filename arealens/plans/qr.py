"""Least squares by a tall-skinny QR factorisation.

Every task factorises its rows of [1, X, y] block by block and keeps only the
small triangular factor; the tasks' factors are stacked and factorised again in
a tree whose nodes take a bounded number of them.  The condition number of the
design enters once, not squared as in the normal equations, so designs that
those cannot solve keep their digits.  A second pass adds up residual moments
and the HC3 meat with leverages from the factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import OLSResult
from .moments import matrix_sums

FAN_IN = 16
_PARTS = "part bigint, r binary"


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, with as many rows as columns."""
    k = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r


def r_factor(df: DataFrame, exprs) -> np.ndarray:
    """The triangular factor of the matrix of the expressions' values over all rows."""
    k = len(exprs)
    rows = df.select(F.array(*[e.cast("double") for e in exprs]).alias("x"))

    def local(batches):
        r = np.zeros((0, k))
        for batch in batches:
            r = _triangle(np.vstack([r, batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                             names=["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = _triangle(np.vstack([np.frombuffer(b, "f8").reshape(-1, k) for b in table["r"].to_pylist()]))
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    parts, tasks = rows.mapInArrow(local, _PARTS), rows.rdd.getNumPartitions()
    while tasks > 1:
        parts, tasks = parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(merge, _PARTS), -(-tasks // FAN_IN)
    found = parts.collect()
    return np.frombuffer(found[0]["r"], "f8").reshape(k, k) if found else np.zeros((k, k))


def fit_ols_qr(df: DataFrame, terms, y: str, rel_tol: float = 1e-13) -> OLSResult:
    """OLS of ``y`` on ``terms`` with HC3 errors; ``df`` is complete-case.

    Columns are scaled by their lengths.  Directions with a singular value below ``rel_tol`` of the largest
    are left out (least norm in the scaled columns)."""
    k = len(terms)
    exprs = [t.expr for t in terms] + [F.col(f"`{y}`").cast("double")]
    r = r_factor(df, exprs)
    x, z = r[:, :k], r[:, k]
    size = np.sqrt((x * x).sum(axis=0))
    size = np.where(size > 0, size, 1.0)
    u, s, vt = np.linalg.svd(x / size, full_matrices=False)
    keep = s > rel_tol * s.max(initial=0.0)
    half = (vt[keep].T / s[keep]) / size[:, None]  # rows of X times this are the rows of an orthonormal matrix
    coef = half @ (u[:, keep].T @ z)
    rank = int(keep.sum())

    def moments(rows):
        e, q = rows[:, k] - rows[:, :k] @ coef, rows[:, :k] @ half
        h = (q * q).sum(axis=1)
        out = np.zeros((rank + 1, max(rank, 4)))
        yc = rows[:, k]
        out[0, :4] = (e * e).sum(), len(e), yc.sum(), (yc * yc).sum()
        out[1:, :rank] = (q * ((e / (1 - h)) ** 2)[:, None]).T @ q
        return out

    m = matrix_sums(df, exprs, moments, (rank + 1, max(rank, 4)))
    ssr, n, sy, syy = (float(v) for v in m[0, :4])
    cov = half @ m[1:, :rank] @ half.T
    sst = syy - sy * sy / n if n else 0.0
    metrics = {"nobs": n, "rank": float(rank), "ssr": ssr, "rsquared": 1 - ssr / sst if sst > 0 else float("nan"),
               "condition_number": float(s.max() / s[keep].min()) if rank else float("nan")}
    return OLSResult([t.name for t in terms], coef, cov, int(n), rank, ssr, sst, metrics, list(terms))
