"""Correlation of many columns, in blocks of columns.

Every task adds up its part of the cross products for each pair of column
blocks; the parts of a pair are summed in a tree whose nodes take a bounded
number of matrices.  A pair of blocks is turned into correlations and filtered
where it was summed, so no k x k matrix and no list of k x k rows ever reaches
the driver; it gets one mean and one scale for each column.  The rows are read
twice: for the means, by an aggregate, and for the products, whose diagonal
gives the scales.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256   # columns of a block: a pair of blocks is at most 512 KB
FAN_IN = 16   # matrices that one node of the tree adds


def _rows(df: DataFrame, cols) -> DataFrame:
    missing = F.lit(float("nan"))
    return df.select(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), missing) for c in cols]).alias("x"))


def _batch(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _means(df: DataFrame, cols) -> np.ndarray:
    """Mean of each column over its values; NaN is missing, like NULL."""
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    found = df.agg(*[F.avg(F.when(~F.isnan(v), v)).alias(f"m{i}") for i, v in enumerate(x)]).first()
    return np.array([0.0 if v is None else v for v in found])


def wide_correlation_pairs(df: DataFrame, cols, threshold: float, block: int = BLOCK) -> DataFrame:
    """(feature_1, feature_2, pearson_r, abs_r) for all pairs of ``cols`` (in their order) with |r| >= threshold.

    As in the audit of fewer columns a missing value counts as its column's mean; a column without variance
    has no pairs."""
    cols = list(cols)
    k, spark = len(cols), df.sparkSession
    schema = "feature_1 string, feature_2 string, pearson_r double, abs_r double"
    if k < 2:
        return spark.createDataFrame([], schema)
    rows = _rows(df, cols)
    mean = _means(df, cols)
    edges = list(range(0, k, block))
    pairs = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]

    def products(batches):
        total = {}
        for batch in batches:
            c = np.nan_to_num(_batch(batch, k) - mean, nan=0.0)
            for i, j in pairs:
                g = c[:, edges[i]:edges[i] + block].T @ c[:, edges[j]:edges[j] + block]
                total[i, j] = total[i, j] + g if (i, j) in total else g
        part = TaskContext.get().partitionId()
        for (i, j), g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int64()),
                                              pa.array([g.tobytes()], pa.binary())], names=["bi", "bj", "part", "g"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g, "f8") for g in table["g"].to_pylist())
        return pa.table({"bi": table["bi"][:1], "bj": table["bj"][:1], "part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()),
                         "g": pa.array([total.tobytes()], pa.binary())})

    parts_schema = "bi int, bj int, part bigint, g binary"
    parts = rows.mapInArrow(products, parts_schema)
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        parts = parts.groupBy("bi", "bj", F.expr(f"part div {FAN_IN}")).applyInArrow(add, parts_schema)
        tasks = -(-tasks // FAN_IN)

    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)  # one matrix for each pair of blocks

    def diagonals(batches):
        for batch in batches:
            for i, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = math.isqrt(len(g) // 8)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.diag(np.frombuffer(g, "f8").reshape(m, m)).tolist()])],
                                                 names=["b", "d"])

    squares = np.zeros(k)
    for r in parts.where("bi = bj").select("bi", "g").mapInArrow(diagonals, "b int, d array<double>").collect():
        squares[edges[r["b"]]:edges[r["b"]] + len(r["d"])] = r["d"]
    scale = np.sqrt(squares)

    def correlations(batches):
        for batch in batches:
            for i, j, g in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                a, b = edges[i], edges[j]
                sa, sb = scale[a:a + block], scale[b:b + block]
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = np.frombuffer(g, "f8").reshape(len(sa), len(sb)) / np.outer(sa, sb)
                at, of = np.nonzero(np.abs(r) >= threshold)
                keep = at + a < of + b
                at, of = at[keep], of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(at + a, pa.int32()), pa.array(of + b, pa.int32()), pa.array(r[at, of])],
                                                 names=["i", "j", "r"])

    found = parts.mapInArrow(correlations, "i int, j int, r double")
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(F.get(names, F.col("i")).alias("feature_1"), F.get(names, F.col("j")).alias("feature_2"),
                        F.col("r").alias("pearson_r"), F.abs("r").alias("abs_r"))
