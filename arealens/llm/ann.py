"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: every usable vector is scaled to length 1, the mean of all of them is
subtracted, and the rest is rotated by a seeded random orthogonal matrix.  A
vector keeps the signs (one packed bit for each dimension) and three correction
scalars: the length of the rest, its product with the mean, and the product of
the rest's direction with its own code.

Search: the code's inner product with a rotated query, divided by the last
scalar, estimates the cosine without bias, and the scalar also gives the error
bound.  In a block, candidates whose upper bound reaches the k-th best lower
bound are reranked with exact cosines in double precision; the best k of every
block meet in a window per query.

Queries and rows are paired in blocks: rows are dealt into groups of about
``GROUP_ROWS``, queries into groups of ``QUERY_ROWS``, and a task handles one pair
of groups, so memory is bounded at any size.  The index itself is built on all
rows; nothing is sampled.

Defined results
* vectors that are null, zero, or hold a null or non-finite component take no
  part, nor do vectors whose length is not the most frequent one;
* fewer than k candidates: all of them; no usable vector: empty result;
* ties go to the smaller id; rows that repeat an id are candidates each, and a
  query's own id is never its candidate; a null id takes no part;
* extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

GROUP_ROWS = 8_192
QUERY_ROWS = 1_024
EPSILON = 3.0  # standard errors of the estimate that the bounds allow
SEED = 20_260
ROUND = 256  # queries handled at once within a task

_INDEX = "id bigint, vec array<double>, code binary, rest double, at_mean double, fit double"
_RESULT = "query_id bigint, id bigint, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the vectors that take part, and their dimension (0 if there are none)."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)))
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    return rows.where(F.size("vec") == dim), dim


def mean_direction(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean of the unit vectors: partial sums in the tasks, one row each to the final sum."""

    def partial(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype("f8")
            total += (x / np.sqrt((x * x).sum(1))[:, None]).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())],
                                         names=["i", "s", "n"])

    sums = (rows.select("vec").mapInArrow(partial, "i int, s double, n bigint")
            .groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect())
    return np.array([r["m"] for r in sums])


def build_index(rows: DataFrame, dim: int, mean: np.ndarray, seed: int = SEED) -> DataFrame:
    """Codes and correction scalars for every row."""
    turn = rotation(dim, seed)

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype("f8")
            x /= np.sqrt((x * x).sum(1))[:, None]
            rest = x - mean
            size = np.sqrt((rest * rest).sum(1))
            direction = (rest / np.where(size > 0, size, 1)[:, None]) @ turn.T
            bits = direction >= 0
            fit = np.abs(direction).sum(1) / np.sqrt(dim)
            codes = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(size), pa.array(rest @ mean), pa.array(np.where(size > 0, fit, 1.0))],
                names=["id", "vec", "code", "rest", "at_mean", "fit"])

    return rows.mapInArrow(encode, _INDEX)


def block_search(rows: pa.Table, queries: pa.Table, dim: int, k: int, mean: np.ndarray, turn: np.ndarray) -> pa.Table:
    """The best ``k`` rows of one block for each query of one block."""
    out_q, out_id, out_s = [], [], []
    if rows.num_rows and queries.num_rows:
        ids, x = rows["id"].to_numpy(), _matrix(rows["vec"], dim).astype("f8")
        length = np.sqrt((x * x).sum(1))
        raw = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        signs = np.unpackbits(raw, axis=1, count=dim).astype("f4") * 2 - 1
        rest, at_mean, fit = (rows[c].to_numpy() for c in ("rest", "at_mean", "fit"))
        spread = EPSILON * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, dim - 1))
        all_q = _matrix(queries["vec"], dim).astype("f8")
        all_ids = queries["id"].to_numpy()
        for at in range(0, len(all_ids), ROUND):
            q, q_ids = all_q[at:at + ROUND], all_ids[at:at + ROUND]
            unit = q / np.sqrt((q * q).sum(1))[:, None]
            q_rest = unit - mean
            q_size = np.sqrt((q_rest * q_rest).sum(1))
            turned = q_rest @ turn.T
            # <unit, x> = <q_rest, x_rest> + <q_rest, mean> + <mean, x_rest> + <mean, mean>
            estimate = (turned.astype("f4") @ signs.T).astype("f8") / np.sqrt(dim) * (rest / fit)
            estimate += (q_rest @ mean)[:, None] + (at_mean + mean @ mean)
            slack = q_size[:, None] * (rest * spread) + 1e-6
            lower = estimate - slack
            own = q_ids[:, None] == ids[None, :]
            lower[own] = -np.inf
            kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(q), -np.inf)
            chosen = (estimate + slack >= kth[:, None]) & ~own
            for j in range(len(q)):
                c = np.flatnonzero(chosen[j])
                score = (x[c] * q[j]).sum(1) / (length[c] * np.sqrt((q[j] * q[j]).sum()))
                best = np.lexsort((ids[c], -score))[:k]
                out_q += [q_ids[j]] * len(best)
                out_id += ids[c][best].tolist()
                out_s += score[best].tolist()
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()),
                     "score": pa.array(out_s, pa.float64())})


def search(index: DataFrame, queries: DataFrame, dim: int, k: int, mean: np.ndarray, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of the index for each (id, vec) of ``queries``."""
    turn = rotation(dim, seed)
    groups = max(1, -(-index.count() // GROUP_ROWS))
    rounds = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = (index.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))))
    asked = (queries.select("id", "vec").withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)).cast("int"))
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_search(left, right, dim, k, mean, turn)

    found = dealt.groupBy("g", "b").cogroup(asked.groupBy("g", "b")).applyInArrow(run, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int) -> DataFrame:
    """Index all vectors and search the rows for which ``is_query`` (a condition on ``id``) holds."""
    rows, dim = usable(vectors, id_col, vec_col)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    mean = mean_direction(rows, dim)
    index = written(build_index(rows, dim, mean), "ann-index")
    return search(index, index.where(is_query).select("id", "vec"), dim, k, mean)
