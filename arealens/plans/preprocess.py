"""Train/test split, folds, scaler, imputers and one-hot encoding as Spark
expressions fitted from one aggregate each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import hash_bins, keys_at_hash_ranks, perm_hash
from ..operators.quantiles import medians


def _seeded(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with the hash that orders the rows of a seed."""
    return df.withColumn("__h", perm_hash(df, key, seed))


def prefix_ends(df: DataFrame, key: str, seed: int, sizes_of) -> tuple[list, int]:
    """(the last (hash, key) of the first ``size`` rows in the seeded order, for each size of ``sizes_of(n)``; the
    number n of rows).

    A row belongs to a prefix by comparison with literals, so the rows are neither shuffled nor sorted.  The
    key may have any orderable type; rows of equal keys go together."""
    placed, counts = hash_bins(_seeded(df, key, seed), "__h", key)
    n = sum(counts.values())
    sizes = sizes_of(n)
    ends = keys_at_hash_ranks(placed, counts, "__h", key, [s - 1 for s in sizes])
    return [ends[s - 1] for s in sizes], n


def _within(df: DataFrame, key: str, end):
    k = F.lit(end[1]).cast(df.schema[key].dataType)
    return (F.col("__h") < end[0]) | ((F.col("__h") == end[0]) & (F.col(key) <= k))


def holdout_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42):
    """Shuffled split: the first ceil(test_size * n) rows of the seeded order
    are the test set.  Returns (frame with ``is_test``, n)."""
    def sizes(n):
        n_test = int(math.ceil(test_size * n))
        return [n_test] if 0 < n_test < n else []

    ends, n = prefix_ends(df, key, seed, sizes)
    if not ends:
        return df.withColumn("is_test", F.lit(math.ceil(test_size * n) > 0)), n
    return _seeded(df, key, seed).withColumn("is_test", _within(df, key, ends[0])).drop("__h"), n


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold"):
    """Shuffled k-fold assignment: contiguous blocks of the seeded order, the
    first n % k folds one row larger."""
    def sizes(n):
        q, r = divmod(n, k)
        return [s for s in (q * (i + 1) + min(i + 1, r) for i in range(k - 1)) if 0 < s < n]

    ends, n = prefix_ends(df, key, seed, sizes)
    fold = F.lit(0)
    for end in ends:
        fold = fold + F.when(_within(df, key, end), 0).otherwise(1)
    return _seeded(df, key, seed).withColumn(name, fold.cast("int")).drop("__h"), n


def fit_scaler(df: DataFrame, cols) -> dict:
    """{col: (mean, population std)}; a zero std scales by 1."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        sd = row[f"s{i}"]
        out[c] = (row[f"m{i}"], sd if sd else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def fit_median_imputer(train: DataFrame, cols) -> dict:
    return medians(train, cols)


def apply_imputer(df: DataFrame, fills: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None})


def fit_mode(train: DataFrame, col: str):
    """Most frequent non-null value; ties go to the smallest value.

    A grouped count (partial aggregation first) and a top-1 -- no group is
    ever gathered in one task."""
    r = (train.where(F.col(col).isNotNull()).groupBy(col).count()
         .orderBy(F.desc("count"), F.asc(col)).limit(1).collect())
    return (r[0][col], r[0]["count"]) if r else (None, 0)


def fit_onehot(train: DataFrame, col: str):
    return [r[0] for r in train.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def onehot_columns(col: str, levels) -> dict:
    """One column per fitted level; an unseen level and NULL are all zeros."""
    return {f"{col}_{lv}": F.coalesce((F.col(col) == F.lit(lv)).cast("double"), F.lit(0.0)) for lv in levels}
