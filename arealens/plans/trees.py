"""Boosted trees with train-fitted preprocessing, their predictions, and permutation
importance computed over pairs of test rows (bounded batches of copies for other models)."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import permutation_donors_many
from ..session import shared_dir
from .boosting import HistogramBoosting
from .preprocess import (apply_imputer, apply_scaler, fit_median_imputer, fit_mode, fit_onehot, fit_scaler,
                         onehot_columns)

# Boosted-tree settings of the three models (learning rate,
# iterations, leaves, minimum leaf size, seed).
GBM_LISTING = dict(step_size=0.05, max_iter=400, max_leaves=31, min_leaf=30, seed=42)
GBM_EXTERNAL = dict(step_size=0.05, max_iter=400, max_leaves=20, min_leaf=30, seed=42)
GBM_AREA = dict(step_size=0.04, max_iter=300, max_leaves=10, min_leaf=8, seed=42)

# From so many training rows on a share of them is held out, and boosting ends when their
# loss has not fallen by the tolerance for some iterations.
EARLY_ROWS, EARLY_SHARE, EARLY_PATIENCE, EARLY_TOLERANCE = 10_000, 0.1, 10, 1e-7
FIRST_TREES = 50  # of the first try; a try that has not ended is followed by one of all trees

# Copies of the test rows that one importance job holds at most.
MAX_COPIES = 20
ROWS_PER_TASK = 20_000       # of the training rows, until every core has a task
MOST_ROWS_PER_TASK = 500_000  # from then on


def _depth_for_leaves(leaves: int) -> int:
    return max(1, math.ceil(math.log2(leaves)))


def _number(c: str):
    """The column as a double; NaN is missing, like NULL."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


class BoostedModel:
    """Median imputer and scaler for numbers, mode imputer and one-hot (unknown
    level -> zeros) for categories, all fitted on the training rows; then the trees."""

    def __init__(self, numeric, categorical, fills, scale, modes, levels, model=None):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.fills, self.scale, self.modes, self.levels, self.model = fills, scale, modes, levels, model
        self.losses = None

    def features(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        work = {f"__n_{c}": _number(c) for c in self.numeric}
        work |= {f"__c_{c}": F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.categorical}
        df = df.withColumns(work)
        df = apply_scaler(apply_imputer(df, self.fills), self.scale)
        cols = {}
        for c in self.categorical:
            cols.update(onehot_columns(f"__c_{c}", self.levels[c]))
        df = df.withColumns(cols) if cols else df
        names = [f"__n_{c}" for c in self.numeric] + list(cols)
        return VectorAssembler(inputCols=names, outputCol="__features").transform(df).drop(*work, *cols)

    def groups(self, features) -> list[list[int]]:
        """The places in the vector of ``features`` that each of these columns fills."""
        at = {c: [i] for i, c in enumerate(self.numeric)}
        end = len(self.numeric)
        for c in self.categorical:
            at[c] = list(range(end, end := end + len(self.levels[c])))
        return [at[f] for f in features]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.model.transform(self.features(df)).withColumnRenamed("prediction", out).drop("__features")


def fit_preprocessor(train: DataFrame, numeric, categorical) -> BoostedModel:
    """The preprocessing of a boosted model, without its trees."""
    work = train.withColumns({f"__n_{c}": _number(c) for c in numeric})
    named = [f"__n_{c}" for c in numeric]
    fills = fit_median_imputer(work, named)
    scale = fit_scaler(apply_imputer(work, fills), named)
    modes = {c: fit_mode(train, c)[0] for c in categorical}
    levels = {c: fit_onehot(train, c) for c in categorical}
    return BoostedModel(numeric, categorical, fills, scale, modes, levels)


def best_iteration(losses, patience: int = EARLY_PATIENCE, tolerance: float = EARLY_TOLERANCE) -> tuple[int, bool]:
    """(the iteration, from 0, of the least loss before boosting ends; whether it ended): it ends at the first
    iteration that is ``patience`` after the last one that lowered the least loss by ``tolerance``."""
    best = 0
    for i, loss in enumerate(losses):
        if i and loss < losses[best] - tolerance:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def _held_out(key: str, share: float, seed: int):
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) < round(share * 1000)


def training_tasks(n: int, cores: int) -> int:
    """Tasks for ``n`` training rows.  A tree is several small jobs whose every task sends all histograms: a task
    for each ``ROWS_PER_TASK`` rows until every core has one, then only as many as bound the rows of a task."""
    return max(min(n // ROWS_PER_TASK + 1, cores), n // MOST_ROWS_PER_TASK + 1)


def _spread(data: DataFrame, n: int, side_by_side: int = 1) -> DataFrame:
    """``data`` of ``n`` rows in tasks of about equal size, however few or many files and joins left; the cores are
    shared by ``side_by_side`` fits."""
    tasks = training_tasks(n, max(1, data.sparkSession.sparkContext.defaultParallelism // side_by_side))
    return data.repartition(tasks)  # the shuffle also keeps what made the rows out of the tasks of every tree


def fit_boosted(train: DataFrame, numeric, categorical, y: str, step_size=0.05, max_iter=400, max_leaves=31,
                min_leaf=30, seed=42, key: str | None = None, early: bool | None = None,
                side_by_side: int = 1) -> BoostedModel:
    """Fit on the rows of ``train``; preprocessing is fitted on all of them.  ``side_by_side`` is the number of fits
    that run at a time, each in a thread of its own.

    With ``early`` (None: from ``EARLY_ROWS`` rows on) a share of the rows, chosen by a hash of ``key``, trains no
    tree: it gives the loss after every iteration, and the model is the ensemble up to the best one.  If boosting
    has not ended within ``FIRST_TREES`` trees, a second try goes on from them to at most ``max_iter``.
    Without ``early`` all rows train all ``max_iter`` trees.  ``model.losses`` has the held-out losses up to the
    end, None without one."""
    sc = train.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:  # boosting keeps its binned rows there
        sc.setCheckpointDir(shared_dir(train.sparkSession))
    # every statistic is a pass over the rows, and what they are derived from is not read again for each
    train = train.select(*dict.fromkeys([*numeric, *categorical, y, *([key] if key else [])])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bm = fit_preprocessor(train, numeric, categorical)
        n = train.count()
        if early is None:
            early = key is not None and n > EARLY_ROWS
        if early and key is None:
            raise ValueError("a held-out share needs a key")
        held = _held_out(key, EARLY_SHARE, seed) if early else F.lit(False)
        data = bm.features(train).select("__features", F.col(y).cast("double").alias("__label"), held.alias("__held"))
        data = _spread(data, n, side_by_side).persist(StorageLevel.MEMORY_AND_DISK)
        data.count()
    finally:
        train.unpersist()
    kw = dict(featuresCol="__features", labelCol="__label", stepSize=step_size,
              maxDepth=_depth_for_leaves(max_leaves), minInstancesPerNode=min_leaf, seed=seed,
              maxBins=255, subsamplingRate=1.0, lossType="squared")
    grower = None
    try:
        if not early:
            boosting = HistogramBoosting(maxIter=max_iter, **kw)
            bm.model, grower = boosting.fit(data), boosting.grower
            return bm
        for trees in sorted({min(FIRST_TREES, max_iter), max_iter}):
            boosting = HistogramBoosting(maxIter=trees, **kw).start("__held", lambda losses: best_iteration(losses)[1], grower)
            model, grower = boosting.fit(data), boosting.grower
            bm.losses = list(grower.losses)
            best, ended = best_iteration(bm.losses)
            if ended:
                break
        bm.model = model.first(best + 1)
    finally:
        if grower is not None:
            grower.close()
        data.unpersist()
    return bm


def prediction_table(scored: DataFrame, key: str, log_price: str, prediction: str = "prediction",
                     suffix: str = "gbm") -> DataFrame:
    """Actual and predicted values on the price and the log scale, one row for each key."""
    return scored.select(key, F.exp(log_price).alias("actual_price"), F.exp(prediction).alias(f"predicted_price_{suffix}"),
                         F.col(log_price).alias("actual_log_price"), F.col(prediction).alias(f"predicted_log_price_{suffix}"))


def permutation_importance(test: DataFrame, key: str, features, y: str, predict,
                           repeats: int = 5, seed: int = 42, max_copies: int = MAX_COPIES, model: BoostedModel | None = None):
    """Mean and (population) std of the drop in R^2 when one input column is
    permuted among the test rows, over ``repeats`` seeded permutations.

    ``predict(df) -> df`` adds a ``prediction`` column.  Each test row is paired
    once per repeat with the row whose values it receives; the pairs are kept,
    and a job scores the copies of as many features as ``max_copies`` allows.
    With the ``model`` that predicts, a row is prepared once and not copied: its
    pairs have the bins of both rows, and one job scores all features."""
    features = list(features)
    test = test.select(key, y, *[F.col(f"`{f}`") for f in features]).persist(StorageLevel.MEMORY_AND_DISK)
    base = predict(test).select(F.col(y).cast("double").alias("__y"), F.col("prediction").alias("__p"))
    b = base.agg(F.sum((F.col("__y") - F.col("__p")) ** 2).alias("sse"), F.count(F.lit(1)).alias("n"),
                 F.var_pop("__y").alias("v")).first()
    sst = b["v"] * b["n"]
    r2_base = 1.0 - b["sse"] / sst
    drops = {f: [] for f in features}
    donors = permutation_donors_many(test, key, [seed + r for r in range(repeats)])
    if model is not None:
        coded = model.features(test).select(key, F.col(y).alias("__y"), model.model.codes(F.col("__features")).alias("__code"))
        coded = coded.persist(StorageLevel.MEMORY_AND_DISK)
        given = coded.select(F.col(key).alias("donor_key"), F.col("__code").alias("given"))
        pairs = coded.join(donors, key).join(given, "donor_key").select(
            F.col("__rep").alias("rep"), F.col("__y").alias("y"), F.col("__code").alias("code"), "given")
        for (_, i), sse in model.model.swapped_losses(pairs, model.groups(features)).items():
            drops[features[i]].append(r2_base - (1.0 - sse / sst))
        coded.unpersist()
        test.unpersist()
        return r2_base, _importances(features, drops)
    given = test.select(F.col(key).alias("donor_key"), *[F.col(f"`{f}`").alias(f"__d_{i}") for i, f in enumerate(features)])
    paired = test.join(donors, key).join(given, "donor_key").persist(StorageLevel.MEMORY_AND_DISK)
    batch = max(1, max_copies // repeats)
    for start in range(0, len(features), batch):
        chunk = list(enumerate(features))[start:start + batch]
        ex = paired.withColumn("__f", F.explode(F.array(*[F.lit(i) for i, _ in chunk])))
        ex = ex.withColumns({f: F.when(F.col("__f") == i, F.col(f"__d_{i}")).otherwise(F.col(f"`{f}`"))
                             for i, f in chunk})
        scored = predict(ex).groupBy("__rep", "__f").agg(
            F.sum((F.col(y).cast("double") - F.col("prediction")) ** 2).alias("sse"))
        for r in scored.collect():
            drops[features[r["__f"]]].append(r2_base - (1.0 - r["sse"] / sst))
    paired.unpersist()
    test.unpersist()
    return r2_base, _importances(features, drops)


def _importances(features, drops: dict) -> list:
    """(feature, mean, population std) of the drops, the largest mean first."""
    rows = []
    for f in features:
        v = drops[f]
        m = sum(v) / len(v)
        rows.append((f, m, math.sqrt(sum((x - m) ** 2 for x in v) / len(v))))
    return sorted(rows, key=lambda t: (-t[1], t[0]))


def linear_importance(test: DataFrame, key: str, coefs: dict, y: str, prediction, repeats: int = 5, seed: int = 42):
    """The same for a linear model, without copies of the rows: permuting column x
    with coefficient b changes a residual e into e + b (x - x'), so the new sum of
    squares of every feature comes from one pass over the pairs."""
    features = list(coefs)
    test = test.select(key, (F.col(y) - prediction).alias("__e"), F.col(y).cast("double").alias("__y"),
                       *[F.col(f"`{f}`").cast("double").alias(f"__x_{i}") for i, f in enumerate(features)])
    test = test.persist(StorageLevel.MEMORY_AND_DISK)
    b = test.agg(F.sum(F.col("__e") ** 2).alias("sse"), F.count(F.lit(1)).alias("n"), F.var_pop("__y").alias("v")).first()
    sst = b["v"] * b["n"]
    donors = permutation_donors_many(test, key, [seed + r for r in range(repeats)])
    given = test.select(F.col(key).alias("donor_key"), *[F.col(f"__x_{i}").alias(f"__d_{i}") for i in range(len(features))])
    paired = test.drop("__y").join(donors, key).join(given, "donor_key")
    sums = paired.groupBy("__rep").agg(*[
        F.sum((F.col("__e") + F.lit(float(coefs[f])) * (F.col(f"__x_{i}") - F.col(f"__d_{i}"))) ** 2).alias(f"s{i}")
        for i, f in enumerate(features)]).collect()
    test.unpersist()
    rows = []
    for i, f in enumerate(features):
        v = [(r[f"s{i}"] - b["sse"]) / sst for r in sums]
        m = sum(v) / len(v)
        rows.append((f, m, math.sqrt(sum((x - m) ** 2 for x in v) / len(v))))
    return 1.0 - b["sse"] / sst, sorted(rows, key=lambda t: (-t[1], t[0]))
