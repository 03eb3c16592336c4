"""The trees of MLlib's ``GBTRegressor`` for squared loss, grown from compact histograms.

MLlib starts a new fit for every tree, sends three numbers for every node and bin
of a level through a shuffle and can not go on from a fitted ensemble.  Here the
rows are binned once, into byte matrices of ``BLOCK`` rows that stay cached, and a
level of a tree is one small job: a task adds up counts and residuals by bin with
NumPy, for the smaller child of each split node only (its sibling is the rest of
the parent).  The residuals are a second cached table, renewed every few trees.
Held-out rows get residuals like the others, so their loss after every tree costs
nothing, and boosting ends where the rule of ``trees.best_iteration`` does.

As in MLlib: at most ``maxBins`` bins by the same rule from a sample of
max(maxBins^2, 10,000) rows, variance gain, ``minInstancesPerNode``, level by level
to ``maxDepth``, the first tree on the label with weight 1, the others on twice the
residual with weight ``stepSize``; no sampling of rows or columns.  Where all rows are
in the sample the trees are MLlib's own, to rounding.

Memory: a task has one block at a time and one histogram of a level; the driver
gets one such histogram of each task, summed in a tree beyond ``DIRECT_TASKS``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

BLOCK = 65_536      # rows of a binned block
ROWS_PER_TASK = 2 * BLOCK  # at least, as far as the rows' own tasks allow
DIRECT_TASKS = 24   # so many histograms go to the driver as they are
RENEW = 5           # trees after which residuals are kept anew; those since are taken off in every job
REBUILD = 25        # trees after which they are computed from the label again, which ends their lineage
EPSILON = 1e-12     # relative difference of two means that is rounding
SAME_GAIN = 1e-10   # relative difference of two gains that is rounding
MOST_BINS = 256     # of a byte


def thresholds(values: np.ndarray, most_bins: int) -> np.ndarray:
    """Split candidates of one column from its sampled values: midpoints of neighbours, all of them if they fit,
    else those nearest to equal shares of the rows (MLlib's rule)."""
    found, counts = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) <= most_bins - 1:
        return middle
    stride = len(values) / most_bins
    cuts, before, target = [], int(counts[0]), stride
    for i in range(1, len(found)):
        now = before + int(counts[i])
        if abs(before - target) < abs(now - target):
            cuts.append(middle[i - 1])
            target += stride
        before = now
    return np.array(cuts)


def route(bins, levels) -> np.ndarray:
    """The place of every row (an entry of each of ``bins``) in the level below the last one of ``levels``.  A level has a
    (feature, bin) for each place; larger bins go right, rows at a leaf (feature -1) go left."""
    at = np.zeros(len(bins[0]), np.min_scalar_type(2 ** len(levels)))
    for places in levels:
        right = np.zeros(len(at), bool)
        for p, (feature, cut) in enumerate(places):
            if feature >= 0:
                right |= (bins[feature] > cut) & (at == p)
        at = (at << 1) | right
    return at


def matrix(x: pa.Array, columns: int) -> np.ndarray:
    """The rows of an array of vectors."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def binned(x: np.ndarray, cuts) -> np.ndarray:
    """The bins of all rows, column by column."""
    return np.stack([np.searchsorted(c, x[:, f], side="left").astype(np.uint8) for f, c in enumerate(cuts)])


def predictions(bins, trees) -> np.ndarray:
    out = np.zeros(len(bins[0]))
    for levels, values in trees:
        out += np.take(values, route(bins, levels))
    return out


def residuals(bins: np.ndarray, rest: np.ndarray, trees) -> np.ndarray:
    """``rest`` less the trees (levels, values of the last level)."""
    rest = rest.copy()
    for levels, values in trees:
        rest -= np.take(values, route(bins, levels))
    return rest


def best_splits(counts: np.ndarray, sums: np.ndarray, min_leaf: int) -> list:
    """(feature, bin, rows and sum of the left child), or None, for each node of (node, feature, bin) histograms:
    the split of the largest variance gain, the first one of those that differ by rounding only."""
    nl, sl = counts.cumsum(2), sums.cumsum(2)
    n, s = nl[:, :, -1:], sl[:, :, -1:]
    nr, sr = n - nl, s - sl
    fits = (nl >= min_leaf) & (nr >= min_leaf)
    left, right = sl / np.maximum(nl, 1), sr / np.maximum(nr, 1)
    apart = left - right
    gain = np.where(fits & (np.abs(apart) > EPSILON * np.maximum(np.abs(left), np.abs(right))), nl * nr * apart ** 2, -1.0)
    out = []
    flat = gain.reshape(len(gain), -1)
    for node, place in enumerate((flat >= flat.max(1, keepdims=True) * (1 - SAME_GAIN)).argmax(1)):
        f, b = divmod(int(place), gain.shape[2])
        out.append((f, b, int(nl[node, f, b]), float(sl[node, f, b])) if gain[node, f, b] > 0 else None)
    return out


def _cached(rdd):
    """``rdd`` kept with one element a batch, so that two of them can be zipped."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


class Grower:
    """Grows trees on the rows of a DataFrame with a vector, a label and perhaps a column of held-out rows;
    ``grow`` goes on where it ended.  ``losses`` are the held-out rows' mean squares after every tree."""

    def __init__(self, data: DataFrame, features: str, label: str, held: str | None, max_bins: int, depth: int,
                 min_leaf: int, step: float, seed: int, ended=lambda losses: False):
        self.depth, self.min_leaf, self.step, self.ended = depth, min_leaf, step, ended
        self.trees, self.losses = [], []
        away = F.col(held) if held else F.lit(False)
        rows = data.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), away.alias("held"))
        size = rows.agg(F.count_if(~F.col("held")).alias("n"), F.count_if(F.col("held")).alias("held"),
                        F.max(F.size("x")).alias("columns")).first()
        if not size["n"]:
            raise ValueError("no training rows")
        self.rows, self.held, self.columns = size["n"], size["held"], size["columns"]
        self.cuts = self._thresholds(rows.where(~F.col("held")).select("x"), min(max_bins, MOST_BINS, self.rows), seed)
        starts = np.cumsum([0, *(len(c) + 1 for c in self.cuts)])
        self.starts = starts.tolist()
        width = int(np.diff(starts).max())
        # where the bins of all columns, one after the other, lie in a (column, bin) matrix
        self.shape = (self.columns, width)
        self.spread = np.concatenate([np.arange(b - a) + i * width for i, (a, b) in enumerate(zip(starts[:-1], starts[1:]))])
        # a level is a short job, much of it the start of its tasks
        self.blocks = _cached(self._binned(rows.coalesce((self.rows + self.held) // ROWS_PER_TASK + 1)))
        self.blocks.checkpoint()  # else every job's tasks carry the plan behind the rows
        self.tasks = self.blocks.getNumPartitions()
        self.root_counts = self._sum(self.blocks.mapPartitions(self._count_job()))
        self.state = self.root_sums = None
        self.base = 0  # so many trees are in the kept residuals

    def _thresholds(self, rows: DataFrame, most_bins: int, seed: int) -> list[np.ndarray]:
        share = min(1.0, max(most_bins ** 2, 10_000) / self.rows)
        some = rows.sample(False, share, seed) if share < 1.0 else rows
        values = matrix(some.toArrow().column("x").combine_chunks(), self.columns)
        return [thresholds(values[:, f], most_bins) if len(values) else np.empty(0) for f in range(self.columns)]

    def _binned(self, rows: DataFrame):
        """(bins, label, number of training rows) of every block, training rows first."""
        cuts, columns = self.cuts, self.columns

        def block(batches):
            t = pa.Table.from_batches(batches)
            x = matrix(t.column("x").combine_chunks(), columns)
            y = t.column("y").to_numpy()
            if not (np.isfinite(y).all() and np.isfinite(x).all()):
                raise ValueError("labels and predictors must be finite numbers")
            held = t.column("held").to_numpy()
            order = np.argsort(held, kind="stable")
            bins = binned(x[order], cuts)
            return pa.RecordBatch.from_pylist([{"bins": bins.tobytes(), "y": y[order].astype("f8").tobytes(), "n": int(len(y) - held.sum())}], schema=schema)

        def blocks(batches):
            kept, n = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    if n + part.num_rows > BLOCK:
                        yield block(kept)
                        kept, n = [], 0
                    kept.append(part)
                    n += part.num_rows
            if n:
                yield block(kept)

        def arrays(rows):
            for r in rows:
                yield np.frombuffer(r[0], np.uint8).reshape(columns, -1), np.frombuffer(r[1], "f8"), r[2]

        schema = pa.schema([("bins", pa.binary()), ("y", pa.binary()), ("n", pa.int64())])
        return rows.mapInArrow(blocks, "bins binary, y binary, n bigint").rdd.mapPartitions(arrays, preservesPartitioning=True)

    def _sum(self, parts) -> np.ndarray:
        """The sum of the arrays of all tasks."""
        if self.tasks > DIRECT_TASKS:
            return parts.treeReduce(np.add, 2)
        return np.add.reduce(parts.collect())

    def _count_job(self):
        starts = self.starts

        def count(blocks):
            out = np.zeros(starts[-1])
            for bins, _, n in blocks:
                for f, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    out[a:b] += np.bincount(bins[f, :n], minlength=b - a)
            yield out
        return count

    def _renew(self) -> None:
        """The next root's sums, and the loss of the last tree; every ``RENEW`` trees new residuals are kept."""
        starts, before, done = self.starts, None, len(self.trees)
        if self.state is None or done - self.base == RENEW:
            anew, before = self.state is None or done % REBUILD == 0, self.state
            trees = self.trees if anew else self.trees[self.base:]

            def renew(blocks):
                for (bins, y, _), rest in ((b, b[1]) for b in blocks) if anew else blocks:
                    yield residuals(bins, rest, trees)

            kept = self.blocks if anew else self.blocks.zip(before)
            self.state, self.base = _cached(kept.mapPartitions(renew, preservesPartitioning=True)), done
        recent = self.trees[self.base:]

        def total(both):
            out = np.zeros(starts[-1] + 1)
            for (bins, _, n), rest in both:
                rest = residuals(bins, rest, recent)
                for f, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    out[a:b] += np.bincount(bins[f, :n], rest[:n], b - a)
                out[-1] += rest[n:] @ rest[n:]
            yield out

        found = self._sum(self.blocks.zip(self.state).mapPartitions(total))
        if before is not None:
            before.unpersist()
        self.root_sums = found[:-1]
        if self.held and self.trees:
            self.losses.append(found[-1] / self.held)

    def _level_sums(self, levels, slots) -> np.ndarray:
        """Counts and sums, (2, slot, bin), of the places below ``levels`` that have a slot."""
        starts, k, recent = self.starts, int(slots.max()) + 1, self.trees[self.base:]

        def sums(both):
            out = np.zeros((2, k, starts[-1]))
            for (bins, _, n), rest in both:
                bins = bins[:, :n]
                slot = np.take(slots, route(bins, levels))
                rows = np.flatnonzero(slot >= 0)
                slot, weight = slot[rows], residuals(bins, rest[:n], recent)[rows]
                for f, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    if b - a > 1:
                        at = slot * (b - a) + np.take(bins[f], rows)
                        out[0, :, a:b] += np.bincount(at, minlength=k * (b - a)).reshape(k, -1)
                        out[1, :, a:b] += np.bincount(at, weight, k * (b - a)).reshape(k, -1)
                    else:  # a column of one value
                        out[0, :, a] += np.bincount(slot, minlength=k)
                        out[1, :, a] += np.bincount(slot, weight, k)
            yield out

        return self._sum(self.blocks.zip(self.state).mapPartitions(sums))

    def _matrix(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flat), self.shape[0] * self.shape[1]))
        out[:, self.spread] = flat
        return out.reshape(-1, *self.shape)

    def _tree(self):
        """The next tree: its levels, and (rows, sum) of the places of the level below them."""
        counts, sums = {0: self.root_counts}, {0: self.root_sums}
        first = slice(self.starts[0], self.starts[1])
        sizes = {0: (int(counts[0][first].sum()), float(sums[0][first].sum()))}
        levels = []
        for depth in range(self.depth):
            open_ = [p for p in sorted(counts) if sizes[p][0] >= 2 * self.min_leaf]
            found = best_splits(self._matrix(np.stack([counts[p] for p in open_])),
                                self._matrix(np.stack([sums[p] for p in open_])), self.min_leaf) if open_ else []
            split = {p: s for p, s in zip(open_, found) if s}
            if not split:
                break
            levels.append([split[p][:2] if p in split else (-1, 0) for p in range(2 ** depth)])
            below = {}
            for p, (n, s) in sizes.items():
                below[2 * p] = split[p][2:] if p in split else (n, s)
                if p in split:
                    below[2 * p + 1] = (n - split[p][2], s - split[p][3])
            sizes = below
            if depth + 1 == self.depth:
                break
            slots, small = np.full(2 ** (depth + 1), -1), []
            for p in split:
                if max(below[2 * p][0], below[2 * p + 1][0]) >= 2 * self.min_leaf:
                    less = 2 * p + (below[2 * p][0] > below[2 * p + 1][0])
                    slots[less] = len(small)
                    small.append(less)
            if not small:
                break
            got = self._level_sums(levels, slots)
            upper = counts, sums
            counts, sums = ({p: got[which][i] for i, p in enumerate(small)} for which in range(2))
            for p in small:
                counts[p ^ 1], sums[p ^ 1] = upper[0][p // 2] - counts[p], upper[1][p // 2] - sums[p]
        return levels, sizes

    def grow(self, most: int) -> None:
        """Trees up to ``most`` in all, fewer if boosting ends."""
        while len(self.trees) < most and not self.ended(self.losses):
            if self.state is None:
                self._renew()
            levels, sizes = self._tree()
            scale = 2.0 * self.step if self.trees else 1.0
            values = np.zeros(2 ** len(levels))
            for p, (n, s) in sizes.items():
                values[p] = scale * s / n
            self.trees.append((levels, values))
            self._renew()

    def close(self) -> None:
        at = self.blocks.getCheckpointFile()
        if at:
            sc = self.blocks.context
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        self.blocks.unpersist()
        if self.state is not None:
            self.state.unpersist()


class HistogramBoostingModel(Model, HasFeaturesCol, HasPredictionCol):
    """Trees (levels, values) over the bins of ``cuts``; the prediction of a row is the sum of its values."""

    def __init__(self, cuts, trees):
        super().__init__()
        self.cuts, self.trees = cuts, trees

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def first(self, n: int) -> HistogramBoostingModel:
        """The ensemble of the first ``n`` trees."""
        return self._copyValues(HistogramBoostingModel(self.cuts, self.trees[:n]))

    def codes(self, features: Column) -> Column:
        """The bins of a row's features, a byte each."""
        cuts = self.cuts

        def coded(x: pa.Array) -> pa.Array:
            rows = np.ascontiguousarray(binned(matrix(x, len(cuts)), cuts).T)
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(cuts)), len(x), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())

        return F.arrow_udf(coded, "binary")(vector_to_array(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, trees = self.cuts, self.trees

        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(predictions(binned(matrix(x, len(cuts)), cuts), trees))

        return dataset.withColumn(self.getPredictionCol(), F.arrow_udf(predicted, "double")(vector_to_array(F.col(self.getFeaturesCol()))))

    def swapped_losses(self, pairs: DataFrame, groups: list[list[int]]) -> dict:
        """{(rep, i): sum of squares} of ``pairs`` (rep, y, code, given), when the columns of ``groups[i]`` have the
        values of ``given``.  Only trees that split on one of them are evaluated again."""
        trees, columns = self.trees, len(self.cuts)
        used = [[i for i, g in enumerate(groups) if {f for level in levels for f, _ in level} & set(g)] for levels, _ in trees]

        def losses(batches):
            sums = {}
            for batch in batches:
                rep, y = batch.column("rep").to_numpy(), batch.column("y").to_numpy()
                code, given = (np.ascontiguousarray(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, columns).T)
                               for c in ("code", "given"))
                base, moved = np.zeros(len(y)), np.zeros((len(groups), len(y)))
                for (levels, values), which in zip(trees, used):
                    own = np.take(values, route(code, levels))
                    base += own
                    for i in which:
                        rows = list(code)
                        for f in groups[i]:
                            rows[f] = given[f]
                        moved[i] += np.take(values, route(rows, levels)) - own
                for r in np.unique(rep).tolist():
                    at = rep == r
                    wrong = y[at] - base[at]
                    sums[r] = sums.get(r, 0.0) + ((wrong - moved[:, at]) ** 2).sum(1)
            for r, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total)],
                                                 names=["rep", "i", "sse"])

        rows = pairs.select(F.col("rep").cast("int").alias("rep"), F.col("y").cast("double").alias("y"), "code", "given")
        found = rows.mapInArrow(losses, "rep int, i int, sse double").groupBy("rep", "i").agg(F.sum("sse").alias("sse"))
        return {(r["rep"], r["i"]): r["sse"] for r in found.collect()}


class HistogramBoosting(GBTRegressor):
    """``GBTRegressor`` for squared loss that grows its trees with a ``Grower``.

    ``start(held, ended, grower)`` names a boolean column of rows that train no tree, gives the rule by which their
    losses end boosting, or a grower whose trees come first; ``grower`` has it after a fit, to be closed."""

    held, ended, grower = None, staticmethod(lambda losses: False), None

    def start(self, held: str | None = None, ended=None, grower: Grower | None = None) -> HistogramBoosting:
        self.held, self.ended, self.grower = held, ended or self.ended, grower
        return self

    def _fit(self, dataset: DataFrame):
        if self.getLossType() != "squared" or self.getSubsamplingRate() < 1.0:
            raise ValueError("squared loss on all rows only")
        if self.grower is None:
            self.grower = Grower(dataset, self.getFeaturesCol(), self.getLabelCol(), self.held, self.getMaxBins(), self.getMaxDepth(),
                                 self.getMinInstancesPerNode(), self.getStepSize(), self.getSeed(), self.ended)
        self.grower.grow(self.getMaxIter())
        return self._copyValues(HistogramBoostingModel(self.grower.cuts, list(self.grower.trees)))
