"""Hard-negative mining by coordinate pruning over length buckets.

Components become ``floor(256 x)``; a score is the integer inner product.

Index.  Rows are ordered by label and falling length and cut into buckets of
``BUCKET_VALUES`` components.  A bucket keeps its greatest length and, for every
coordinate, the list of its rows sorted by that coordinate of the row scaled to
length 1.  Every row is in one bucket.

Search.  A row reaches score t > 0 with anchor q only if its cosine is at least
t / (length of q x greatest length of the bucket).  A bucket where that is above 1
is passed over.  Otherwise each of the anchor's ``FOCUS`` largest coordinates gives
the range in which that coordinate of such a row must lie; the ranges are cut from
the sorted lists, the rows found in all of them are the candidates, and their scores
are computed exactly.  Without a positive bound all rows are candidates.

1. Each anchor searches the bucket of its label's longest rows; the score of its
   k-th best there bounds what the other buckets of its label have to reach.
2. The best k of all buckets of its label are its positives.
3. For every positive of score p, all buckets are searched for rows of other labels
   with scores from 80 % of p up to p.

An anchor block and a bucket meet in one task at a time, whatever the labels' sizes;
anchors are dealt in blocks of ``ANCHORS``.  Pairs of blocks grow with the product of
rows and anchors, as the task does; only pairs of blocks with a label in common
meet in steps 1 and 2.

Defined results
* rows with a null id or label, a null vector, or a null or non-finite component take no
  part; nor do rows whose number of components is not the most frequent one (the smaller
  of equally frequent ones), nor rows with a squared length above 2^62, whose scores would not fit;
* ties go to the smaller id; exact repeats of a row are one row; rows that repeat an id
  otherwise are rows each, and none is compared with an anchor of its id; each of them
  is an anchor if its id is one;
* fewer rows than k: all of them; a positive score below 0 leaves no negative;
* zero vectors score 0; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256.0
BUCKET_VALUES = 262_144  # components of a bucket: 4,096 rows of 64
ANCHORS = 2_048  # anchors of a block
FOCUS = 5
EASE = 1e-5  # ranges are this much wider than computed, for rounding
EXACT = 2.0**53  # below this, sums of products are exact in double precision

_BLOCK = ("block bigint, labels array<struct<label: bigint, rows: int>>, n int, longest double, ids binary, of binary, "
          "vectors binary, members binary, points binary")
_FOUND = "block bigint, slot int, anchor_id bigint, place int, bucket bigint, at int, id bigint, score bigint"


def prepared(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, label, v, sq): the integer vectors that take part with their squared length; and their dimension."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("x"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite))
    sq = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    whole = (rows.select("id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
             .withColumn("sq", sq).where(F.col("sq") <= 2.0**62))
    sizes = whole.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    return whole.where(F.size("v") == dim).distinct(), dim


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def blocks(rows: DataFrame, dim: int, size: int, lists: bool) -> DataFrame:
    """Rows (id, label, v, sq) as blocks of ``size`` by label and falling length; with ``lists``, the sorted
    coordinate lists of each."""

    def block(number: int, part: pa.Table) -> pa.RecordBatch:
        v = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        length = np.sqrt((v.astype("f8") ** 2).sum(1))
        members = points = b""
        if lists:
            unit = (v / np.where(length > 0, length, 1)[:, None]).T
            order = np.argsort(unit, axis=1, kind="stable")
            members, points = order.astype("<i4").tobytes(), np.take_along_axis(unit, order, 1).astype("<f4").tobytes()
        of = part["label"].to_numpy()
        return pa.RecordBatch.from_pylist([{
            "block": number, "labels": [{"label": x, "rows": n} for x, n in zip(*(c.tolist() for c in np.unique(of, return_counts=True)))],
            "n": len(v), "longest": float(length.max()),
            "ids": part["id"].to_numpy().astype("<i8").tobytes(), "of": of.astype("<i8").tobytes(),
            "vectors": v.astype("<i8").tobytes(), "members": members, "points": points}], schema)

    schema = pa.schema([("block", pa.int64()), ("labels", pa.list_(pa.struct([("label", pa.int64()), ("rows", pa.int32())]))), ("n", pa.int32()), ("longest", pa.float64()),
                        *[(c, pa.binary()) for c in ("ids", "of", "vectors", "members", "points")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                n += held[-1].num_rows
                if n >= size:
                    whole = pa.Table.from_batches(held)
                    yield block(number, whole.slice(0, size))
                    number, n = number + 1, n - size
                    held = whole.slice(size).to_batches()
        if n:
            yield block(number, pa.Table.from_batches(held))

    parts = max(1, -(-rows.count() // (8 * size)))
    # the id at the end spreads equal lengths over the ranges
    order = ["label", F.desc("sq"), "id"]
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("id", "label", "v").mapInArrow(run, _BLOCK))


class Bucket:
    """A bucket as a task holds it."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.of = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["of"], "<i8")
        self.vectors, self.longest = _matrix(row["vectors"], dim), row["longest"]
        self.members = np.frombuffer(row["members"], "<i4").reshape(dim, -1)
        self.points = np.frombuffer(row["points"], "<f4").reshape(dim, -1)
        self.floats = self.vectors.astype("f8") if self.longest ** 2 < EXACT else None

    def feasible(self, unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For anchors scaled to length 1 and the cosines they need: focus coordinates, and the first and the
        end place of each one's feasible range in its sorted list."""
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        q = np.take_along_axis(unit, focus, 1)
        c = cosine[:, None]
        # with angles: the coordinate's own angle, give or take the angle that the cosine allows
        side = np.sqrt(np.maximum(0, (1 - c * c) * (1 - q * q)))
        low = np.where(-q >= c, -1.0, q * c - side) - EASE
        high = np.where(q >= c, 1.0, q * c + side) + EASE
        first, end = np.empty(focus.shape, "i8"), np.empty(focus.shape, "i8")
        for f in np.unique(focus):
            here = focus == f
            first[here] = np.searchsorted(self.points[f], low[here], "left")
            end[here] = np.searchsorted(self.points[f], high[here], "right")
        return focus, first, end

    def candidates(self, focus: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rows in all ranges."""
        if (end - first == len(self.ids)).all():
            return np.arange(len(self.ids))
        seen = np.zeros(len(self.ids), "u1")
        for f, a, b in zip(focus, first, end):
            seen[self.members[f, a:b]] += 1
        return np.flatnonzero(seen == len(focus))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.floats is not None and (anchor.astype("f8") ** 2).sum() < EXACT:
            q = anchor.astype("f8")
            found = (self.floats @ q)[rows] if 4 * len(rows) > len(self.ids) else self.floats[rows] @ q
            return found.astype("i8")
        return self.vectors[rows] @ anchor  # wraps, and the sum fits: right in 64 bits


def _best(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` by falling score, then id."""
    if len(scores) > 8 * k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _search(bucket: Bucket, anchors: dict, dim: int, bounds: list[list[tuple[int, int]]], same: bool, k: int) -> list[tuple]:
    """(slot, place, id, score) of the first ``k`` rows of the bucket for each (low, high) of each anchor's bounds,
    both included, among the rows of its label (``same``) or of other labels."""
    v, ids, of = _matrix(anchors["vectors"], dim), np.frombuffer(anchors["ids"], "<i8"), np.frombuffer(anchors["of"], "<i8")
    length = np.sqrt((v.astype("f8") ** 2).sum(1))
    least = np.array([min((low for low, _ in b), default=2**62) for b in bounds], "f8")
    reach = length * bucket.longest
    asked = np.array([len(b) > 0 for b in bounds])
    here = np.flatnonzero(asked & ((least <= 0) | (least <= reach * (1 + EASE))))
    cosine = np.where(least[here] > 0, least[here] / np.where(reach[here] > 0, reach[here], 1), -1.0).clip(-1, 1)
    focus, first, end = bucket.feasible(v[here] / np.where(length[here] > 0, length[here], 1)[:, None], cosine)
    out = []
    for j, s in enumerate(here.tolist()):
        rows = bucket.candidates(focus[j], first[j], end[j]) if cosine[j] > -1 else np.arange(len(bucket.ids))
        rows = rows[((bucket.of[rows] == of[s]) == same) & (bucket.ids[rows] != ids[s])]
        if not len(rows):
            continue
        scores = bucket.scores(rows, v[s])
        for place, (low, high) in enumerate(bounds[s]):
            fit = np.flatnonzero((scores >= low) & (scores <= high))
            best = fit[_best(k, scores[fit], bucket.ids[rows[fit]])]
            out += [(s, place, int(ids[s]), int(rows[b]), int(bucket.ids[rows[b]]), int(scores[b])) for b in best]
    return out


def _met(pairs: DataFrame, index: DataFrame, anchors: DataFrame, dim: int, k: int, same: bool,
         bounds_of: Callable[[dict, int], list]) -> DataFrame:
    """The search of each pair (bucket, block); ``anchors`` may carry ``known``, what is known of each slot."""
    left = index.withColumnRenamed("block", "bucket").join(pairs, "bucket")
    right = anchors.join(pairs, "block")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and two.num_rows:
            row, block = one.to_pylist()[0], two.to_pylist()[0]
            hits = _search(Bucket(row, dim), block, dim, bounds_of(block, k), same, k)
            found = [(block["block"], s, i, place, row["bucket"], at, other, score) for s, place, i, at, other, score in hits]
        columns = list(zip(*found)) if found else [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(_FOUND.split(", "), columns, kinds)})

    return left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(run, _FOUND)


def _known(found: DataFrame) -> DataFrame:
    """For each anchor block what was found for its slots: at most k rows a slot."""
    return found.groupBy("block").agg(F.collect_list(F.struct("slot", "rank", "score")).alias("known"))


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "bucket", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _from_known(low_share: int) -> Callable[[dict, int], list]:
    """Bounds for negatives: from ``low_share`` % of each positive score up to that score."""

    def bounds(block: dict, k: int) -> list:
        out: list[list] = [[] for _ in range(block["n"])]
        for x in sorted(block["known"], key=lambda x: (x["slot"], x["rank"])):
            out[x["slot"]].append((-(-low_share * x["score"] // 100), x["score"]))
        return out

    return bounds


def _any(block: dict, k: int) -> list:
    return [[(-(2**63), 2**63 - 1)]] * block["n"]


def _kth(block: dict, k: int) -> list:
    """What a positive in another bucket has to reach: the k-th best score so far."""
    got: dict[int, list] = {}
    for x in block["known"] or []:
        got.setdefault(x["slot"], []).append(x["score"])
    return [[(min(got[s]) if len(got.get(s, [])) >= k else -(2**63), 2**63 - 1)] for s in range(block["n"])]


def mine(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, is_anchor: Column, k: int = 5,
         low_share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``.  Negatives score from ``low_share`` % of the positive's score up to it."""
    rows, dim = prepared(vectors, id_col, label_col, vec_col)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, positive_rank int, rank int, "
                                                        "negative_id bigint, positive_score bigint, negative_score bigint")
    rows = written(rows, "negatives-rows")
    index = written(blocks(rows, dim, max(64, BUCKET_VALUES // dim), True), "negatives-index")
    anchors = written(blocks(rows.where(is_anchor), dim, ANCHORS, False), "negatives-anchors").drop("members", "points")

    # the buckets that hold an anchor block's labels, and of these the one with most rows of each label
    of_label = index.select(F.col("block").alias("bucket"), F.inline("labels"))
    first_of = of_label.groupBy("label").agg(F.max_by("bucket", F.struct("rows", -F.col("bucket"))).alias("bucket"))
    asked = anchors.select("block", F.inline("labels")).drop("rows")
    first = written(asked.join(first_of, "label").select("bucket", "block").distinct(), "negatives-first")

    slots = ["block", "slot", "anchor_id"]
    start = written(_first(_met(first, index, anchors, dim, k, True, _any), k, *slots), "negatives-start")
    rest = written(asked.join(of_label, "label").select("bucket", "block").distinct()
                   .join(first, ["bucket", "block"], "left_anti"), "negatives-rest")
    more = _met(rest, index, anchors.join(_known(start), "block", "left"), dim, k, True, _kth)
    positives = written(_first(start.drop("rank").unionByName(more), k, *slots), "negatives-positives")

    useful = positives.where("score >= 0")
    bounded = anchors.join(_known(useful), "block")
    # A bucket and a block meet if both are long enough for the block's least bound.  Lengths are joined by class,
    # the power of two below them: a block asks for all classes from the one that it needs.
    power = lambda c: F.floor(F.log2(F.greatest(c, F.lit(0.5)))).cast("int")
    classed = index.select(F.col("block").alias("bucket"), "longest", power(F.col("longest")).alias("class"))
    highest = classed.agg(F.max("class")).first()[0]
    least = useful.groupBy("block").agg((F.min(F.col("score").cast("double")) * (low_share / 100)).alias("least"))
    need = F.try_divide("least", F.col("tallest") * (1 + EASE))
    tall = (anchors.select("block", F.col("longest").alias("tallest")).join(least, "block")
            .withColumn("need", F.coalesce(need, F.lit(0.0))).withColumn("from", power(F.col("need"))))
    every = (classed.join(tall.where(F.col("from") <= highest).withColumn("class", F.explode(F.sequence("from", F.lit(highest)))), "class")
             .where("longest >= need").select("bucket", "block"))
    negatives = _first(_met(written(every, "negatives-every"), index, bounded, dim, k, False, _from_known(low_share)), k, *slots, "place")
    # the places of an anchor's positives follow their ranks
    named = useful.select("block", "slot", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (negatives.withColumn("positive_rank", F.col("place") + 1).join(named, ["block", "slot", "positive_rank"])
            .select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
