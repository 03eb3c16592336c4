"""Exact, interpolated quantiles in two passes.

Pass 1 is one aggregate over all columns: row counts, extremes and a mergeable
quantile sketch, whose rank error is known.  A sketch value some errors below
the wanted rank and one as far above it enclose the value at that rank.

Pass 2 counts, for every column at once, the rows below each such window and
the values inside it; a window holds a few ten-thousandths of the rows.  The
value at the wanted rank is read from the counts.  The counts also prove the
window: should a rank lie outside it, or a window hold more values than the
driver takes, the column is searched by repeated histograms instead
(``ranked_values``), whose result is at most ranks x ``BINS`` rows a pass.

A value with a third of all rows is one counter in every pass.  Interpolation
follows the linear rule used by pandas/NumPy and DuckDB.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256
ACCURACY = 10_000         # the sketch's rank error is rows / ACCURACY
MARGIN = 3                # a window reaches so many rank errors to both sides
WINDOW_VALUES = 200_000   # distinct values that the driver takes from all windows


def _values(df: DataFrame, cols):
    """One column ``v<i>`` for each of ``cols``: doubles, NaN as missing."""
    def number(c):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)
    return df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(cols)])


def ranked_values(df: DataFrame, wanted: dict, bins: int = BINS) -> dict:
    """{(ci, rank): value} of (ci, v) for ``wanted`` = {ci: (ranks, low, high)}; ranks count from 0.

    A pass counts the rows of every column in ``bins`` equal bins between the
    bounds of each wanted rank, with the smallest and largest value of each bin;
    the bin that holds the rank bounds the next pass, until its values are equal."""
    spark = df.sparkSession
    found, open_ = {}, {}
    for ci, (ranks, low, high) in wanted.items():
        for r in ranks:
            if low == high:
                found[ci, r] = low
            else:
                open_[ci, r] = (low, high, 0)  # bounds, and how many rows lie below them
    while open_:
        spans = sorted({(ci, lo, hi, below) for (ci, _), (lo, hi, below) in open_.items()})
        table = spark.createDataFrame([(i, ci, lo, hi) for i, (ci, lo, hi, _) in enumerate(spans)],
                                      "span int, sci int, lo double, hi double")
        # halves keep the width finite; the last bin takes the upper bound
        at = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins).cast("int")
        met = df.join(F.broadcast(table), (F.col("ci") == F.col("sci")) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = (met.withColumn("bin", F.least(at, F.lit(bins - 1))).groupBy("span", "bin")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        by = {}
        for c in sorted(counts, key=lambda c: (c["span"], c["bin"])):
            by.setdefault(spans[c["span"]], []).append(c)
        still = {}
        for (ci, r), (lo, hi, below) in open_.items():
            at_ = below
            for c in by[ci, lo, hi, below]:
                if r < at_ + c["n"]:
                    if c["lo"] == c["hi"]:
                        found[ci, r] = c["lo"]
                    else:
                        still[ci, r] = (c["lo"], c["hi"], at_)
                    break
                at_ += c["n"]
        open_ = still
    return found


def _sketch(values: DataFrame, probs: dict, accuracy: int) -> dict:
    """Pass 1: {column: (rows, min, max, [(low, high) for each prob])}."""
    error = MARGIN / accuracy
    aggs = []
    for i, ps in probs.items():
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        ends = [x for p in ps for x in (max(0.0, p - error), min(1.0, p + error))]
        if ends:
            aggs.append(F.percentile_approx(v, ends, accuracy).alias(f"s{i}"))
    row = values.agg(*aggs).first()
    out = {}
    for i, ps in probs.items():
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        ends = (row[f"s{i}"] if ps else None) or []
        # the ends of the range are exact
        out[i] = (row[f"n{i}"], lo, hi, [(lo if p <= error else a, hi if p >= 1 - error else b)
                                         for p, a, b in zip(ps, ends[::2], ends[1::2])])
    return out


def _window_counts(values: DataFrame, k: int, windows: list) -> tuple[list, list] | None:
    """Pass 2 for windows (column, low, high): (rows below each, {value: rows} of each), or None if too many values.

    A task sorts each column of a batch and finds all windows in it; it hands on one count for each window and
    one for each value inside."""
    by_column = {}
    for w, (i, lo, hi) in enumerate(windows):
        by_column.setdefault(i, []).append((w, lo, hi))

    def count(batches):
        under, held = np.zeros(len(windows), "i8"), [[] for _ in windows]

        def merge(w):
            v, n = (np.concatenate(x) for x in zip(*held[w]))
            v, at = np.unique(v, return_inverse=True)
            held[w] = [(v, np.bincount(at, weights=n).astype("i8"))]

        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for i, mine in by_column.items():
                x = np.sort(rows[:, i])  # NaN comes last
                x = x[:np.searchsorted(x, np.nan)]
                for w, lo, hi in mine:
                    a, b = np.searchsorted(x, lo, "left"), np.searchsorted(x, hi, "right")
                    under[w] += a
                    if b > a:
                        held[w].append(np.unique(x[a:b], return_counts=True))
                        if len(held[w]) >= 64:
                            merge(w)
        for w in range(len(windows)):
            if held[w]:
                merge(w)
            v, n = held[w][0] if held[w] else (np.zeros(0), np.zeros(0, "i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w] * (len(v) + 1), pa.int32()), pa.array([None, *v.tolist()], pa.float64()),
                 pa.array([int(under[w]), *n.tolist()], pa.int64())], names=["w", "v", "n"])

    missing = F.lit(float("nan"))
    rows = values.select(F.array(*[F.coalesce(F.col(f"v{i}"), missing) for i in range(k)]))
    counted = rows.mapInArrow(count, "w int, v double, n bigint").groupBy("w", "v").agg(F.sum("n").alias("n"))
    most = WINDOW_VALUES + len(windows)
    found = counted.limit(most + 1).collect()
    if len(found) > most:
        return None
    under, held = [0] * len(windows), [{} for _ in windows]
    for r in found:
        if r["v"] is None:
            under[r["w"]] = r["n"]
        else:
            held[r["w"]][r["v"]] = r["n"]
    return under, held


def _at_ranks(under: int, held: dict, ranks) -> dict | None:
    """{rank: value}, or None if a rank lies outside the window."""
    out, at, todo = {}, under, sorted(set(ranks))
    if todo and todo[0] < under:
        return None
    for v in sorted(held):
        at += held[v]
        while todo and todo[0] < at:
            out[todo.pop(0)] = v
    return None if todo else out


def exact_quantiles(df: DataFrame, cols, probs, bins: int = BINS, accuracy: int = ACCURACY) -> dict:
    """{column: [q(p) for p in probs]} (None for an all-null column).

    ``probs`` is one list for all columns, or {column: list}; ``bins`` is for the columns that need histograms."""
    cols = list(cols)
    if not cols:
        return {}
    asked = {i: [float(p) for p in (probs[c] if isinstance(probs, dict) else probs)] for i, c in enumerate(cols)}
    values = _values(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sketch = _sketch(values, {i: [p for p in ps if 0 < p < 1] for i, ps in asked.items()}, accuracy)
        found = {}  # (column, rank): value
        windows, ranks = [], []
        for i, ps in asked.items():
            n, lo, hi, bounds = sketch[i]
            if not n:
                continue
            found[i, 0], found[i, n - 1] = lo, hi
            for p, (a, b) in zip([p for p in ps if 0 < p < 1], bounds):
                wanted = {math.floor((n - 1) * p), math.ceil((n - 1) * p)}
                if a == b and (lo == hi):
                    found.update({(i, r): a for r in wanted})
                elif not all((i, r) in found for r in wanted):
                    windows.append((i, a, b))
                    ranks.append(wanted)
        counts = _window_counts(values, len(cols), windows) if windows else None
        missed = {}
        for w, ((i, _, _), wanted) in enumerate(zip(windows, ranks)):
            got = counts and _at_ranks(counts[0][w], counts[1][w], wanted)
            if got:
                found.update({(i, r): v for r, v in got.items()})
            else:
                missed.setdefault(i, set()).update(wanted)
        if missed:
            stacked = values.select(F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(cols))])).alias("ci", "v")) \
                            .where(F.col("v").isNotNull() & F.col("ci").isin(*missed))
            found.update(ranked_values(stacked, {i: (sorted(r), sketch[i][1], sketch[i][2]) for i, r in missed.items()}, bins))
    finally:
        values.unpersist()
    out = {}
    for i, c in enumerate(cols):
        n = sketch[i][0]
        out[c] = []
        for p in asked[i]:
            at = (n - 1) * p
            if n:
                low, high = found[i, math.floor(at)], found[i, math.ceil(at)]
                out[c].append(low + (high - low) * (at - math.floor(at)))
            else:
                out[c].append(None)
    return out


def medians(df: DataFrame, cols) -> dict:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def median_fill(df: DataFrame, cols, exclude=()) -> DataFrame:
    """Fill NULLs in each column with that column's exact median."""
    cols = [c for c in cols if c not in set(exclude)]
    med = medians(df, cols)
    fills = {c: F.coalesce(F.col(c), F.lit(med[c])) for c in cols if med.get(c) is not None}
    return df.withColumns(fills) if fills else df
