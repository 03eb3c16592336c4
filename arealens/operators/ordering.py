"""Order-dependent operators without a single-partition global window.

A global order over columns of any orderable types is cut into ranges at keys
drawn from a sample of the rows.  The cut keys become literals, so a row's
range (bucket) is a pure function of its key and recomputation after a lost
executor gives the same buckets.  Cuts compare all order columns, so rows that
tie in the first one are spread too.  Each bucket is sorted in its own task
(window partitioned by bucket); per-bucket totals -- one small row per bucket --
give the offsets.

Used for: positions (ranks) in a global order, running counts, keys at given
ranks, the Durbin-Watson statistic, deterministic permutations, splits and folds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

ROWS_PER_BUCKET = 1_000_000
SAMPLE_PER_BUCKET = 64  # sampled keys for each bucket
RANK_ROWS = 20_000      # rows of one bucket that the driver takes to read keys at ranks
MOST_BUCKETS = 4_096
HASH_RANGE = 1000033  # perm_hash values lie in [0, HASH_RANGE)


def _literal(df: DataFrame, names, key) -> Column:
    """The key as a struct literal of the columns' types."""
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(f"k{i}") for i, (c, v) in enumerate(zip(names, key))])


def _struct(names) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])


def sampled_cuts(df: DataFrame, order_cols, n: int, buckets: int) -> list:
    """At most ``buckets`` - 1 keys (tuples) that cut the order into ranges of about equal size; ``df`` has n rows."""
    if buckets <= 1 or not n:
        return []
    want = SAMPLE_PER_BUCKET * buckets
    some = df.select(*order_cols)
    if n > 2 * want:
        some = some.sample(False, want / n, 11)
    keys = [tuple(r) for r in some.orderBy(*order_cols).collect()]
    return list(dict.fromkeys(keys[len(keys) * i // buckets] for i in range(1, buckets))) if keys else []


def add_bucket(df: DataFrame, order_cols, cuts, out: str = "__bucket") -> DataFrame:
    """The number of cuts at or before the row's key: found among the heads of blocks of cuts, then in a block."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    names = list(order_cols)[:len(cuts[0])]
    key = _struct(names)
    size = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i:i + size] for i in range(0, len(cuts), size)]
    until = lambda array, k: F.size(F.filter(array, lambda c: c <= k))
    heads = F.array(*[_literal(df, names, b[0]) for b in blocks])
    rests = F.array(*[F.array(*[_literal(df, names, c) for c in b]) for b in blocks])
    df = df.withColumn("__key", key).withColumn("__block", until(heads, F.col("__key")))
    inner = until(F.element_at(rests, F.col("__block")), F.col("__key"))
    return df.withColumn(out, F.when(F.col("__block") == 0, 0).otherwise((F.col("__block") - 1) * size + inner)).drop("__key", "__block")


def with_buckets(df: DataFrame, order_cols, n_buckets: int | None = None, n: int | None = None):
    n = df.count() if n is None else n
    nb = n_buckets or max(8, n // ROWS_PER_BUCKET + 1)
    return add_bucket(df, order_cols, sampled_cuts(df, order_cols, n, nb)), n


def keys_at_ranks(df: DataFrame, order_cols, ranks, n: int | None = None) -> dict:
    """{rank: key (tuple)} for 0-based ranks in the order of the columns.

    The counts of the buckets tell which bucket holds a rank; a bucket of more than ``RANK_ROWS`` rows is
    divided again, so the driver takes few rows whatever the input."""
    order_cols, ranks = list(order_cols), sorted(set(ranks))
    n = df.count() if n is None else n
    if not ranks:
        return {}
    rows = df.select(*order_cols)
    if n <= RANK_ROWS:
        keys = rows.orderBy(*order_cols).collect()
        return {r: tuple(keys[r]) for r in ranks}
    ends = rows.agg(F.min(_struct(order_cols)).alias("lo"), F.max(_struct(order_cols)).alias("hi")).first()
    if ends["lo"] == ends["hi"]:
        return {r: tuple(ends["lo"]) for r in ranks}
    cuts = sampled_cuts(rows, order_cols, n, min(MOST_BUCKETS, 4 * n // RANK_ROWS + 1))
    placed = add_bucket(rows, order_cols, cuts)
    counts = dict(sorted((r["__bucket"], r["count"]) for r in placed.groupBy("__bucket").count().collect()))
    out, below = {}, 0
    for bucket, size in counts.items():
        mine = [r for r in ranks if below <= r < below + size]
        if mine:
            part = placed.where(F.col("__bucket") == bucket)
            if size == n:  # one key holds all but the ends: the cuts divide no further
                part = rows.where(_struct(order_cols) == _literal(df, order_cols, cuts[0]))
                inner = part.count()
                before = rows.where(_struct(order_cols) < _literal(df, order_cols, cuts[0])).count()
                held = {r: cuts[0] for r in mine if before <= r < before + inner}
                rest = rows.where(_struct(order_cols) != _literal(df, order_cols, cuts[0]))
                moved = {r - inner * (r >= before + inner): r for r in mine if r not in held}
                got = keys_at_ranks(rest, order_cols, list(moved), n - inner)
                out |= held | {moved[r]: k for r, k in got.items()}
            else:
                got = keys_at_ranks(part, order_cols, [r - below for r in mine], size)
                out |= {r + below: k for r, k in got.items()}
        below += size
    return out


def hash_bins(df: DataFrame, hash_col: str, key: str) -> tuple[DataFrame, dict]:
    """(hash, key and ``__bin`` of every row; {bin: rows} in order): ``MOST_BUCKETS`` equal ranges of the hash, found
    by arithmetic.  A null hash comes first, as in the order of the column."""
    h = F.col(hash_col).cast("bigint")
    at = F.coalesce(F.call_function("div", h * MOST_BUCKETS, F.lit(HASH_RANGE)), F.lit(-1)).cast("int")
    placed = df.select(hash_col, key, at.alias("__bin"))
    return placed, dict(sorted((r["__bin"], r["count"]) for r in placed.groupBy("__bin").count().collect()))


def keys_at_hash_ranks(placed: DataFrame, counts: dict, hash_col: str, key: str, ranks) -> dict:
    """``keys_at_ranks`` in the order of a seeded hash and the key, for the rows of ``hash_bins``.

    One pass takes the rows of all bins that hold a rank; a bin of more than ``RANK_ROWS`` rows is divided again."""
    out, below, few = {}, 0, []
    for b, size in counts.items():
        mine = [r for r in ranks if below <= r < below + size]
        if mine and size <= RANK_ROWS:
            few.append((b, below, size, mine))
        elif mine:
            got = keys_at_ranks(placed.where(F.col("__bin") == b), [hash_col, key], [r - below for r in mine], size)
            out |= {r + below: k for r, k in got.items()}
        below += size
    if few:
        part = placed.where(F.col("__bin").isin(*[f[0] for f in few])).select(hash_col, key)
        keys, at = [tuple(r) for r in part.repartition(1).sortWithinPartitions(hash_col, key).collect()], 0
        for _, start, size, mine in few:
            out |= {r: keys[at + r - start] for r in mine}
            at += size
    return out


def _offset_map(totals: dict, value_names):
    """Exclusive prefix over buckets in order -> literal map bucket -> offset."""
    out = {}
    for v in value_names:
        acc, m = 0, {}
        for b in sorted(totals):
            m[b] = acc
            acc += totals[b][v] or 0
        out[v] = m
    return out


def running_sums(df: DataFrame, order_cols, values: dict, n_buckets: int | None = None,
                 partition_cols=(), bucket: Column | None = None, n: int | None = None) -> DataFrame:
    """Add inclusive running sums of whole numbers over the global order ``order_cols``
    (separately within each ``partition_cols`` group, if given).

    ``values``: {new_name: Column} summed along the order (use F.lit(1) for a
    1-based position).  ``bucket`` may be given when the distribution of the first
    order columns is known, ``n`` when the number of rows is; the full order must be
    unique for a deterministic result."""
    parts = list(partition_cols)
    if bucket is None:
        b, _ = with_buckets(df, order_cols, n_buckets, n)
    else:
        b = df.withColumn("__bucket", bucket)
    b = b.withColumns({f"__v_{k}": v for k, v in values.items()})
    stride = 1 << 20
    gkey = F.col("__bucket").cast("bigint")
    if parts:
        gkey = F.col(parts[0]).cast("bigint") * F.lit(stride) + gkey
    b = b.withColumn("__g", gkey)
    rows = b.groupBy("__g").agg(*[F.sum(f"__v_{k}").alias(k) for k in values]).collect()
    groups = {}
    for r in rows:  # one row per (partition, bucket): small
        groups.setdefault(r["__g"] // stride if parts else 0, {})[r["__g"]] = r.asDict()
    offs = {k: {} for k in values}
    for _, tot in groups.items():
        o = _offset_map(tot, list(values))
        for k in values:
            offs[k].update(o[k])
    # one row for each bucket (and group): a table to look up, not a chain of cases
    table = b.sparkSession.createDataFrame(
        [(g, *[offs[k][g] for k in values]) for g in sorted(offs[next(iter(values))])],
        ", ".join(["__g bigint", *[f"__o_{k} bigint" for k in values]]))
    w = (Window.partitionBy(*parts, "__bucket").orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (b.withColumns({k: F.sum(f"__v_{k}").over(w) for k in values}).join(F.broadcast(table), "__g", "left")
           .withColumns({k: F.col(k) + F.coalesce(f"__o_{k}", F.lit(0)) for k in values}))
    return out.drop("__bucket", "__g", *[f"__v_{k}" for k in values], *[f"__o_{k}" for k in values])


def positions(df: DataFrame, order_cols, name: str = "pos", n_buckets: int | None = None,
              partition_cols=(), bucket: Column | None = None, n: int | None = None) -> DataFrame:
    """0-based position of every row in the global order (per partition group)."""
    out = running_sums(df, order_cols, {name: F.lit(1).cast("bigint")}, n_buckets, partition_cols, bucket, n)
    return out.withColumn(name, F.col(name) - 1)


def durbin_watson(df: DataFrame, key: str, resid: Column, n_buckets: int | None = None) -> float:
    """sum((e_t - e_{t-1})^2) / sum(e_t^2) along ``key`` order."""
    b, _ = with_buckets(df.select(F.col(key).alias("__k"), resid.alias("__e")), ["__k"], n_buckets)
    w = Window.partitionBy("__bucket").orderBy("__k")
    d = b.withColumn("__d", F.col("__e") - F.lag("__e").over(w))
    rows = d.groupBy("__bucket").agg(
        F.sum(F.col("__d") * F.col("__d")).alias("num"), F.sum(F.col("__e") * F.col("__e")).alias("den"),
        F.min_by("__e", "__k").alias("first"), F.max_by("__e", "__k").alias("last")).collect()
    rows = sorted(rows, key=lambda r: r["__bucket"])
    num = sum(r["num"] or 0.0 for r in rows)
    den = sum(r["den"] or 0.0 for r in rows)
    for prev, nxt in zip(rows, rows[1:]):
        num += (nxt["first"] - prev["last"]) ** 2
    return num / den if den else float("nan")


def _hash(df: DataFrame, key: str, seed) -> Column:
    """``perm_hash`` of a column of ``df`` for a seed that may be a column."""
    if isinstance(df.schema[key].dataType, IntegralType):
        k = F.col(key).cast("bigint")
        high = F.call_function("div", k, F.lit(1000003))
        return F.pmod((k % 1000003) * 7919 + high * 104729 + F.lit(seed) * 15485863, F.lit(HASH_RANGE))
    text = F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(HASH_RANGE))


def perm_hash(df: DataFrame, key: str, seed: int) -> Column:
    """Seeded hash of a key column below ``HASH_RANGE`` that DuckDB can repeat exactly: arithmetic for whole
    numbers, the first eight digits of an MD5 for other types."""
    return _hash(df, key, seed)


def hash_buckets(n_rows: int) -> int:
    """Bucket count for a hash order: about ROWS_PER_BUCKET rows per bucket."""
    return max(64, n_rows // ROWS_PER_BUCKET + 1)


def hash_order_positions(df: DataFrame, key: str, seeds, name: str = "__p", rep: str = "__rep",
                         n_buckets: int | None = None, values=(), n: int | None = None) -> DataFrame:
    """Positions of every row in the seeded hash order, for each seed at once:
    the rows are copied once per seed and ranked within their seed.  The hash
    is uniform on a known range, so a row's bucket is arithmetic.

    With ``values`` (columns), ``__values`` lists them for all rows of the row's key: rows of
    a key are neighbours in the hash order, so this takes no join."""
    seeds, values = list(seeds), list(values)
    base = df.select(F.col(key).alias("__k"), *[F.col(f"`{v}`").alias(f"__w_{v}") for v in values])
    ex = base.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(seeds))])).alias(rep))
    seed_of = F.element_at(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds]), F.col(rep) + 1)
    ex = ex.withColumn("__h", _hash(ex, "__k", seed_of))
    buckets = n_buckets or hash_buckets(df.count() if n is None else n)
    at = F.coalesce(F.call_function("div", F.col("__h").cast("bigint") * buckets, F.lit(HASH_RANGE)), F.lit(0)).cast("int")
    ex = ex.withColumn("__bucket", at)
    if values:  # the buckets' rows are sorted once for these lists and the positions
        same = Window.partitionBy(rep, "__bucket", "__h", "__k")
        ex = ex.withColumn("__values", F.collect_list(F.struct(*[F.col(f"__w_{v}").alias(v) for v in values])).over(same))
        ex = ex.drop(*[f"__w_{v}" for v in values])
    return positions(ex, ["__h", "__k"], name, partition_cols=[rep], bucket=F.col("__bucket")).drop("__h").withColumnRenamed(
        "__k", key)


def permutation_donors(df: DataFrame, key: str, seed: int, n_buckets: int | None = None, values=()) -> DataFrame:
    """(key, donor_key): the row at position p in key order receives the value
    of the row at position p in (hash, key) order.  A deterministic permutation.

    With ``values``, these columns of the donor's key follow, as a join with ``df`` on ``donor_key`` would add them:
    none for a null key, one row for each row of a repeated one."""
    out = permutation_donors_many(df, key, [seed], n_buckets, values).drop("__rep")
    if not values:
        return out
    out = out.where(F.col("donor_key").isNotNull()).withColumn("__v", F.explode("__values"))
    return out.select(key, "donor_key", *[F.col("__v")[v].alias(v) for v in values])


def permutation_donors_many(df: DataFrame, key: str, seeds, n_buckets: int | None = None, values=()) -> DataFrame:
    """(key, donor_key, __rep) for several seeded permutations in one pass; with ``values`` also ``__values`` of
    the donor, as ``hash_order_positions`` lists them."""
    n = df.count()
    base = df.select(F.col(key).alias("__k"))
    by_key = positions(base, ["__k"], "__p", n_buckets, n=n)
    by_hash = hash_order_positions(df, key, seeds, values=values, n=n).withColumnRenamed(key, "donor_key")
    more = ["__values"] if values else []
    by_hash = by_hash.select("donor_key", "__p", "__rep", *more)
    return by_key.join(by_hash, "__p").select(F.col("__k").alias(key), "donor_key", "__rep", *more)


def kfold_blocks(pos: Column, n: int, k: int) -> Column:
    """Block index of a 0-based position for ``k`` contiguous folds over ``n``
    rows: the first n % k folds hold one extra row."""
    q, r = divmod(n, k)
    big = (q + 1) * r
    return (F.when(pos < F.lit(big), (pos / F.lit(q + 1)).cast("int"))
             .otherwise(F.lit(r) + ((pos - F.lit(big)) / F.lit(max(q, 1))).cast("int")))


def seeded_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """The ``size`` rows that come first in the seeded order of ``key``: the same rows however the table is
    divided.  Each task keeps its first ``size`` rows and these are merged, so nothing is sorted as a whole."""
    return df.withColumn("__h", perm_hash(df, key, seed)).orderBy("__h", key).limit(size).drop("__h")
