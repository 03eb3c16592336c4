"""Global order, splits and folds over keys of any orderable type; the scratch folder."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.operators import ordering as O
from arealens.plans.preprocess import holdout_split, kfold

BIG = 2**53


def keys(kind, n):
    rng = np.random.default_rng(3)
    at = rng.permutation(n)
    if kind == "string":
        return [f"k{i * 7919 % 100003:06d}-é{i}" for i in at.tolist()]
    if kind == "large":  # neighbours that a double cannot tell apart
        return [BIG + i for i in at.tolist()]
    if kind == "date":
        return [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in at.tolist()]
    return at.tolist()


SCHEMA = {"string": "string", "large": "bigint", "date": "date", "int": "int"}


@pytest.mark.parametrize("kind", sorted(SCHEMA))
def test_positions_and_running_sums(spark, kind):
    ks = keys(kind, 700)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(ks)], f"k {SCHEMA[kind]}, v bigint").repartition(5)
    got = {r["k"]: (r["pos"], r["total"]) for r in O.running_sums(
        O.positions(df, ["k"], n_buckets=9), ["k"], {"total": F.col("v")}, n_buckets=40).collect()}
    total, want = 0, {}
    for p, (k, v) in enumerate(sorted(zip(ks, range(len(ks))))):
        total += v
        want[k] = (p, total)
    assert got == want


def test_rows_that_tie_in_the_first_column_are_spread(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 2, 1).otherwise(0).alias("a"), F.col("id").cast("string").alias("b"))
    cuts = O.sampled_cuts(df, ["a", "b"], 3000, 10)
    sizes = [r["count"] for r in O.add_bucket(df, ["a", "b"], cuts).groupBy("__bucket").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 900


@pytest.mark.parametrize("kind", sorted(SCHEMA))
def test_keys_at_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(O, "RANK_ROWS", 40)
    ks = keys(kind, 600) + keys(kind, 600)[:1] * 500  # one key holds nearly half of the rows
    df = spark.createDataFrame([(k,) for k in ks], f"k {SCHEMA[kind]}").repartition(4)
    ranks = [0, 1, 299, 300, 700, 1098, 1099]
    assert O.keys_at_ranks(df, ["k"], ranks) == {r: (sorted(ks)[r],) for r in ranks}
    same = spark.createDataFrame([("x",)] * 90, "k string")
    assert O.keys_at_ranks(same, ["k"], [0, 89]) == {0: ("x",), 89: ("x",)}


@pytest.mark.parametrize("kind", sorted(SCHEMA))
def test_splits_and_folds(spark, kind):
    ks = keys(kind, 403)
    df = spark.createDataFrame([(k,) for k in ks], f"k {SCHEMA[kind]}").repartition(3)
    order = [r["k"] for r in df.orderBy(O.perm_hash(df, "k", 42), "k").collect()]
    split, n = holdout_split(df, "k", 0.2, 42)
    assert n == 403 and {r["k"] for r in split.where("is_test").collect()} == set(order[:81])
    folds = {r["k"]: r["fold"] for r in kfold(df, "k", 5, 42)[0].collect()}
    ends = np.cumsum([81, 81, 81, 80, 80])
    assert [folds[k] for k in order] == [int(np.searchsorted(ends, i, "right")) for i in range(403)]


@pytest.mark.parametrize("kind", ["string", "large"])
def test_durbin_watson_and_permutations(spark, kind):
    ks = keys(kind, 500)
    e = np.random.default_rng(1).standard_normal(500)
    df = spark.createDataFrame(list(zip(ks, e.tolist())), f"k {SCHEMA[kind]}, e double").repartition(4)
    s = e[np.argsort(np.array(ks))]
    assert O.durbin_watson(df, "k", F.col("e"), 7) == pytest.approx(float(((s[1:] - s[:-1]) ** 2).sum() / (s ** 2).sum()))
    pairs = O.permutation_donors(df, "k", 5).collect()
    by_hash = [r["k"] for r in df.orderBy(O.perm_hash(df, "k", 5), "k").collect()]
    assert {(r["k"], r["donor_key"]) for r in pairs} == set(zip(sorted(ks), by_hash))


def test_scratch_folder_in_a_plain_session(tmp_path):
    """With an empty Spark configuration; what was written is gone when the application ends."""
    code = ("import sys; sys.path.insert(0, {root!r})\n"
            "from pyspark.sql import SparkSession\n"
            "from arealens.session import scratch_path\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "p = scratch_path(s, 'x'); s.range(3).write.parquet(p)\n"
            "assert s.read.parquet(p).count() == 3\n"
            "print('AT', p); s.stop()\n").format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-2000:]
    assert not os.path.exists(out.stdout.split("AT ")[1].strip())
