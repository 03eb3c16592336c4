"""Mixing sources to target weights.

The documents form a tree domain > language > source.  A token budget runs down
the tree: each node divides its budget among its children by weight, and no
child gets more than its subtree can give (tokens times ``max_epochs``).  What a
child cannot use goes to its siblings; only what no sibling can use stays with
the parent's siblings, because the parent's own share was bounded by its
subtree.  A leaf fills its budget from seeded epochs: whole epochs first, then
the prefix of one more epoch in the order of a seeded hash, up to and including
the document that reaches the budget.

Only DataFrame functions are used.  The prefix of a leaf is found without
sorting the leaf: its hash order is cut into 4,096 buckets, bucket totals give
the one bucket where the budget ends, and only that bucket is ordered.  A leaf
with a third of all rows is therefore summed on the map side and never meets in
one task.

Defined results
* tokens are the words of the text; a document without words (null, empty) is
  never selected (0 copies);
* null language or source is the child named ``''``; sources without a number
  belong to domain ``other``;
* budgets are whole tokens, rounded down for every child;
* rows that repeat a doc_id within a leaf share one place in the order and go
  in or out together; a null doc_id is a value like any other;
* empty table: empty result.  Other columns pass through; ``domain``,
  ``n_tokens`` and ``copies`` replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, broadcast_if_small, written

LEAF = ["__domain", "__lang", "__source"]


def domain_of(source: Column) -> Column:
    """The default first level of the tree: the source's number modulo 4."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.pmod(number.cast("bigint"), F.lit(4)))).otherwise("other")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    """A positive whole weight by name; 1 where none is given."""
    w = F.lit(1)
    for key in sorted(weights):
        w = F.when(name == key, F.lit(int(weights[key]))).otherwise(w)
    return w.cast("bigint")


def divide(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water-filling among siblings: adds ``budget`` to (parent..., child, cap, w, given).

    ``given`` is the parent's budget.  Children in the order of cap / w take
    their whole cap as long as that is at most their share of what is left; the
    others divide the rest by weight."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    return (children
            .withColumn("left_over", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("w_rest", F.sum("w").over(rest))
            .withColumn("full", F.expr("cap * w_rest <= left_over * w"))
            .withColumn("pool", F.max(F.when(~F.col("full"), F.col("left_over"))).over(every))
            .withColumn("pool_w", F.max(F.when(~F.col("full"), F.col("w_rest"))).over(every))
            .withColumn("budget", F.expr("if(full, cap, (pool * w) div pool_w)"))
            .drop("left_over", "w_rest", "full", "pool", "pool_w"))


def leaf_budgets(totals: DataFrame, budget: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(leaf columns, tokens, budget) from the leaves' token totals."""
    leaves = totals.withColumn("cap", F.col("tokens") * max_epochs)
    level, parent = None, []
    for key, kind in zip(LEAF, ("domain", "lang", "source"), strict=True):
        path = parent + [key]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn(
            "w", weight_of(F.col(key), weights.get(kind, {})))
        if level is None:
            nodes = nodes.withColumns({"given": F.lit(budget).cast("bigint"), "__root": F.lit(0)})
            level = divide(nodes, ["__root"], key).drop("__root")
        else:
            nodes = nodes.join(level.select(*parent, F.col("budget").alias("given")), parent)
            level = divide(nodes, parent, key)
        parent = path
    return totals.join(level.select(*LEAF, "budget"), LEAF)


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def mix(docs: DataFrame, share: float, weights: dict[str, dict[str, int]], max_epochs: int, seed: int,
        domain: Column | None = None) -> DataFrame:
    """``docs`` with domain, n_tokens and copies (how often the mixture takes the document).

    The whole budget is ``share`` of all tokens, rounded down."""
    domain = domain_of(F.col("source")) if domain is None else domain
    rows = docs.withColumns({
        "__domain": F.coalesce(domain, F.lit("other")), "__lang": F.coalesce("lang", F.lit("")),
        "__source": F.coalesce("source", F.lit("")),
        "__n": F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")})
    narrow = written(rows.where("__n > 0").select(*LEAF, "doc_id", F.col("__n").alias("n")), "mix-rows")
    totals = written(narrow.groupBy(*LEAF).agg(F.sum("n").alias("tokens")), "mix-leaves")
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    budgets = leaf_budgets(totals, int(whole * share), weights, max_epochs)
    plan = written(budgets.withColumn("epochs", F.expr("budget div tokens"))
                   .withColumn("rest", F.expr("budget - epochs * tokens")), "mix-budgets")
    small = broadcast_if_small(plan.select(*LEAF, "epochs", "rest"), plan.count(), 256)
    keyed = (narrow.join(small, LEAF).where("rest > 0")
             .withColumn("key", _key(seed, F.col("epochs"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, 3)))
    along = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (keyed.groupBy(*LEAF, "bucket").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
            .withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)))
            .where("start < rest and rest <= start + n").select(*LEAF, "bucket", "start"))
    within = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cutoff = (keyed.join(ends, LEAF + ["bucket"])
              .groupBy(*LEAF, "key").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("start").alias("start"),
                                         F.max("bucket").alias("bucket"))
              .withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
              .groupBy(*LEAF).agg(F.coalesce(F.min(F.when(F.col("at") >= F.col("rest"), F.col("key"))),
                                             F.concat(F.max("bucket"), F.lit("g"))).alias("cutoff")))
    final = written(plan.join(cutoff, LEAF, "left")
                    .select(*LEAF, F.col("epochs").alias("__epochs"), F.col("cutoff").alias("__cutoff")), "mix-plan")
    taken = F.coalesce(_key(seed, F.col("__epochs"), F.col("doc_id")) < F.col("__cutoff"), F.lit(False)).cast("bigint")
    copies = F.when(F.col("__n") > 0, F.coalesce("__epochs", F.lit(0)) + taken).otherwise(0).cast("bigint")
    return (rows.join(broadcast_if_small(final, final.count(), 256), LEAF, "left")
            .withColumns({"domain": F.col("__domain"), "n_tokens": F.col("__n"), "copies": copies})
            .drop(*LEAF, "__n", "__epochs", "__cutoff"))
