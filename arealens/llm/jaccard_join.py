"""N-gram Jaccard join by vertical partitioning, and its components.

A document's set holds its distinct ``SIZE``-word shingles (64-bit hashes of the
words, A-Z in lower case); with fewer words the whole sequence is one shingle.
Two documents link when 100 * intersection >= ``PERCENT`` * union.

1. Equal sets fold into one class, named by its smallest doc_id.
2. A set of a link has at most ``n - ceil(PERCENT/100 n)`` grams that no other set
   holds.  The first fragments of the gram order (``SCREEN`` of them) are counted
   over all classes; classes with more such grams there, most of them, are done.
3. For the others the grams are ordered by document frequency, rarest first, so
   that passages which many documents share stand last, and the prefixes are
   taken again in that order.  A gram's prefixes are a bucket.
4. In ``ROUNDS`` rounds each bucket tests its members against one pivot, and members
   that joined the pivot's component are not compared again.  What is left, members
   of one bucket in different components, is compared once: only in the first of
   the buckets that two sets share, and only if the grams from there on that others
   hold too are enough for a link; nothing else is left out.  Which bucket is the
   first is told by the first ``HEAD`` grams of both prefixes; where these share
   none, a pair may be formed in several buckets, and repeats are folded.
5. A pair is tested by vertical partitioning: the gram order is cut into
   ``FRAGMENTS`` ranges, each set into its segments, the overlaps are counted per
   fragment, and the counts are summed for the pair.

``join`` gives the components; ``links`` gives every link between classes, from all
pairs of a bucket.

Defined results
* null and empty texts have an empty set: 0 shingles, linked with nothing;
* ties and repeated rows: equal texts are one class; rows that repeat a doc_id (null
  is one) are judged one by one, in the order of doc_id, then text, and a component
  has the doc_id of its first row;
* a null doc_id sorts first; empty table: empty result; extra columns are ignored;
  very long texts are held one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import broadcast_if_small, components, row_keys, written

SIZE = 5
PERCENT = 75
ROUNDS = 2
FRAGMENTS = 8
SCREEN = 3
HEAD = 64

_NULL = -2**63


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("d")


def gram_sets(block: words.Block, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    doc, place = block.places(size)
    hashes = block.windows(block.starts[doc] + place, size).view("i8") if len(doc) else np.zeros(0, "i8")
    edges = np.searchsorted(doc, np.arange(len(block.sizes) + 1))
    out = []
    for i, n in enumerate(block.sizes.tolist()):
        if 0 < n < size:
            out.append(block.windows(block.starts[i:i + 1], n).view("i8"))
        else:
            out.append(np.unique(hashes[edges[i]:edges[i + 1]]))
    return out


def _edges() -> np.ndarray:
    """Where the fragments of the gram order (hash order) begin, but for the first."""
    return np.array([-2**63 + k * (2**64 // FRAGMENTS) for k in range(1, FRAGMENTS)], "i8")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, "i8"), pa.int64()))


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """(d, n, k1, k2, own, met) for (d, text).

    ``k1, k2`` name the set.  Of the grams in the first ``SCREEN`` fragments, ``own``
    has those that no different set of the same block of documents holds, and
    ``met`` those that one does; each is listed with the smallest id of the block."""
    from xxhash import xxh3_128_intdigest

    edge = _edges()[SCREEN - 1]

    def lists(of, flat, n):
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(n + 1))
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat[order], pa.int64()))

    def run(batches):
        for batch in batches:
            for block, _, _ in words.blocks(batch, lower=True):
                sets = gram_sets(block, size)
                names = [xxh3_128_intdigest(s.tobytes()) for s in sets]
                k1 = np.array([x >> 64 for x in names], "u8").view("i8")
                k2 = np.array([x & (2**64 - 1) for x in names], "u8").view("i8")
                ids = np.array(block.ids, "i8")
                first = [s[:np.searchsorted(s, edge)] for s in sets]
                of = np.repeat(np.arange(len(sets)), [len(f) for f in first])
                flat = np.concatenate(first) if first else np.zeros(0, "i8")
                rank = np.empty(len(ids), "i8")
                rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                order = np.lexsort((rank[of], flat))
                flat, of = flat[order], of[order]
                head = np.ones(len(flat), bool)
                head[1:] = flat[1:] != flat[:-1]
                starts = np.flatnonzero(head)
                several = (np.minimum.reduceat(k1[of], starts) != np.maximum.reduceat(k1[of], starts)) if len(flat) else head
                of, flat = of[head], flat[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2),
                     lists(of[~several], flat[~several], len(sets)), lists(of[several], flat[several], len(sets))],
                    names=["d", "n", "k1", "k2", "own", "met"])

    return docs.mapInArrow(run, "d bigint, n bigint, k1 bigint, k2 bigint, own array<bigint>, met array<bigint>")


def screened(reps: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """(d): the classes that can have a link, from the summaries of their representatives and of all rows.

    A gram that different sets of a block hold may be listed under an exact copy, so
    ``met`` counts from every row.  ``own`` of a copy repeats what the block of its
    representative lists, so the representatives' are enough: a gram is alone if its
    only listing is ``own``."""
    grams = reps.select("d", F.explode("own").alias("g"), F.lit(True).alias("own")).union(
        every.select("d", F.explode("met").alias("g"), F.lit(False).alias("own")))
    # of a gram that is listed once, the least d and own are those of its listing
    listed = grams.groupBy("g").agg(F.count("*").alias("holders"), F.min("d").alias("d"), F.bool_or("own").alias("own"))
    alone = listed.where("holders = 1 and own").groupBy("d").agg(F.count("*").alias("alone"))
    most = F.expr(f"n - (n * {percent} + 99) div 100")
    return (reps.select("d", "n").join(alone, "d", "left").where(F.coalesce("alone", F.lit(0)) <= most).select("d"))


def segments(docs: DataFrame, size: int) -> DataFrame:
    """(d, n, parts): each set cut into ``FRAGMENTS`` segments of the gram order."""
    edges = _edges()

    def run(batches):
        for batch in batches:
            for block, _, _ in words.blocks(batch, lower=True):
                sets = gram_sets(block, size)
                parts = [p for s in sets for p in np.split(s, np.searchsorted(s, edges))]
                flat = _lists(parts)
                outer = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * FRAGMENTS, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), outer],
                    names=["d", "n", "parts"])

    return docs.mapInArrow(run, "d bigint, n bigint, parts array<array<bigint>>")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(g, i, d, n, s, head): the frequency-ordered prefix of every set, without grams that only it holds; ``s`` of
    its ``n`` grams are held by others too, ``i`` of those come before g; ``head`` begins the prefix."""
    held = sets.select("d", "n", F.explode(F.flatten("parts")).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (held.join(often, "g").groupBy("d", "n")
              .agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("held")))
    # grams held by one set only come first in the order and meet nobody
    need = F.expr(f"cast(greatest(n - (n * {percent} + 99) div 100 + 1 - (n - size(held)), 0) as int)")
    prefix = ranked.withColumns({"need": need, "s": F.size("held").cast("bigint")}).where("need > 0")
    grams = prefix.select("d", "n", "s", F.transform(F.slice("held", F.lit(1), F.col("need")), lambda x: x["g"]).alias("grams"))
    return grams.select("d", "n", "s", F.slice("grams", 1, HEAD).alias("head"), F.posexplode("grams").alias("i", "g"))


def _can_link(percent: int, a: str, b: str) -> Column:
    """Of the sets' grams from a bucket's on, at most the smaller number that others hold too is shared; the
    bucket counts as their first, so nothing before it is."""
    most = F.expr(f"least({a}.s - {a}.i, {b}.s - {b}.i)")
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def _first_shared() -> Column:
    """Whether the bucket g is the first that two sets share, as far as their heads tell."""
    first = F.get(F.array_intersect("one.head", "two.head"), F.lit(0))
    return first.isNull() | (first == F.col("g"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both): the intersection of each pair, counted in each fragment and summed over the fragments."""
    side = lambda d, parts: sets.select(F.col("d").alias(d), F.col("parts").alias(parts))
    met = pairs.join(side("a", "pa"), "a").join(side("b", "pb"), "b")
    counted = F.zip_with("pa", "pb", lambda x, y: F.size(F.array_intersect(x, y)))
    return met.select("a", "b", "na", "nb", F.aggregate(counted, F.lit(0), lambda t, c: t + c).cast("bigint").alias("both"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    return overlaps(pairs, sets).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def class_links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, component labels (id, component)) of the classes in ``sets``.

    The links connect what all links connect."""
    buckets = written(prefixes(sets, percent), "jaccard-buckets")
    heads = buckets.where("i = 0").select("d", "head")
    nodes = heads.select(F.col("d").alias("id"))
    rows = buckets.select("g", "i", "d", "n", "s")
    labelled = rows.withColumn("label", F.col("d"))
    links = tested = labels = None

    def test(pairs: DataFrame) -> None:
        nonlocal links, tested, labels
        pairs = pairs.distinct()
        fresh = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        new = written(linked(fresh, sets, percent), "jaccard-links")
        tested = fresh.select("a", "b") if tested is None else tested.union(fresh.select("a", "b"))
        links = new if links is None else links.union(new)
        labels = written(components(nodes, links), "jaccard-labels")

    def met_in(some: DataFrame, others: DataFrame, once: Column) -> DataFrame:
        """Members of one bucket in different components that can link, as (a, b, na, nb) with a < b."""
        packed = lambda df, name: df.select("g", F.struct(*[c for c in df.columns if c != "g"]).alias(name))
        one = packed(others, "one").withColumnRenamed("g", "h")
        open_ = (F.col("one.label") != F.col("two.label")) & _can_link(percent, "one", "two") & once
        met = one.join(packed(some, "two"), (F.col("h") == F.col("g")) & open_)
        swap = F.col("one.d") < F.col("two.d")
        of = lambda c, x, y: F.when(swap, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
        return met.select(of("d", "one", "two").alias("a"), of("d", "two", "one").alias("b"),
                          of("n", "one", "two").alias("na"), of("n", "two", "one").alias("nb"))

    def split_buckets(some: DataFrame) -> DataFrame:
        open_ = some.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        return some.join(open_.select("g"), "g")

    for turn in range(ROUNDS):
        # first the member with the smallest share of grams of its own: the text that copies come from
        central = F.struct((F.col("n") - F.col("s")) / F.col("n") if turn == 0 else F.xxhash64("d", F.lit(turn)), "d")
        pivot = labelled.groupBy("g").agg(F.min_by(F.struct("i", "d", "n", "s", "label"), central).alias("p")).select("g", "p.*")
        test(met_in(labelled, pivot, F.lit(True)))
        labelled = written(split_buckets(rows.join(labels.select(F.col("id").alias("d"), F.col("component").alias("label")), "d")),
                           "jaccard-open")
    left = written(labelled.join(heads, "d"), "jaccard-left")
    test(met_in(left, left, (F.col("one.d") < F.col("two.d")) & _first_shared()))
    return links, labels


def _prepared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries of all documents, (d, rep) of those with grams, segments of the classes that can have a link)."""
    own = docs.select(_doc(), "text")
    summary = written(summaries(own, size), "jaccard-sets")
    classes = summary.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("d").alias("rep"))
    member = written(summary.where("n > 0").select("d", "n", "k1", "k2").join(classes, ["n", "k1", "k2"])
                     .select("d", "rep"), "jaccard-classes")
    copies = member.where("d <> rep").select("d")
    reps = summary.where("n > 0").join(broadcast_if_small(copies, copies.count(), 16), "d", "left_anti")
    near = written(screened(reps, summary, percent), "jaccard-near")
    sets = written(segments(own.join(broadcast_if_small(near, near.count(), 16), "d", "left_semi"), size), "jaccard-segments")
    return summary, member, sets


def _with_ids(found: DataFrame, keyed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``found`` with the doc_id for each row key in the columns ``names``."""
    out = found
    for name in names:
        ids = keyed.select(F.col("row").alias(name), F.col("doc_id").cast("bigint").alias(f"{name}_of"))
        out = out.join(ids, name).drop(name).withColumnRenamed(f"{name}_of", name)
    return out.select(*found.columns)


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links, for every document."""
    keyed = row_keys(docs.select("doc_id", "text"))
    if keyed is not None:
        found = join(keyed.select(F.col("row").alias("doc_id"), "text"), size, percent)
        return _with_ids(found, keyed, ("doc_id", "component_id"))
    summary, member, sets = _prepared(docs, size, percent)
    _, labels = class_links(sets, percent)
    grouped = (member.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
               .select("d", F.coalesce("component", "rep").alias("component_id")))
    null = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    per_row = docs.select(_doc()).join(summary.select("d", "n"), "d").join(grouped, "d", "left")
    return per_row.select(null("d").alias("doc_id"), F.col("n").alias("n_shingles"),
                          F.coalesce("component_id", "d").alias("component_id")).withColumn("component_id", null("component_id"))


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(a, b, both, either): every link between classes, named by their smallest doc_ids (a before b, null first),
    with the sizes of intersection and union.

    The similarity join itself: as many rows as there are links, the square of a
    group of near copies.  ``join`` needs the connecting ones only."""
    keyed = row_keys(docs.select("doc_id", "text"))
    if keyed is not None:
        return _with_ids(links(keyed.select(F.col("row").alias("doc_id"), "text"), size, percent), keyed, ("a", "b"))
    _, _, sets = _prepared(docs, size, percent)
    buckets = written(prefixes(sets, percent), "jaccard-buckets")
    one, two = (buckets.select("g", F.struct("d", "n", "s", "i", "head").alias(name)) for name in ("one", "two"))
    met = one.withColumnRenamed("g", "h").join(two, (F.col("h") == F.col("g")) & (F.col("one.d") < F.col("two.d"))
                                               & _can_link(percent, "one", "two") & _first_shared())
    pairs = written(met.select(*[F.col(c).alias(x) for c, x in (("one.d", "a"), ("two.d", "b"), ("one.n", "na"), ("two.n", "nb"))])
                    .distinct(), "jaccard-pairs")
    found = overlaps(pairs, sets).withColumn("either", F.expr("na + nb - both")).where(f"100 * both >= {percent} * either")
    null = lambda c: F.when(F.col(c) != _NULL, F.col(c)).alias(c)
    return found.select(null("a"), null("b"), "both", "either")


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id): one document of each component, the one with the smallest id."""
    found = join(docs, size, percent)
    return found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
