"""Substring dedup with difference-cover anchors.

A word goes if a window of ``WINDOW`` consecutive words covers it whose word
sequence also starts earlier in the corpus (smaller doc_id, or earlier in the
same document).  Windows are judged on the input.

1. Documents whose whole text stands in an earlier document are set aside: all
   their windows start earlier there, and none of them is anybody's first.
2. Anchors of ``ANCHOR`` words are hashed only at places whose remainder modulo
   ``PERIOD`` is in ``COVER``.  Every difference of two remainders occurs in the
   cover, so two equal windows at any places have equal anchors at one offset
   below ``PERIOD``; ``ANCHOR + PERIOD - 1 = WINDOW`` keeps the anchor within.
3. Anchors found twice are extended: only the windows around them are hashed
   (128 bits), and of equal windows all but the earliest are marked.

Equal keys of one block of documents are folded before the shuffle, so a passage
that a third of the corpus shares is one row for each block.

Defined results
* null and empty text have no words; documents of fewer than ``WINDOW`` words lose none;
* ties: rows that repeat a doc_id (null is one) are judged one by one, in the order of
  doc_id, then text;
* a null doc_id sorts first; an empty table gives an empty result; extra columns
  are ignored; very long texts are held one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import broadcast_if_small, row_keys, written

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # a perfect difference set modulo 13
ANCHOR = WINDOW - PERIOD + 1


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2**63)).alias("d")


def _pairs(flat: Column) -> Column:
    """[d, p, d, p, ...] as an array of (d, p)."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 2 - 1).cast("int")), lambda i: F.struct(
        F.get(flat, i * 2).alias("d"), F.get(flat, i * 2 + 1).alias("p")))


def later_copies(docs: DataFrame) -> DataFrame:
    """(d): documents whose text is that of a document with a smaller id."""
    keyed = docs.where("text is not null").select(
        _doc(), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("n"))
    keyed = written(keyed, "substring-texts")
    firsts = keyed.groupBy("h1", "h2", "n").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    return keyed.join(firsts.drop("last"), ["h1", "h2", "n"]).where("d > first").select("d").distinct()


def anchors(docs: DataFrame) -> DataFrame:
    """(key, at): each anchor hash of a block of documents with its places [d, p, d, p, ...]."""

    def run(batches):
        for batch in batches:
            for block, _, _ in words.blocks(batch):
                doc, p = block.places(ANCHOR)
                use = np.isin(p % PERIOD, COVER) & (block.sizes[doc] >= WINDOW)
                doc, p = doc[use], p[use]
                keys, at = words.grouped(block.windows(block.starts[doc] + p, ANCHOR).view("i8"),
                                         np.array(block.ids, "i8")[doc] if len(doc) else doc, p)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), at], names=["key", "at"])

    return docs.mapInArrow(run, "key bigint, at array<bigint>")


def shared(folded: DataFrame) -> DataFrame:
    """(d, ps): the places, by document, of anchors that occur more than once."""
    many = folded.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where((F.col("n") > 1) | (F.size("at") > 2))
    return (many.select(F.explode(_pairs(F.col("at"))).alias("x")).select("x.*")
            .groupBy("d").agg(F.collect_list(F.col("p").cast("int")).alias("ps")))


def extended(docs: DataFrame) -> DataFrame:
    """(h1, h2, first, later): hashes of the windows around shared anchors of (d, text, ps), folded by block.

    ``first`` is the block's earliest place (d, p); ``later`` holds the others."""

    def run(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            for block, row, n in words.blocks(batch):
                at = []
                for i in range(n):
                    size, start = int(block.sizes[i]), int(block.starts[i])
                    last = size - WINDOW
                    if last < 0:
                        continue
                    p = np.array(found[row + i], "i8")
                    edge = np.zeros(size + 2, "i8")
                    np.add.at(edge, np.maximum(0, p - PERIOD + 1), 1)
                    np.add.at(edge, np.minimum(p, last) + 1, -1)
                    at.append(np.flatnonzero(np.cumsum(edge)[:last + 1] > 0) + start)
                at = np.concatenate(at) if at else np.zeros(0, "i8")
                doc = np.searchsorted(block.starts, at, side="right") - 1
                # documents without words share their start with the next one
                ids = np.array(block.ids, "i8")[doc] if len(at) else at
                p = at - block.starts[doc] if len(at) else at
                h1, h2 = block.windows(at, WINDOW).view("i8"), block.windows(at, WINDOW, 1).view("i8")
                order = np.lexsort((p, ids, h2, h1))
                h1, h2, ids, p = h1[order], h2[order], ids[order], p[order]
                head = np.ones(len(at), bool)
                head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                heads = np.flatnonzero(head)
                rest = np.flatnonzero(~head)
                flat = np.empty(2 * len(rest), "i8")
                flat[0::2], flat[1::2] = ids[rest], p[rest]
                counts = np.diff(np.concatenate([heads, [len(at)]])) - 1
                offsets = np.concatenate([[0], np.cumsum(2 * counts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[heads]), pa.array(h2[heads]), pa.array(ids[heads]), pa.array(p[heads]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                    names=["h1", "h2", "d", "p", "later"])

    return docs.mapInArrow(run, "h1 bigint, h2 bigint, d bigint, p bigint, later array<bigint>")


def marked(windows: DataFrame) -> DataFrame:
    """(d, ps): the places of windows whose words start earlier elsewhere."""
    same = Window.partitionBy("h1", "h2")
    least = windows.withColumn("least", F.min(F.struct("d", "p")).over(same))
    all_at = F.concat(F.array(F.struct("d", "p")),
                      F.when(F.size("later") > 0, _pairs(F.col("later"))).otherwise(
                          F.array().cast("array<struct<d:bigint,p:bigint>>")))
    return (least.select("least", F.explode(all_at).alias("x")).where("x > least").select("x.*")
            .groupBy("d").agg(F.collect_list(F.col("p").cast("int")).alias("ps")))


def removed_places(docs: DataFrame) -> DataFrame:
    """(d, ps, whole): starts of the windows to remove, or ``whole`` for later copies of a text."""
    own = docs.select(_doc(), "text")
    copies = written(later_copies(docs), "substring-copies")
    n_copies = copies.count()
    firsts = own.join(broadcast_if_small(copies, n_copies, 16), "d", "left_anti")
    found = written(shared(anchors(firsts)), "substring-anchors")
    near = firsts.join(found, "d").select("d", "text", "ps")
    marks = marked(extended(near))
    return written(marks.withColumn("whole", F.lit(False)).unionByName(
        copies.select("d", F.array().cast("array<int>").alias("ps"), F.lit(True).alias("whole"))), "substring-marks")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words joined by one space."""
    docs = docs.select("doc_id", "text")
    keyed = row_keys(docs)
    own = (docs.select(_doc(), "*") if keyed is None else keyed.withColumnRenamed("row", "d")).withColumn(
        "doc_id", F.col("doc_id").cast("bigint"))
    marks = removed_places(own.select(F.col("d").alias("doc_id"), "text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                sizes, gone, kept = [], [], []
                for text, ps, whole in zip(*(some.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    w = words.split(text)
                    edge = np.zeros(len(w) + 1, "i8")
                    if whole and len(w) >= WINDOW:
                        edge[0] = 1
                    elif ps:
                        p = np.array(ps, "i8")
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + WINDOW, -1)
                    out = np.cumsum(edge[:len(w)]) > 0
                    sizes.append(len(w))
                    gone.append(int(out.sum()))
                    kept.append(" ".join([x for x, o in zip(w, out.tolist(), strict=True) if not o]) if gone[-1] else " ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return (own.join(marks, "d", "left").select("doc_id", "text", "ps", "whole")
            .mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string"))

