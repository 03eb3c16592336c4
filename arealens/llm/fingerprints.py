"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  Runs of one symbol become one symbol; then
deterministic coin tossing gives every symbol a small label that depends on it
and a few symbols to its left only (the lowest bit in which neighbours differ,
taken repeatedly until there are six labels); local maxima of the labels open
phrases of two or more symbols; and a phrase's name, a hash of its symbols, is a
symbol of the next level.  Cuts depend on their neighbourhood alone, so equal
substrings get equal names but for the edges, wherever they stand.

A fingerprint holds the ``KEEP`` smallest hashes of the names of levels
``LEVELS`` (phrases of about 27 to 250 characters); a text that ends in one
symbol below them gives that symbol.  Likeness is the share of common hashes
among the smallest of both, an estimate of the Jaccard index of the name sets.

Defined results
* null text counts as empty: its fingerprint is the empty string; two empty
  fingerprints have likeness 1, an empty and another one 0;
* equal texts have equal fingerprints at any place and in any block;
* rows stand in descending order of doc_id, null last, ties by the text; the
  next of the last row is the first; a single row is its own next;
* repeated rows are rows of their own; empty table: empty result; extra columns
  are ignored; very long texts are held one at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import mix

KEEP = 64
LEVELS = (3, 4, 5)
BLOCK_CHARS = 300_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], "i8")
_NULL = -2**63


def _labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six labels by repeated coin tossing; neighbours in a text differ."""
    before = np.empty_like(sym)
    before[1:] = sym[:-1]
    before[first] = ~sym[first]
    x = sym ^ before
    low = np.frexp((x & (~x + np.uint64(1))).astype("f8"))[1] - 1
    label = 2 * low.astype("i8") + ((sym >> low.astype("u8")) & np.uint64(1)).astype("i8")
    for _ in range(3):  # 128 labels become 14, 8, 6
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        low = _LOW_BIT[label ^ before]
        label = 2 * low + ((label >> low) & 1)
    return label


def parse_level(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrase names and their documents.  Symbols of a document are contiguous."""
    head = np.ones(len(sym), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (sym[1:] != sym[:-1])
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(sym)))
    sym, doc = sym[at], doc[at]
    sym = np.where(run > 1, mix(sym * _STEP + run.astype("u8")), sym)
    n = len(sym)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    label = _labels(sym, np.flatnonzero(first))
    left = np.full(n, 9, "i8")
    left[1:] = label[:-1]
    right = np.full(n, -1, "i8")
    right[:-1] = np.where(first[1:], -1, label[1:])
    opens = (label > left) & (label >= right)
    opens[1:] &= ~first[:-1]  # no phrase of one symbol at the start
    opens |= first
    at = np.flatnonzero(opens)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _STEP, "u8"))
    return mix(np.add.reduceat(mix(sym + np.uint64(1)) * power[place], at)), doc[at]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The sorted hashes of each text's fingerprint."""
    points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    sym = mix(np.concatenate(points).astype("u8") + np.uint64(1)) if len(doc) else np.zeros(0, "u8")
    kept = []
    for level in range(1, LEVELS[-1] + 1):
        if not len(sym):
            break
        sym, doc = parse_level(sym, doc)
        alone = np.ones(len(doc), bool)
        alone[1:] &= doc[1:] != doc[:-1]
        alone[:-1] &= doc[1:] != doc[:-1]
        use = np.ones(len(doc), bool) if level >= LEVELS[0] else alone
        kept.append((doc[use].astype("u8") << np.uint64(32)) | (sym[use] >> np.uint64(32)))
        sym, doc = sym[~alone], doc[~alone]
    every = np.unique(np.concatenate(kept)) if kept else np.zeros(0, "u8")
    edges = np.searchsorted(every >> np.uint64(32), np.arange(len(texts) + 1).astype("u8"))
    return [(every[a:min(a + KEEP, b)] & np.uint64(0xFFFFFFFF)).astype("u4") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the ``KEEP`` smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEEP]
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True)) / len(both)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_COLUMNS = ("kind string, part int, d bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double, text string")
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _results(chain: list[tuple], part: int) -> list[tuple]:
    """Rows for all documents (d, text, fingerprint) of a chain but the last, each with its follower."""
    changed = [edited(a[1], b[1]) for a, b in zip(chain, chain[1:], strict=False)]
    out = []
    for (d, text, own), (_, _, after), new, print_ in zip(chain, chain[1:], changed, fingerprints(changed), strict=False):
        out.append(("row", part, d, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(own), as_text(print_),
                    likeness(own, print_), likeness(own, after), None))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names=_NAMES)


def _walk(batches):
    """Documents of one range in order; the ends of the range are handed on with their text."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(ids):
            to, chars = at, 0
            while to < len(ids) and chars < BLOCK_CHARS:
                chars += len(texts[to])
                to += 1
            block = list(zip(ids[at:to], texts[at:to], fingerprints(texts[at:to]), strict=True))
            rows = [] if last else [("head", part, ids[at]) + (None,) * 6 + (texts[at],)]
            chain = [last, *block] if last else block
            yield _batch(rows + _results(chain, part))
            last, at = chain[-1], to
    if last:
        yield _batch([("last", part, last[0]) + (None,) * 6 + (last[1],)])


def _finish(batches):
    """The last document of each range with the first one of the next."""
    for batch in batches:
        for d, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            prints = fingerprints([text, after])
            yield _batch(_results([(d, text, prints[0]), (None, after, prints[1])], 0))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (own.repartitionByRange(parts, F.desc("d"), F.xxhash64("text"))
               .sortWithinPartitions(F.desc("d"), F.xxhash64("text"), "text"))
    table = written(ordered.mapInArrow(_walk, _COLUMNS), "fingerprints")
    ranges = table.where("kind = 'head'").select("part").collect()  # one number for each range
    order = sorted(r["part"] for r in ranges)
    follows = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, next int")
    ends = (table.where("kind = 'last'").select("part", "d", "text").join(follows, "part")
            .join(table.where("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
            .select("d", "text", "after"))
    rows = table.where("kind = 'row'").unionByName(ends.mapInArrow(_finish, _COLUMNS))
    return rows.select(F.when(F.col("d") != _NULL, F.col("d")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next")
