"""Packing by concatenate and cut.

Pass 1 tokenises every document and writes its ids with the document's place in
its partition: the running token count before it.  The token totals of the
partitions, one number each, give every partition its global offset by a prefix
sum.  Pass 2 adds the offset and cuts the endless row of ids into windows of
``window`` ids; a document that crosses a cut leaves one record on each side.

All sequences are full but the last one, so padding is below one window in all.

Defined results
* null text counts as empty: only the closing id; there are no ties;
* empty table: no pieces;
* repeated rows are packed once each; a null doc_id is kept as null;
* a text of any length is one row of ids and is cut into as many pieces as needed;
* extra columns are ignored.

Word encoder: the tokenizer file's normaliser and splitter work within runs of
non-space characters, so ids of a run do not depend on its neighbours.  A task
encodes each distinct run once and lays the ids out in the order of the texts.  A tokenizer with other rules is run on whole
texts instead.
"""

from __future__ import annotations

import array
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, byte_level_alphabet, written
from .memo import Memo, slices

WINDOW = 2048
CLOSING_ID = 1
BLOCK_BYTES = 4_000_000  # texts encoded at once

# Marks that a run can be cut at: not where an apostrophe joins letters, nor the start of a special token.
# Fixed values of the tokenizer file for which run-by-run encoding is exact.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_HEAD = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_TAIL = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def _by_runs(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (steps == ["NFC", "Replace", "Lowercase"] and cut[0].get("pattern", {}).get("Regex") == _SPLIT
            and cut[-1].get("type") == "ByteLevel" and not cut[-1].get("add_prefix_space", True)
            and spec.get("post_processor") is None)


class _Runs:
    """Ids of runs of characters other than white space, which are cut into pieces that recur more often."""

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize, self.pieces = tokenizer, tokenizer.model.tokenize, Memo(self.ids)
        # a text's bytes, read as Latin-1, to the characters that stand for them
        self.alphabet = {b: c for c, b in byte_level_alphabet().items()}

    def cut(self, runs: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of the runs, and how many each has: marks before and after a word of letters are words of
        their own for the splitter; other runs stay whole."""
        pieces, ends = [], array.array("q")
        for run in runs:
            if run.isalpha():
                pieces.append(run.lower() if run.isascii() else run)
            else:
                right = run.rstrip(_TAIL)
                word = right.lstrip(_HEAD)
                if word.isalpha():
                    if len(word) < len(right):
                        pieces.append(right[:len(right) - len(word)])
                    pieces.append(word.lower() if word.isascii() else word)
                    if len(right) < len(run):
                        pieces.append(run[len(right):])
                else:
                    pieces.append(run)
            ends.append(len(pieces))
        return pieces, np.diff(np.frombuffer(ends, "i8"), prepend=0) if runs else np.zeros(0, "i8")

    def one(self, piece: str) -> list[int]:
        if piece.isascii():
            if piece.isalpha() and piece.islower():
                return [t.id for t in self.tokenize(piece)]
        else:
            plain = self.tokenizer.normalizer.normalize_str(piece)
            if plain.isalpha():
                return [t.id for t in self.tokenize(plain.encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, ends = array.array("I"), [0]
        for piece in pieces:
            flat.extend(self.one(piece))
            ends.append(len(flat))
        ends = np.array(ends, "i8")
        return np.frombuffer(flat, "u4") if flat else np.zeros(0, "u4"), ends[:-1], np.diff(ends)

    def __call__(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces, n = self.cut(runs)
        slot = self.pieces.slots_of(pa.array(pieces, pa.large_string()))
        size = self.pieces.sums(self.pieces.kept[2], slot, n)
        return self.pieces.values(slot), np.cumsum(size) - size, size


def encoder(path: str):
    """A function from an array of texts to their ids one after the other, and how many each has."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not _by_runs(path):
        def plain(texts):
            found = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            size = np.array([len(x) for x in found], "i8")
            return np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size

        return plain
    memo = Memo(_Runs(tokenizer))

    def encode(texts):
        runs = pc.ascii_split_whitespace(texts)
        slot = memo.slots_of(runs.flatten())
        return memo.values(slot), memo.sums(memo.kept[2], slot, pc.list_value_length(runs).to_numpy(zero_copy_only=False))

    return encode


_TOKENS = "doc_id bigint, ids binary, n bigint, part int, before bigint"


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pass 1: (doc_id, ids, n, part, before) with the running count in each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for first, end in slices(lengths, BLOCK_BYTES):
                some = batch.slice(first, end - first)
                ids, n = encode(some.column(1).fill_null(""))
                last = np.cumsum(n)
                closed = np.insert(ids, last, CLOSING_ID)  # each document's closing id
                n = n + 1
                last = np.cumsum(n)
                values = pa.BinaryArray.from_buffers(pa.large_binary(), len(n), [
                    None, pa.py_buffer(np.concatenate([[0], last]) * 4), pa.py_buffer(closed.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), values.cast(pa.binary()), pa.array(n, pa.int64()),
                     pa.array(np.full(len(n), part, "i4")), pa.array(before + last - n, pa.int64())],
                    names=["doc_id", "ids", "n", "part", "before"])
                before += int(n.sum())

    return docs.select("doc_id", "text").mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """The pieces: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer_path), "pack-tokens")
    totals = sorted((r["part"], r["total"]) for r in
                    tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())  # one number per partition
    offsets, at = [], 0
    for part, total in totals:
        offsets.append((part, at))
        at += total
    table = broadcast_if_small(spark.createDataFrame(offsets, "part int, shift bigint"), len(offsets), 16)
    g = F.col("shift") + F.col("before")
    placed = tokens.join(table, "part").select("doc_id", "ids", "n", g.alias("g"))
    cut = placed.withColumn("sequence_id", F.explode(F.expr(
        f"sequence(g div {window}, (g + n - 1) div {window})")))
    begin = F.greatest(F.col("g"), F.col("sequence_id") * window)
    end = F.least(F.col("g") + F.col("n"), (F.col("sequence_id") + 1) * window)
    piece = cut.select("doc_id", "ids", (begin - F.col("g")).alias("start"), (end - begin).alias("length"),
                       F.col("n").alias("doc_tokens"), "sequence_id",
                       (begin - F.col("sequence_id") * window).alias("offset"))
    return piece.withColumn("ids", F.substring("ids", (F.col("start") * 4 + 1).cast("int"),
                                               (F.col("length") * 4).cast("int")))


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, n, ids): the windows themselves; each gathers at most ``window`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: F.hex(p["ids"])), F.lit(""), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.unhex(joined).alias("ids"))
