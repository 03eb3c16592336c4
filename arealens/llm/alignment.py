"""Cross-tokenizer alignment by pointer jumping.

Tokenizers A and B cut the same bytes.  Every token points to the token of the
other tokenizer that overlaps it and reaches farthest to the right; a token that
ends where its partner ends closes a group.  Doubling the pointers of all tokens
at once (``succ = succ[succ]``) takes each token to the last token of its
connected component, which labels its group: the tokens between two byte offsets
at which both tokenizers end a token.

1. Each task aligns blocks of documents, every distinct segment once, and writes, for every document, its counts,
   its groups and its distinct linked id pairs, and for every block how many of its
   documents hold each pair.
2. The blocks' counts are summed for each pair, and each A id gets the highest
   count of its pairs.
3. A document's pairs meet these counts.  Pairs are split by count: the most frequent
   ones, at most ``HOT_PAIRS``, are broadcast; the others, which no large share of the
   documents holds, are joined by a shuffle.  All pairs take part.

Defined results
* null and empty texts, texts whose joined token bytes of A or B differ from space +
  text, and texts with a token without bytes: no tokens, zeros, groups '';
* ties: all pairs with an A id's highest count are best;
* repeated rows count as documents of their own; null doc_ids stay null;
* empty table: empty result; extra columns are ignored;
* a text of any length is aligned whole and is alone in its block if it is long.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, byte_level_alphabet, written
from .memo import Memo, slices

BLOCK_CHARS = 2_000_000  # texts aligned at once
HOT_PAIRS = 500_000  # pairs that are broadcast: at most 24 MB at 48 bytes each
_PAIR_BYTES = 48
TOGETHER = 500  # segments that are encoded in one call

_ROWS = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
         "pairs array<bigint>, times array<int>")


class ByteLevel:
    """Tokenizer A: ids of a spaced text (one that begins with its space), and the bytes of every id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = byte_level_alphabet()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for entry, i in self.tokenizer.get_vocab().items():
            if all(c in byte_of for c in entry):
                self.bytes[i] = bytes(byte_of[c] for c in entry)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        # its words take a space only before other characters, or among white space
        self.by_words = (cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
                         and not spec.get("normalizer"))

    def encode(self, spaced: list[str]) -> list[list[int]]:
        """Segments that end in another character than white space are encoded some hundred at once."""
        if not self.by_words:
            return [x.ids for x in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]
        out: list = [None] * len(spaced)
        inner = [i for i, s in enumerate(spaced) if not s[-1].isspace()]
        alone = [i for i, s in enumerate(spaced) if s[-1].isspace()]
        groups = [inner[k:k + TOGETHER] for k in range(0, len(inner), TOGETHER)]
        joined = self.tokenizer.encode_batch_fast(["".join([spaced[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, joined):
            ids = found.ids
            ends = np.cumsum([len(self.bytes[i]) for i in ids])
            cut = np.searchsorted(ends, np.cumsum([len(spaced[i].encode()) for i in group]))
            if cut[-1] == len(ids) - 1 and (np.diff(cut) > 0).all():
                first = 0
                for i, last in zip(group, cut.tolist()):
                    out[i] = ids[first:last + 1]
                    first = last + 1
            else:  # bytes were lost: one by one shows of which segment
                alone += group
        for i, x in zip(alone, self.tokenizer.encode_batch_fast([spaced[i] for i in alone], add_special_tokens=False)):
            out[i] = x.ids
        return out


class Pieces:
    """Tokenizer B, which puts a space before what it is given: ids of a spaced text, and the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_file=path)
        names = self.tokenizer.id_to_piece(list(range(self.tokenizer.get_piece_size())))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.tokenizer.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)]
        # no piece has a space after another character
        self.by_words = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return self.tokenizer.encode([s[1:] for s in spaced], num_threads=1)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terminal of every A token, then of every B token; for each A token the B token at its last byte; the
    reverse), from the byte offsets at which tokens end.  Tokens of B are numbered after those of A."""
    n = len(ends_a)
    b_of_a, a_of_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    shared = ends_a[a_of_b] == ends_b
    succ = np.concatenate([n + b_of_a, np.where(shared, n + np.arange(len(ends_b)), a_of_b)])
    while True:
        far = succ[succ]
        if np.array_equal(far, succ):
            return far, b_of_a, a_of_b
        succ = far


class Aligner:
    """Aligns blocks of texts.

    Texts are cut into segments where a space follows another character than white space: no token of either
    tokenizer crosses such a place, so both end tokens there, and a segment is aligned once however often it
    occurs.  For tokenizers of other kinds a segment is the whole text."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.bytes], "i8") for t in (a, b)]
        texts = [[str(i) for i in range(len(t.bytes))] for t in (a, b)]
        # an id as text with what follows it: A's within and at the end of a group, B's likewise
        self.names = [np.array([x + c for c in ends for x in names], object) for names, ends in zip(texts, (",|", ",;"))]
        self.width = len(b.bytes)
        self.find = re.compile(r" \s*\S+(?:(?! )\s+\S+)*(?:\s+\Z)?|\s+\Z" if a.by_words and b.by_words else r"(?s).+").findall
        self.memo = Memo(self.segments)

    def segments(self, spaced: list[str]) -> tuple[np.ndarray, ...]:
        """The linked pairs of each segment (A's id times B's vocabulary size plus B's id) as ``Memo`` keeps them,
        then n_a, n_b, n_groups, the groups as text, and whether a tokenizer loses bytes of it."""
        lost = np.zeros(len(spaced), bool)
        want = [s.encode() for s in spaced]
        flat, counts = [], []
        for t, size in zip((self.a, self.b), self.sizes):
            found = t.encode(spaced)
            n = np.array([len(x) for x in found], "i8")
            ids = np.fromiter(chain.from_iterable(found), "i8", int(n.sum()))
            ends, joined = np.concatenate([[0], np.cumsum(size[ids])]), b"".join(map(t.bytes.__getitem__, ids.tolist()))
            cut = ends[np.concatenate([[0], np.cumsum(n)])].tolist()
            lost |= np.array([joined[x:y] != w for x, y, w in zip(cut, cut[1:], want)], bool)
            lost |= np.diff(np.concatenate([[0], np.cumsum(size[ids] == 0)])[np.concatenate([[0], np.cumsum(n)])]) > 0
            flat.append(ids)
            counts.append(n)
        a, b = (ids[np.repeat(~lost, n)] for ids, n in zip(flat, counts))
        n_a, n_b = (np.where(lost, 0, n) for n in counts)
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        last, b_of_a, a_of_b = terminals(ends_a, ends_b)
        closes_b = last[len(a):] == len(a) + np.arange(len(b))
        closes_a = ends_b[b_of_a] == ends_a
        number = np.cumsum(closes_b) - 1  # of the group that a token of B closes
        group_a, group_b = number[last[:len(a)] - len(a)], number[last[len(a):] - len(a)]
        # groups as text: A's tokens of a group, then B's
        place = np.empty(len(a) + len(b), object)
        place[np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(closes_b) + 1])[group_a]] = \
            self.names[0][a + closes_a * len(self.a.bytes)]
        place[np.arange(len(b)) + (np.flatnonzero(closes_a) + 1)[group_b]] = self.names[1][b + closes_b * self.width]
        of_a, of_b = (np.repeat(np.arange(len(spaced)), n) for n in (n_a, n_b))
        edge = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        tokens = place.tolist()
        texts = np.empty(len(spaced), object)
        texts[:] = ["".join(tokens[x:y]) for x, y in zip(edge, edge[1:])]
        # an overlap of two tokens ends where one of them ends
        open_b = ~closes_b
        pair = np.concatenate([a * self.width + b[b_of_a], a[a_of_b[open_b]] * self.width + b[open_b]])
        of = np.concatenate([of_a, of_b[open_b]])
        size = np.bincount(of, minlength=len(spaced))
        n_groups = np.bincount(of_b[closes_b], minlength=len(spaced))
        return pair[np.argsort(of, kind="stable")], np.cumsum(size) - size, size, n_a, n_b, n_groups, texts, lost

    def block(self, texts: list[str | None]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        """For each text (n_a, n_b, n_groups, n_links, groups, pairs, times); and the block's pairs with the
        number of texts that hold them."""
        slot, words = self.memo.look_up([self.find(" " + t) if t else [] for t in texts])
        n_a, n_b, n_groups, names, lost = self.memo.kept[3:]
        whole = self.memo.sums(lost.astype("i8"), slot, words) == 0
        slot, words = slot[np.repeat(whole, words)], np.where(whole, words, 0)
        counts = [self.memo.sums(c, slot, words).tolist() for c in (n_a, n_b, n_groups)]
        n_pairs = self.memo.sums(self.memo.kept[2], slot, words)
        span = len(self.a.bytes) * self.width
        held, times = np.unique(np.repeat(np.arange(len(texts)), n_pairs) * span + self.memo.values(slot), return_counts=True)
        doc_of, pair_of, times = held // span, held % span, times.astype("i4")
        cut = np.searchsorted(doc_of, np.arange(len(texts) + 1)).tolist()
        edge = np.concatenate([[0], np.cumsum(words)]).tolist()
        parts = names[slot].tolist()
        out = [(a, b, g, a + b - g, "".join(parts[edge[i]:edge[i + 1]])[:-1], pair_of[cut[i]:cut[i + 1]], times[cut[i]:cut[i + 1]])
               for i, (a, b, g) in enumerate(zip(*counts))]
        return out, np.unique(pair_of, return_counts=True)


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """A row for each document (row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times), and one for each
    block, without ``row``, whose ``times`` say how many of its documents hold a pair.  With ``digest``,
    ``groups`` has the SHA-256 of the text instead ('' without tokens)."""

    def lists(arrays, kind):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            aligner = aligner or Aligner(ByteLevel(path_a), Pieces(path_b))
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in slices([len(t or "") for t in texts], BLOCK_CHARS):
                found, (pairs, holders) = aligner.block(texts[start:end])
                n_a, n_b, n_groups, n_links, groups, own, times = zip(*found)
                if digest:
                    groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*range(row, row + end - start), None], pa.int64()), pa.array([*ids[start:end], None], pa.int64()),
                     *[pa.array([*x, 0], pa.int64()) for x in (n_a, n_b, n_groups, n_links)], pa.array([*groups, ""], pa.string()),
                     lists([*own, pairs], pa.int64()), lists([*times, holders], pa.int32())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                row += end - start

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, _ROWS)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether its A id has no pair with more."""
    listed = rows.where("row is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = written(listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "align-counts")
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    top = broadcast_if_small(most, most.count(), 32)  # at most a row for each id of A
    return counts.join(top, F.expr(f"pair div {width} = a")).selectExpr("pair", "n", "n = most as best")


def _sums(links: DataFrame, counts: DataFrame) -> DataFrame:
    return (links.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every document; see ``aligned``
    for ``digest``."""
    rows = written(aligned(docs, path_a, path_b, digest), "align-rows")
    counts = written(pair_counts(rows, len(Pieces(path_b).bytes)), "align-pairs")
    # the least power of two from which on at most HOT_PAIRS pairs have as high a count
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()
    hot = total = 0
    floor = None
    for r in levels:
        total += r["count"]
        if total > HOT_PAIRS:
            break
        hot, floor = total, r["level"]
    links = (rows.where("row is not null").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
             .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("bigint").alias("times")))
    everything = floor == levels[-1]["level"] if levels else True
    above = F.lit(floor is not None) if floor is None else F.col("n") >= 2**floor
    often = broadcast_if_small(counts.where(above), hot, _PAIR_BYTES)
    sums = _sums(links, often)
    if not everything:
        rest = links.join(broadcast_if_small(counts.where(above).select("pair"), hot, _PAIR_BYTES), "pair", "left_anti")
        sums = (sums.union(_sums(rest, counts.where(~above))).groupBy("row")
                .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (rows.where("row is not null").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups"))
