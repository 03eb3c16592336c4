"""Hashed words of texts, in blocks, for the operators on word sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import WORD_PATTERN

_WORD = re.compile(WORD_PATTERN)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLOCK_CHARS = 1_500_000  # texts are handled in blocks of about so many characters

# Odd multipliers of the two window hashes and of the final mix.
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def split(text: str | None, lower: bool = False) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if lower else text) if text else []


class Block:
    """The words of some documents one after the other: ``hashes``, and where each document begins."""

    def __init__(self, ids: list, texts: list, lower: bool = False):
        from xxhash import xxh3_64_intdigest

        words = [split(t, lower) for t in texts]
        self.ids = ids
        self.sizes = np.array([len(w) for w in words], "i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.hashes = np.fromiter((xxh3_64_intdigest(x) for w in words for x in w), "u8", int(self.sizes.sum()))

    def windows(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each place of ``at`` (places count from the block's first word)."""
        h = np.full(len(at), size, "u8")
        for j in range(size):
            h = h * _STEP[which] + self.hashes[at + j]
        return mix(h)

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Document number and place in the document of every window of ``size`` words."""
        n = np.maximum(0, self.sizes - size + 1)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)


def blocks(batch: pa.RecordBatch, lower: bool = False) -> Iterator[tuple[Block, int, int]]:
    """Blocks of a batch (id, text, ...) with their first row and row count."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    first, chars = 0, 0
    sizes = texts.to_pylist()
    for i, text in enumerate(sizes):
        chars += len(text or "")
        if chars >= BLOCK_CHARS or i == len(sizes) - 1:
            yield Block(ids[first:i + 1], sizes[first:i + 1], lower), first, i + 1 - first
            first, chars = i + 1, 0


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Distinct keys, each with the list of its (value, ...) tuples one after the other, in stable order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    flat = np.empty(len(keys) * len(values), "i8")
    for k, v in enumerate(values):
        flat[k::len(values)] = v[order]
    offsets = np.concatenate([heads, [len(keys)]]) * len(values)
    return keys[heads], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
