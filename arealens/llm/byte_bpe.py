"""Byte-level BPE encoding and decoding with recursive DuckDB queries in the tasks.

Encoding.  A text is cut by the tokenizer's pattern; each match is a word of its
own.  The distinct words of a batch that are no vocabulary entry become rows
(word, position, token), one for each byte.  A recursive query joins neighbouring
rows with the merge table and contracts the leftmost pair of least rank of every
word, until no pair of any word is in the table.  Distinct words are contracted
once; their ids are then laid out in the order of the text.

Merge table: every way to cut an entry into two entries gives a row, the two packed
into one number and the entry; the entry's id is its rank.  Ranks stay below 65,536.

Long words (over ``LONG`` bytes) contract every pair of least rank in one step where
that equals doing so from the left one by one: where no entry that begins or ends
with the new token ranks before it.  They run ``rounds`` steps a query, so that a
query's rows stay under ``QUERY_ROWS`` and a word of any length fits.

Decoding.  Rows (document, position, id) join the vocabulary, and an aggregation over
the ordered rows puts each document's bytes together.

Defined results
* null and empty texts: no ids, no bytes; empty table: empty result;
* ties in rank: the leftmost pair; texts of any length are encoded whole;
* repeated rows and null doc_ids: a row for each row; extra columns are ignored;
* strings of special tokens are plain text; an id outside the vocabulary raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memo import Memo, places, slices

LONG = 64
QUERY_ROWS = 2_000_000  # rows that one recursive query may make in all its steps
BLOCK_CHARS = 1_000_000  # texts handled at once
MEMORY = "400MB"

# A row's place ``g`` holds its word and, in the last 12 bits, its position in the word.  One step: each word's
# pair of least rank, the leftmost of several, becomes one row; a word without pairs leaves the recursion.
_STEPS = """
WITH RECURSIVE steps(live, g, t) AS (
  SELECT true, g, t FROM base
  UNION ALL
  SELECT b IS NOT NULL, g, CASE WHEN g & 4095 = (b >> 12) & 4095 THEN (b >> 24)::INT ELSE t END FROM (
    WITH pairs AS (SELECT g, t, lead(t) OVER o AS r, lead(g) OVER o AS q FROM steps WHERE live WINDOW o AS (ORDER BY g)),
    best AS (SELECT g >> 12 AS w, min((m::BIGINT << 24) | ((g & 4095) << 12) | (q & 4095)) AS b
             FROM pairs JOIN merges ON t::BIGINT * 65536 + r = lr WHERE g >> 12 = q >> 12 GROUP BY w)
    SELECT g, t, b FROM pairs LEFT JOIN best ON g >> 12 = w WHERE b IS NULL OR g & 4095 <> b & 4095))
SELECT g >> 12 AS w, t FROM steps WHERE NOT live ORDER BY g
"""

# The same, but a token that no entry overtakes takes all its pairs: of neighbouring ones the first, third, ...
_LONG_STEPS = """
WITH RECURSIVE steps(k, w, p, t) AS (
  SELECT 0, w, p, t FROM base
  UNION ALL
  SELECT k + 1, w, p, t FROM (
    WITH pairs AS (SELECT k, w, p, t, lead(t) OVER o AS r, row_number() OVER o AS i
                   FROM steps WINDOW o AS (PARTITION BY w ORDER BY p)),
    ranked AS (SELECT pairs.*, m, min(m) OVER (PARTITION BY w) AS best
               FROM pairs LEFT JOIN merges ON t::BIGINT * 65536 + r = lr),
    runs AS (SELECT *, m IS NOT DISTINCT FROM best AS hit,
                    i - row_number() OVER (PARTITION BY w, m IS NOT DISTINCT FROM best ORDER BY i) AS run
             FROM ranked WHERE best IS NOT NULL),
    taken AS (SELECT *, hit AND (row_number() OVER (PARTITION BY w, hit, run ORDER BY i)) % 2 = 1
                        AND (best NOT IN (SELECT t FROM overtaken) OR i = min(CASE WHEN hit THEN i END) OVER (PARTITION BY w)) AS here
              FROM runs)
    SELECT k, w, p, CASE WHEN here THEN best ELSE t END AS t
    FROM (SELECT *, lag(here, 1, false) OVER (PARTITION BY w ORDER BY i) AS gone FROM taken) WHERE NOT gone)
  WHERE k < {rounds})
SELECT w, p, t, k FROM steps QUALIFY k = max(k) OVER (PARTITION BY w) ORDER BY w, p
"""

_DECODE = """
SELECT d, unhex(string_agg(h, '')) AS b FROM (SELECT d, h FROM ids JOIN vocabulary USING (t) ORDER BY d, p)
GROUP BY d ORDER BY d
"""


def ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a rank file: a line holds the entry in base64 and its rank."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values, "i4"))


class Merger:
    """A DuckDB connection that holds the merge table and the vocabulary."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks(path)
        if max(self.ranks.values()) >= 65_536:
            raise ValueError("ranks have to be below 65,536")
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], "i4")
        self.whole = {}  # entries that a word can be
        for entry, i in self.ranks.items():
            try:
                self.whole[entry.decode()] = i
            except UnicodeDecodeError:
                pass
        self.known = np.fromiter(self.ranks.values(), "i4", len(self.ranks))
        cuts = [(self.ranks[e[:i]], self.ranks[e[i:]], m) for e, m in self.ranks.items()
                for i in range(1, len(e)) if e[:i] in self.ranks and e[i:] in self.ranks]
        left, right, merged = np.array(cuts or np.zeros((0, 3)), "i4").reshape(-1, 3).T
        late = np.concatenate([left[left > merged], right[right > merged]])
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for name, table in (
                ("merges", pa.table({"lr": left.astype("i8") * 65_536 + right, "m": merged})),
                ("overtaken", pa.table({"t": np.unique(late)})),
                ("vocabulary", pa.table({"t": _ints(self.known), "h": [e.hex() for e in self.ranks]}))):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _run(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contract(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words one after the other, and how many each has, from their bytes and sizes."""
        w = np.repeat(np.arange(len(size)), size)
        p = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        found = self._run(_STEPS, "base", pa.table({"g": w << 12 | p, "t": self.bytes[letters]}))
        return found["t"].to_numpy(), np.bincount(found["w"].to_numpy(), minlength=len(size))

    def contract_long(self, letters: np.ndarray) -> np.ndarray:
        """The ids of one long word, some steps at a time, from its bytes."""
        t = self.bytes[letters]
        while True:
            rounds = max(1, QUERY_ROWS // len(t))
            base = pa.table({"w": np.zeros(len(t), "i4"), "p": np.arange(len(t), dtype="i4"), "t": t})
            found = self._run(_LONG_STEPS.format(rounds=rounds), "base", base)
            t = found["t"].to_numpy()
            if found["k"][0].as_py() < rounds:
                return t

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where the ids of each of some distinct words begin in them and how many there are."""
        column = pa.array(words, pa.large_string())
        edge = np.frombuffer(column.buffers()[1], "i8", len(words) + 1)
        letters = np.frombuffer(column.buffers()[2] or b"", "u1")
        length = np.diff(edge)
        whole = np.array([self.whole.get(w, -1) for w in words], "i4")
        begin, size = np.zeros(len(words), "i8"), np.ones(len(words), "i8")
        entries = np.flatnonzero(whole >= 0)
        begin[entries] = np.arange(len(entries))
        parts, at = [whole[entries]], len(entries)
        short = np.flatnonzero((whole < 0) & (length <= LONG))
        n = length[short]
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(n * (n + 1) // 2) // QUERY_ROWS)) + 1):
            if len(some):
                n = length[some]
                ids, size[some] = self.contract(letters[places(edge[some], n)], n)
                begin[some] = at + np.cumsum(size[some]) - size[some]
                parts.append(ids)
                at += len(ids)
        for i in np.flatnonzero((whole < 0) & (length > LONG)).tolist():
            ids = self.contract_long(letters[edge[i]:edge[i + 1]])
            begin[i], size[i] = at, len(ids)
            parts.append(ids)
            at += len(ids)
        return np.concatenate(parts), begin, size

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each of some documents' ids (little-endian unsigned 32-bit)."""
        size = np.array([len(x) // 4 for x in ids], "i8")
        flat = np.frombuffer(b"".join(ids), "<u4").astype("i4")
        d = np.repeat(np.arange(len(ids)), size)
        if not np.isin(flat, self.known, kind="table").all():
            raise ValueError("an id is not in the vocabulary")
        p = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        found = self._run(_DECODE, "ids", pa.table({"d": _ints(d), "p": _ints(p), "t": flat}))
        out = [b""] * len(ids)
        for at, b in zip(found["d"].to_pylist(), found["b"].to_pylist()):
            out[at] = b
        return out


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.merger = Merger(path)
        self.memo = Memo(self.merger.words)

    def __call__(self, texts: list[str]) -> list[bytes]:
        slot, words = self.memo.look_up([self.find(t) if t else [] for t in texts])
        ids, size = self.memo.values(slot).astype("<u4"), self.memo.sums(self.memo.kept[2], slot, words)
        ends = np.cumsum(size)
        return [ids[a:b].tobytes() for a, b in zip(ends - size, ends)]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(ranks_path, pattern)
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, BLOCK_CHARS):
                ids = encoder(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for batch in batches:
            merger = merger or Merger(ranks_path)
            sizes = pa.compute.binary_length(batch.column(2)).fill_null(0).to_pylist()
            for a, b in slices(sizes, BLOCK_CHARS):
                part = batch.slice(a, b - a)
                out = merger.decode([x or b"" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids", "bytes"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary, bytes binary")
