"""Alignment, hard negatives and byte-level BPE against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealens.llm import alignment, byte_bpe, hard_negatives, memo
from arealens.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATH_A, PATH_B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
ODD = ["", "a", "ab  c", "a\tb\nc d", " x", "x ", "é😀▁q", "A<unk></s> <|endoftext|>", "ﬁ Ⅷ ｱ", "<0x41>", "\x00a", " ", "word " * 300]


# --- alignment ------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.ByteLevel(PATH_A), alignment.Pieces(PATH_B))


def plain(aligner, texts):
    """Both tokenizers on whole texts."""
    a, b = aligner.a, aligner.b
    return brute.alignment(texts, lambda t: a.tokenizer.encode(" " + t, add_special_tokens=False).ids, a.bytes,
                           lambda t: b.tokenizer.encode(t), b.bytes)


def found_in(aligner, rows):
    w = aligner.width
    return [(*r[:5], {(int(p) // w, int(p) % w): int(n) for p, n in zip(r[5], r[6])}) for r in rows]


@given(st.lists(st.text(st.sampled_from("aeinot .,\n\téß漢😀▁1<>"), max_size=60), max_size=6))
@settings(max_examples=40, deadline=None)
def test_alignment_equals_plain_ranges(aligner, texts):
    got, (pairs, holders) = aligner.block(texts)
    want = plain(aligner, texts)
    assert found_in(aligner, got) == want
    counts = {}
    for *_, links in want:
        for a, b in links:
            counts[a * aligner.width + b] = counts.get(a * aligner.width + b, 0) + 1
    assert dict(zip(pairs.tolist(), holders.tolist())) == counts


def test_pointer_jumping_labels_components():
    rng = random.Random(3)
    for _ in range(30):
        total = rng.randint(1, 400)
        cuts = [np.array(sorted({*rng.sample(range(1, total), rng.randint(0, total - 1)), total})) for _ in range(2)]
        last, b_of_a, _ = alignment.terminals(*cuts)
        shared = np.intersect1d(*cuts)
        for ends, labels in ((cuts[0], last[:len(cuts[0])]), (cuts[1], last[len(cuts[0]):])):
            assert (cuts[1][labels - len(cuts[0])] == shared[np.searchsorted(shared, ends)]).all()


@pytest.mark.parametrize("hot", [500_000, 60, 0])
def test_alignment_query_equals_plain(spark, aligner, monkeypatch, hot):
    """However few pairs are broadcast, the rest is joined."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    texts = [*ODD, None] + [t[:600] for (t,) in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(30).collect() if t]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[-1], 1, "x"), (3, texts[3], 1, "x")],
                                 "doc_id long, text string, pair int, groups string")
    all_texts = [r["text"] for r in docs.collect()]
    want = plain(aligner, all_texts)
    scores = brute.link_scores(want)
    ids = [r["doc_id"] for r in docs.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in alignment.align(docs, PATH_A, PATH_B).collect()), key=key)
    assert got == sorted(((i, *w[:4], *s, w[4]) for i, w, s in zip(ids, want, scores)), key=key)
    sha = {(r["doc_id"], r["groups"]) for r in alignment.align(docs, PATH_A, PATH_B, digest=True).collect()}
    assert sha == {(i, w[4] and hashlib.sha256(w[4].encode()).hexdigest()) for i, w in zip(ids, want)}


def test_alignment_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, PATH_A, PATH_B).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.align(nothing, PATH_A, PATH_B).collect()} == {
        (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")}


# --- hard negatives ---------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<double>, id int, n int, block int, score int"


def negatives(spark, data, anchor=lambda i: i % 3 == 0):
    rows = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in data], VECTORS)
    out = {}
    for r in hard_negatives.mine(rows, "vec_id", "label", "embedding", F.col("id") % 3 == 0).orderBy("rank").collect():
        out.setdefault((r["anchor_id"], r["positive_id"]), []).append((r["negative_id"], r["positive_score"], r["negative_score"]))
    return out


@pytest.mark.parametrize(("values", "block"), [(262_144, 2_048), (640, 5)])
def test_hard_negatives_equal_plain(spark, monkeypatch, values, block):
    """Also with many small buckets and blocks, a label with most rows, copies, zero and odd vectors."""
    monkeypatch.setattr(hard_negatives, "BUCKET_VALUES", values)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 10))
    data = []
    for i in range(400):
        c = int(rng.integers(0, 4))
        v = (centres[c] + 0.3 * rng.standard_normal(10)) * rng.choice([0.2, 1.0, 3.0])
        data.append((i, int(rng.choice([1, 1, 1, c + 2, 50 + i // 100])), v.tolist()))
    data += [(400 + i, 1, data[7][2]) for i in range(30)]  # copies of one vector: ties
    data += [(501, 2, [0.0] * 10), (504, 1, [0.0] * 10), (507, 1, None), (510, None, [1.0] * 10), (None, 1, [1.0] * 10),
             (513, 1, [float("nan")] + [1.0] * 9), (516, 1, [float("inf")] + [1.0] * 9), (519, 1, [None] + [1.0] * 9),
             (522, 1, [1.0] * 4), (525, 1, []), (528, 1, [1e300] * 10), (531, 7, [-x for x in data[0][2]])]
    used = [r for r in data if r[0] not in (522, 525, 528)]
    want = brute.hard_negatives(used, lambda i: i % 3 == 0)
    assert want and negatives(spark, data + data[:5]) == want  # repeated rows are one


def test_hard_negatives_large_numbers_are_exact(spark):
    rng = np.random.default_rng(4)
    data = [(i, i % 2, (rng.standard_normal(4) * 2.0**20 + 2.0**21).tolist()) for i in range(40)]
    assert negatives(spark, data) == brute.hard_negatives(data, lambda i: i % 3 == 0)


def test_hard_negatives_edge_tables(spark):
    assert negatives(spark, []) == {}
    assert negatives(spark, [(0, 1, [1.0, 2.0])]) == {}
    assert negatives(spark, [(0, 1, [1.0]), (3, 1, [1.0]), (1, 2, [0.9]), (2, 3, None)]) == {
        (0, 3): [(1, 65536, 58880)], (3, 0): [(1, 65536, 58880)]}


def test_ranges_hold_every_row_that_reaches_the_bound():
    """The coordinate ranges lose no row, and for high bounds they leave few others."""
    rng = np.random.default_rng(8)
    dim, n = 16, 500
    base = rng.standard_normal((5, dim))
    v = np.floor(256 * (base[rng.integers(0, 5, n)] + 0.2 * rng.standard_normal((n, dim)))).astype("i8")
    length = np.sqrt((v.astype("f8") ** 2).sum(1))
    unit = (v / length[:, None]).T
    order = np.argsort(unit, axis=1, kind="stable")
    bucket = hard_negatives.Bucket({
        "ids": np.arange(n).tobytes(), "of": np.zeros(n, "i8").tobytes(), "vectors": v.tobytes(), "longest": float(length.max()),
        "members": order.astype("i4").tobytes(), "points": np.take_along_axis(unit, order, 1).astype("f4").tobytes()}, dim)
    left = 0
    for cosine in (0.2, 0.7, 0.9, 0.97):
        q = unit.T[:20]
        focus, first, end = bucket.feasible(q, np.full(20, cosine))
        for j in range(20):
            rows = bucket.candidates(focus[j], first[j], end[j])
            assert set(np.flatnonzero(unit.T @ q[j] >= cosine)) <= set(rows.tolist())
            left += len(rows) * (cosine == 0.97)
    assert left < 0.5 * 20 * n


# --- byte-level BPE -----------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.merger.ranks, special_tokens={})


def as_ids(data):
    return np.frombuffer(data, "<u4").tolist()


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_library_and_plain(encoder, library, texts):
    got = encoder(texts)
    assert [as_ids(x) for x in got] == [library.encode_ordinary(t) for t in texts]
    words = regex.compile(public_tokenizers.PATTERN).findall
    assert [as_ids(x) for x in got] == [[i for w in words(t) for i in brute.byte_bpe(w.encode(), encoder.merger.ranks)] for t in texts]
    assert encoder.merger.decode(got) == [t.encode() for t in texts]


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 700, "=" * 999, "!?" * 400 + "=" * 100, "漢字" * 150, "mississippi" * 40,
                                  "".join(random.Random(1).choice("etaoin") for _ in range(900))])
def test_bpe_long_words(encoder, library, monkeypatch, word):
    monkeypatch.setattr(byte_bpe, "QUERY_ROWS", 20_000)  # several queries a word
    encoder.memo.forget()
    assert as_ids(encoder([word])[0]) == library.encode_ordinary(word)


def test_bpe_forgets_words_without_harm(encoder, library, monkeypatch):
    monkeypatch.setattr(memo, "KNOWN_WORDS", 20)
    for at in range(0, 60, 6):
        texts = [f"wordle{i} common zyx{i * 7}" for i in range(at, at + 6)]
        assert [as_ids(x) for x in encoder(texts)] == [library.encode_ordinary(t) for t in texts]
    encoder.memo.forget()


def test_bpe_query_round_trip(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, SMALL).collect()}
    want = {}
    for d, text in docs.items():
        ids = library.encode_ordinary(text)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_bpe_edge_tables(spark, library):
    schema = "doc_id long, text string, ids string, bytes int"
    run = lambda rows: byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, schema), RANKS, public_tokenizers.PATTERN), RANKS)
    assert run([]).count() == 0
    rows = [(1, None, "x", 1), (None, "", "x", 1), (2, "same text", "x", 1), (2, "same text", "x", 1), (3, "<|endoftext|>", "x", 1),
            (4, "long words " * 20_000, "x", 1)]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], as_ids(bytes(r["ids"])), bytes(r["bytes"])) for r in run(rows).collect())
    want = sorted((d or 0, len(library.encode_ordinary(t or "")), library.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in rows)
    assert got == want
    with pytest.raises(ValueError):
        byte_bpe.Merger(RANKS).decode([np.array([50256], "<u4").tobytes()])


def test_rank_file_is_read(tmp_path):
    path = tmp_path / "own.tiktoken"
    entries = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path.write_bytes(b"".join(base64.b64encode(e) + b" %d\n" % i for i, e in enumerate(entries)))
    small = byte_bpe.Encoder(str(path), r"\S+|\s+")
    assert as_ids(small(["abcab abd"])[0]) == [257, 256, 32, 256, 100]
