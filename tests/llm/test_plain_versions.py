"""Fingerprints, language ID, packing and nearest neighbours against independent plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.llm import ann, fingerprints, language_id
from arealens.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_fingerprint_query_equals_plain_parse(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(order)
    own = {d: brute.fingerprint(texts[d] or "") for d in order}
    for d, after in zip(order, order[1:] + order[:1]):
        text, following = texts[d] or "", texts[after] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        new = brute.fingerprint(edited)
        assert tuple(got[d])[1:5] == (len(text), hashlib.sha256(edited.encode()).hexdigest(), own[d], new)
        assert got[d]["near_edited"] == pytest.approx(brute.likeness(own[d], new))
        assert got[d]["near_next"] == pytest.approx(brute.likeness(own[d], own[after]))


def test_fingerprints_of_odd_texts_equal_plain_parse():
    rng = random.Random(2)
    odd = ["", "a", "aa", "ab", "aaaa" * 50, "abab" * 60, "é😀" * 40, "x" * 1000 + "y", "\x00\x01" * 9]
    odd += ["".join(rng.choice("ab\n ") for _ in range(rng.randint(1, 400))) for _ in range(30)]
    assert [fingerprints.as_text(f) for f in fingerprints.fingerprints(odd)] == [brute.fingerprint(t) for t in odd]


def test_language_query_equals_plain_decision(spark, texts):
    """The dictionaries are learned by the operator from the rows that the query may learn from."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    learned = language_id.learn(docs.where(~F.col("doc_id").isin([d for d in texts if held(d)])), F.col("doc_id"), F.col("text"), F.col("lang"))
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, SMALL).collect()}
    assert sorted(got) == sorted(texts)
    for d, text in texts.items():
        name, score, rejected = brute.language(text, learned)
        assert (got[d]["held_out"], got[d]["lang_pred"], got[d]["rejected"]) == (held(d), name, rejected)
        assert got[d]["score"] == pytest.approx(score)


def test_pack_query_equals_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {d: [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1] for d, t in texts.items()}
    pieces = QUERIES["op2_pack"](spark, SMALL).collect()
    for p in pieces:
        own = ids[p["doc_id"]]
        part = own[p["start"]:p["start"] + p["length"]]
        assert p["doc_tokens"] == len(own) and len(part) == p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for d, own in ids.items():
        at = 0
        for start, n in sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == d):
            assert start == at
            at += n
        assert at == len(own)
    for s in {p["sequence_id"] for p in pieces}:
        at = 0
        for offset, n in sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len({p["sequence_id"] for p in pieces}) == -(-sum(map(len, ids.values())) // 2048)


def test_nearest_keeps_double_precision(spark):
    rng = np.random.default_rng(5)
    data = [(i, (rng.standard_normal(6) * 1e-3 + 1.0).tolist()) for i in range(60)]
    data += [(100, [1e39, 1e39, 0.0, 0.0, 0.0, 1.0]), (101, [1e-46] * 6), (102, [0.0] * 6)]
    found = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") % 20 == 0, 3)
    ids, vectors = zip(*data)
    want = brute.nearest(ids, vectors, {0, 20, 40, 100}, 3)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], rel=1e-13)
