"""Byte-level BPE by distinct words against the library on whole texts, and its defined results on odd input."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from webgrain.llm import bpe

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, chunk string"


def library():
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})


def by_library(texts):
    model, out = library(), []
    for i, t in texts:
        ids = np.array(model.encode_ordinary(t or ""), "<u4").tobytes()
        out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def hostile(n=120):
    rng = random.Random(3)
    marks = ["́", "‍", " ", "\u0085", " ", "\x1c", "\x00", "﻿", "\U0001f469‍\U0001f52c", "İ", "ẞ", "中", "٣", "Ⅳ"]
    bits = [*marks, "'s", "'LL", "don't", " ", "  ", "\n\n", "\t", "<|endoftext|>", "1234567", "abc", "Straße", "...", "_", "\r\n", "  \n  x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_query_against_the_library(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in bpe.op13(spark, SF).collect()), key=str) == by_library(docs)


@pytest.mark.parametrize("chunk_bytes, kept, listed", [(32 << 20, 2_000_000, 1 << 22), (500, 3, 50)])
def test_odd_rows(spark, monkeypatch, chunk_bytes, kept, listed):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(bpe, "KEPT_WORDS", kept)
    monkeypatch.setattr(bpe, "LISTED_CHARS", listed)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    texts = [(1, None), (2, ""), (2, ""), (3, " \n\t "), (None, "word " * 30), (5, "word " * 30), (5, "word " * 30), (None, None)]
    texts += [(6, "long" * 5_000), (7, "a " * 20_000), *((100 + i, t) for i, t in enumerate(hostile()))]
    frame = spark.createDataFrame([(*r, "own", "own") for r in texts], DOCS).repartition(3)
    got = bpe.encode(frame).collect()
    decoded = bpe.decode(bpe.encode(frame).withColumnRenamed("doc_id", "a.b")).collect()
    of = lambda data: hashlib.sha256(data).hexdigest()
    want = by_library(texts)
    assert sorted(((r["doc_id"], len(r["ids"]) // 4, of(bytes(r["ids"]))) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert sorted(((r["a.b"], of(bytes(r["decoded"]))) for r in decoded), key=str) == sorted(((w[0], w[3]) for w in want), key=str)


def test_empty_null_and_unknown_ids(spark):
    assert bpe.encode(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(rows).collect()} == {1: None, 2: bytearray()}
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary")).collect()


def test_each_distinct_word_is_encoded_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 2_000)
    docs = spark.createDataFrame([(i, "the same words again and again " * 20, "", "") for i in range(60)], DOCS).repartition(6)
    parts = bpe.split_words(docs, bpe.default_pattern(), 16)
    words = parts.where("bucket >= 0").select("bucket", "words", "sizes").collect()
    met = {(w, r["bucket"]) for r in words for w in bpe.cut(bpe.unpacked(bytes(r["words"])), bpe.unpacked(bytes(r["sizes"]), "i8"))}
    assert len(met) == len({w for w, _ in met}) < len(words) * 6  # a word has one bucket, many chunks have it
    chunks = parts.where("bucket < 0").count()
    assert chunks > 6 and all(r["n"] <= 7 * chunks for r in parts.where("bucket >= 0").groupBy("bucket").sum("n_words").toDF("b", "n").collect())
