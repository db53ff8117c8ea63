"""The passes of op8 over texts: what they hold, and that their work is on chunks, not on each row."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from webgrain.llm import attention, common, lm, tokens

TEXTS = ["One two, one!", "", None, " \n", "two  TWO\x0bthree " + "y" * 25, "x" * 24 + " " + "z" * 300 + " x", "Été 你好 one"] * 3


def hashed_one_by_one(word: bytes) -> int:
    coef = common.coefficients(4096, 7)
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for b, c in zip(word, coef):
            total += np.uint64(b + 1) * c
        return int(common.mix64(np.array([total]))[0])


@pytest.mark.parametrize("lower", [True, False])
def test_word_hashes_against_single_bytes(lower):
    words, first, starts, sizes = common.sized_words(*common.utf8_column(pa.array(TEXTS)), lower)
    split = [(t or "").encode().split() for t in TEXTS]
    assert np.diff(first).tolist() == [len(x) for x in split]
    assert sizes.tolist() == [len(w) for x in split for w in x]
    assert words.tolist() == [hashed_one_by_one(w.lower() if lower else w) for x in split for w in x]


def described(monkeypatch, texts: list, head: tuple[np.ndarray, np.ndarray]) -> tuple[list[dict], int]:
    """Rows that the pass over texts makes, and how many sorts for distinct values it takes."""
    from pyspark import TaskContext

    class Docs:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
        select = lambda self, *columns: self
        mapInArrow = lambda self, f, shape: f

    monkeypatch.setattr(lm, "staged", lambda made, name: made)
    monkeypatch.setattr(lm, "held_out", lambda: SimpleNamespace(alias=lambda name: None))
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 1))
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **b: calls.append(1) or unique(*a, **b))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.string())], names=["doc_id", "held_out", "text"]
    )
    made = lm.describe(Docs(), head, 100, 10, 3, tokens.default_path())
    rows = [r for b in made(iter([batch])) for r in b.to_pylist()]
    return rows, len(calls)


@pytest.mark.parametrize("known", [0, 2])
def test_described_rows(monkeypatch, known):
    words = sorted(np.int64(np.uint64(hashed_one_by_one(w))) for w in (b"one", b"two")[:known])
    head = np.array(words, np.int64), np.arange(5, 5 + known)
    rows, sorts = described(monkeypatch, TEXTS, head)
    code, end = tokens.encoder(tokens.default_path()), lm.end_and_size(tokens.default_path())[0]
    for i, (r, t) in enumerate(zip(rows, TEXTS, strict=True)):
        split = (t or "").encode().lower().split()
        hashes = [np.uint64(hashed_one_by_one(w)).astype(np.int64) for w in split]
        rest, times = np.unique(np.array([h for h in hashes if h not in words], np.int64), return_counts=True)
        assert (r["rid"], r["doc_id"], r["n_tokens"]) == ((1 << 32) + i, i, len(split) + 1)
        assert r["known"] == sum(h in words for h in hashes) + 1
        assert r["words"] == rest.tobytes() and r["times"] == times.astype(np.uint32).tobytes()
        assert r["ids"] == code.pack((t or "").encode().lower(), end)
        scores = [np.log10((5 + words.index(h) + 0.1) / (100 + 0.1 * 11)) for h in hashes if h in words]
        assert abs(r["base"] - sum(scores) - np.log10((3 + 0.1) / (100 + 0.1 * 11))) < 1e-9
    assert sorts <= 2  # once for distinct words and once for what is left of all rows, whatever their number


def test_blank_texts_alone(monkeypatch):
    rows, _ = described(monkeypatch, ["", None, " "], (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert [(r["n_tokens"], r["words"], len(r["ids"])) for r in rows] == [(1, b"", 2)] * 3


def test_scores_dont_depend_on_batches():
    """Blocks of positions and batches of windows are no part of the model."""
    rng = np.random.default_rng(3)
    voc = attention.Vocabulary(rng.integers(0, 50, 4000))
    p, sizes = attention.fresh(), rng.integers(1, 300, 200)
    ids = rng.integers(0, 4000, sizes.sum())
    one, other = (attention.text_log10(p, voc, ids, np.cumsum(sizes) - sizes, sizes, batch=n) for n in (7, 128))
    assert np.abs(one - other).max() < 1e-3


def test_head_words_are_encoded_once(monkeypatch):
    """However many chunks a head word stands in, its ids are asked for once; those of other words once a chunk, and they
    leave no room taken in the cache."""
    asked = []

    class Asked(tokens.WordEncoder):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    code = Asked(tokens.default_path())
    monkeypatch.setattr(lm, "encoder", lambda path: code)
    monkeypatch.setattr(lm, "row_chunks", lambda off, limit: ((i, i + 1) for i in range(len(off) - 1)))
    head = np.array(sorted(np.int64(np.uint64(hashed_one_by_one(w))) for w in (b"one", b"two")), np.int64)
    texts = [f"One two zwergel{'abc'[i % 3]}ein one" for i in range(9)]
    end = lm.end_and_size(tokens.default_path())[0]
    rows, _ = described(monkeypatch, texts, (head, np.array([5, 6])))
    assert [r["ids"] for r in rows] == [tokens.WordEncoder(tokens.default_path()).pack(t.lower().encode(), end) for t in texts]
    assert sorted(w for w in asked if w.isalpha()) == [b"one", b"two"]
    assert {w for w in code if w.isalpha()} == {b"one", b"two"}


@pytest.mark.parametrize("word", [b"Zwergel!", b"zwergel", b"don't", b"x", b"...", "Été!".encode(), "İx".encode(), b"a" * 300, b"ab1", b"-ab"])
def test_ids_of_words_left_out_of_the_cache(word):
    code = tokens.WordEncoder(tokens.default_path())
    want = code.tokenizer.encode(word.decode(), add_special_tokens=False).ids
    assert np.frombuffer(code.ids(word, False), np.uint16).tolist() == want and word not in code
    assert np.frombuffer(code[word], np.uint16).tolist() == want and word in code


def test_weights_are_averaged_in_few_rows(spark, monkeypatch):
    """A shard's weights are a handful of rows, and their mean is weighted by what each shard has seen."""
    from pyspark.sql.classic.dataframe import DataFrame

    made, seen, mapped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), DataFrame.mapInArrow

    def counted(self, f, schema, *a):
        def rows(batches):
            for b in f(batches):
                made.add(b.num_rows)
                if f.__name__ == "learn":
                    seen.add(b.column(b.num_columns - 1)[0].as_py())
                yield b

        return mapped(self, rows, schema, *a)

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, False, rng.integers(0, 900, 400).astype("<u2").tobytes()) for i in range(60)], "doc_id long, held_out boolean, ids binary")
    voc = attention.Vocabulary(np.bincount(rng.integers(0, 900, 24_000), minlength=1000))
    monkeypatch.setattr(lm, "SHARD_IDS", 2_000)
    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    learned = lm.train(rows, voc)
    shards = -(-24_000 // (len(lm.ROUND_RATES) * 2_000))
    assert 0 < made.value <= len(lm.ROUND_RATES) * (shards + 1) * 8
    assert seen.value == 24_000  # every id in one of the rounds
    assert all(np.abs(learned[n] - x).max() > 0 for n, x in attention.fresh().items())
    a, b = np.arange(10_000.0), np.ones(10_000)
    parts = list(lm.summed_weights(iter([lm.weight_rows(a * 3, 3), lm.weight_rows(b, 1)])))
    mean = np.concatenate([np.frombuffer(p.column(1)[0].as_py()) / p.column(2)[0].as_py() for p in parts])
    assert np.abs(mean - (a * 3 + b) / 4).max() < 1e-9
