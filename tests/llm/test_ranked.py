"""Ranked lexical search against scoring every document for every item, ties and odd input included."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from webgrain.llm import ranked

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, term string, item_id string"
ITEMS = "item_id long, text string, score string"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def by_hand(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [c for _, c in counts if c]
    n_docs, n_terms, df = len(held), sum(sum(c.values()) for c in held), Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms if c else 0
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def as_rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_against_sql(same_as_sql):
    same_as_sql(ranked.op11, ranked.ORACLE_OP11)


def test_query_by_hand(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert as_rows(ranked.op11(spark, SF)) == by_hand(docs, items)


def odd():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "中文", "e1", "ZETA", "eta", "theta", "iota"]
    docs = [(i, " ".join(rng.choices(words, [2**-j for j in range(10)], k=rng.randrange(1, 30)))) for i in range(300)]
    docs += [(None, "alpha iota"), (None, "alpha iota"), (7, "iota, iota; iota"), (7, "iota, iota; iota"), (900, None), (901, ""), (902, " \n-.")]
    docs += [(903, "alpha " * 20_000 + "lonely"), (904, "x" * 70_000)]
    items = [(1, "iota alpha ALPHA"), (1, "iota alpha ALPHA"), (None, "theta"), (2, None), (3, ""), (4, "unknown word"), (5, "alpha"), (6, "lonely beta")]
    items += [(7, " ".join(w.lower() for w in words) + " iota" * 400), (8, "x" * 70_000 + " eta é1")]
    return docs, items


@pytest.mark.parametrize("sent, shard_docs, block, exact", [(2_000_000, 16_384, 512, 1 << 53), (0, 20, 2, 0)])
def test_odd_rows(spark, monkeypatch, sent, shard_docs, block, exact):
    monkeypatch.setattr(ranked, "SENT_TERMS", sent)
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ranked, "ITEM_BLOCK", block)
    monkeypatch.setattr(ranked, "EXACT", exact)
    docs, items = odd()
    d = spark.createDataFrame([(*r, "own", "own") for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*r, "own") for r in items], ITEMS)
    for k in (10, 1, 1000):
        assert as_rows(ranked.ranked_search(d, q, k=k)) == by_hand(docs, items, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", "")], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert ranked.ranked_search(docs.limit(0), items).count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0


def test_thresholds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    n, k = 4000, 10
    lists = [np.sort(rng.choice(n, size, replace=False)) for size in (20, 60, 400, 2500, 3900)]
    starts = np.cumsum([0, *map(len, lists)])
    values = [np.arange(5), starts, np.concatenate(lists), rng.integers(1, 4, starts[-1]), np.arange(n), np.zeros(n), rng.integers(50, 150, n)]
    shard = ranked.Shard([v.astype(t).tobytes() for v, t in zip(values, ranked.Shard.KINDS, strict=True)], n, 100 * n)
    w = np.array([5000, 4000, 2000, 300, 20])
    most = w * np.array([shard.impact[a:b].max() for a, b in zip(starts[:-1], starts[1:], strict=True)])
    kth = max(int(x * np.sort(shard.impact[a:b])[-k]) for x, a, b in zip(w, starts[:-1], starts[1:], strict=True))
    order = np.argsort(most)
    args = order.astype(np.uint64), w[order], np.cumsum(most[order])
    pruned, scored = shard.search(*args, kth, k), shard.scored
    whole = shard.search(*args, 1, k)
    assert all(np.array_equal(a, b) for a, b in zip(pruned, whole, strict=True)) and len(whole[0]) == k
    assert scored < 500 < shard.scored - scored
