"""Mixing, token files, packing, near-duplicates, language model, search and the pipeline."""

import functools
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webgrain.llm import attention, lm, minhash, mixing, packing, search, token_files, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, kept string"
EDGE = [(1, None, None, "x"), (2, "", "a", "x"), (3, " \n", "a", "x"), (None, "some words here", "b", "x"), (5, "five words are in here", "b", "x"), (5, "five words are in here", "b", "x"), (6, "Long " * 9000, "b", "x")]


@functools.cache
def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture
def docs(spark):
    return dict(texts_of(spark))


@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture
def library():
    return whole_tokenizer()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["op4_mixing", "op7_minhash", "op9_top_k"])
def test_against_sql(name, same_as_sql):
    from webgrain.llm import queries

    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def test_mixing(spark):
    rows = [(i, "t", "big" if i % 10 else "small", "x") for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df, {"big": 1.0, "small": 1.0}, size=8000).groupBy("source").count().collect()
    assert all(3700 < r["count"] < 4300 for r in got) and len(got) == 2
    assert mixing.mixed(df, {"small": 1.0}).select("source").distinct().collect()[0][0] == "small"
    assert mixing.mixed(df, {"small": 1.0}, size=400 * 900).where("doc_id = 0").agg(F.max("n_copies")).collect()[0][0] > 700
    again = mixing.mixed(df, {"big": 1.0, "small": 1.0}, size=8000)
    assert again.exceptAll(mixing.mixed(df.repartition(7), {"big": 1.0, "small": 1.0}, size=8000)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(df, {"big": -1.0})


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, "t", f"s{i % 5}" if i % 6 else None, "x") for i in range(300)], DOCS)
    want = mixing.mixed(df).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(want, key=str) == sorted(mixing.mixed(df).collect(), key=str)


def test_mixing_edges(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string, copy string")
    assert mixing.mixed(df).columns == ["doc_id", "text", "source", "copy", "n_copies", "shuffle_key"]
    assert mixing.mixed(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=4))
def test_token_file_round_trip(parts):
    f = io.BytesIO()
    w = token_files.ShardWriter(f)
    for i, p in enumerate(parts):
        w.add(i or None, np.array(p, np.uint32))
    w.close()
    r = token_files.ShardReader(io.BytesIO(f.getvalue()), len(f.getvalue()))
    flat = [x for p in parts for x in p]
    assert r.read(0, r.tokens).tolist() == flat and r.read(3, min(300, len(flat))).tolist() == flat[3:300]
    assert [(i, n, c) for i, _, n, c in r.documents()] == [(i or None, len(p), crc(p)) for i, p in enumerate(parts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abcXYZéÉßİıΣσçÑ'.,!?<|>-09$% \n\t", "<|endoftext|>", "'re", "́", " ", "世"]), max_size=8).map("".join))
def test_word_ids_are_the_librarys(text):
    code = tokens.encoder(tokens.default_path())
    want = [*code.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert np.frombuffer(code.pack(text.encode(), 1), np.uint16).tolist() == want


def test_stems_are_asked_for_once(library):
    """Case and punctuation after a word don't make the model encode its letters again."""
    code, asked = tokens.WordEncoder(tokens.default_path()), []

    class Asked:
        def tokenize(self, stem, model=code.model):
            asked.append(stem)
            return model.tokenize(stem)

    code.model = Asked()
    text = "Zwergelin, zwergelin ZWERGELIN! (Zwergelin) zwergelin-x \u00c9t\u00e9! \u00e9t\u00e9 \u00e9t\u00e9... \u0130x ... don't"
    got = np.frombuffer(code.pack(text.encode(), 1), np.uint16).tolist()
    assert got == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert len(asked) == len(set(asked)) == 2


def test_token_files(spark, docs, library):
    start, got = 0, {r["doc_id"]: r for r in token_files.op5(spark, SF).collect()}
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    edge = token_files.token_files(spark.createDataFrame(EDGE, DOCS)).orderBy("start").collect()
    assert [r["doc_id"] for r in edge] == [None, 1, 2, 3, 5, 5, 6] and [r["n_tokens"] for r in edge][1:4] == [1, 1, 1] and edge[6]["n_tokens"] == 9001
    assert token_files.token_files(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([8, 16, 64]).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c - 1), st.integers(1, 40), max_size=8))))
def test_plan_places_everything_without_padding(case):
    capacity, histogram = case
    plan = packing.Plan(histogram, capacity)
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()] or [np.zeros(0, np.int64)]).astype(np.int64)
    filled, done = {}, np.zeros(len(length), np.int64)
    for x in packing.place(plan.arrays(), length, rank, np.zeros(len(length), np.int64)):
        for row, start, size, window, offset in zip(x["row"], x["start"], x["length"], x["window"], x["offset"], strict=True):
            assert start == done[row]
            done[row] += size
            filled.setdefault(int(window), []).append((int(offset), int(size)))
    assert (done == length).all() and sorted(filled) == list(range(plan.windows))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == capacity or at & (at - 1) == 0


def test_fill_is_closest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(4)}
        cap, sums = rng.randint(1, 60), {0}
        for l, n in counts.items():
            sums = {s + k * l for s in sums for k in range(n + 1)}
        got = packing.fill(sorted(counts, reverse=True), counts, cap)
        assert all(got[l] <= counts[l] for l in got) and sum(l * n for l, n in got.items()) == max(s for s in sums if s <= cap)


def check_packing(rows, texts, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or at & (at - 1) == 0


def test_packing(spark, docs, library, monkeypatch):
    check_packing(packing.op6(spark, SF).collect(), docs, library)
    monkeypatch.setattr(packing, "BROADCAST_CUTS", 0)
    check_packing(packing.op6(spark, SF).collect(), docs, library)
    edge = [r for r in EDGE if r[0] != 5]
    check_packing(packing.pack(spark.createDataFrame(edge, DOCS)).collect(), {r[0]: r[1] for r in edge}, library)
    assert packing.pack(spark.createDataFrame(EDGE, DOCS)).where("doc_id = 5").agg(F.sum("length")).collect()[0][0] == 12
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def brute_components(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_in_one_large_group(spark):
    """Chains, copies, and many texts of one origin whose edits are their own."""
    rng, texts = random.Random(8), {}
    base = [f"w{i}" for i in range(160)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            words[rng.randrange(160)] = f"x{rng.random()}"
        texts[i] = " ".join(words)
    for i in range(150, 170):
        texts[i] = " ".join(base[i - 150 : i - 20])
    texts |= {200: "a b", 201: "A  b", 202: "", 203: None, 204: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_near_duplicate_edges(spark):
    got = minhash.near_duplicates(spark.createDataFrame(EDGE, DOCS)).collect()
    assert len(got) == 7 and all(r["kept"] for r in got) and [r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_bound():
    bound = minhash.least_matches()
    for n, m in bound.items():
        tail = lambda k: sum(math.comb(n + 1, i) * 0.75**i * 0.25 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= minhash.MISS > tail(m - 1)


def test_language_model(spark, docs):
    got = {r["doc_id"]: r for r in lm.op8(spark, SF).collect()}
    words, n = Counter(), 0
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            words.update(t.encode().lower().split())
            words[b"\0"] += 1
    n, v = sum(words.values()), len(words)
    for i, t in docs.items():
        w, r = [*t.encode().lower().split(), b"\0"], got[i]
        want = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in words for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want) and r["score"] < 0


def test_language_model_beats_its_counts_alone(spark):
    """Held-out accuracy: attention improves on the smoothed pairs that it starts from, over the 0.01 tables."""
    rows = lm.describe(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10, 1, 1, tokens.default_path())
    voc = lm.vocabulary(rows, 49408)
    held = [bytes(r["ids"]) for r in rows.where("held_out").select("ids").collect()]
    flat, start, sizes = lm._laid_out(held)
    text, at, first = attention.windows(sizes)
    inputs, target, real = attention.cut(flat, start, sizes, text, at, voc)
    mean = lambda p: attention.class_log10(p, inputs, voc.klass[target], voc.bias)[real].mean()
    plain = attention.fresh()
    plain["C"] *= 0
    learned = lm.train(rows, voc)
    blind = learned | {"O": learned["O"] * 0}  # what attention brings is left out
    assert mean(learned) > mean(plain) + 0.05 and mean(learned) > mean(blind) + 0.05


def test_scores_dont_depend_on_splits(spark, monkeypatch):
    """Equal scores however the table is split and ordered, with several shards and rounds."""
    monkeypatch.setattr(lm, "SHARD_IDS", 9_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(7, "one text more"), (7, "one text more"), (None, "no id"), (8, None)], docs.schema))

    def scores(df):
        return sorted((str(r["doc_id"]), r["n_tokens"], r["score"], r["base_score"]) for r in lm.lm_scores(df).collect())

    one = scores(docs.coalesce(1))
    for other in (docs.repartition(8), docs.repartition(37, "text").sortWithinPartitions(F.desc("doc_id"))):
        got = scores(other)
        assert [x[:2] for x in got] == [x[:2] for x in one]
        for a, b in zip(got, one, strict=True):
            assert abs(a[2] - b[2]) <= 1e-6 * abs(b[2]) and abs(a[3] - b[3]) <= 1e-9 * abs(b[3])


def test_scores_against_a_loop_over_positions():
    """Every id of texts of several windows, in plain steps: its window, attention over what is before it, class and share."""
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 50, 4000) * (rng.random(4000) < 0.7)
    voc = attention.Vocabulary(counts, rng.integers(0, 4, attention.INPUTS**2) * (rng.random(attention.INPUTS**2) < 0.02))
    p = {n: x.astype(np.float64) * 1.5 for n, x in attention.fresh().items()}
    texts = [rng.integers(0, 4000, n) for n in (1, 31, 32, 33, 56, 57, 130)]
    sizes = np.array([len(t) for t in texts])
    got = attention.text_log10(p, voc, np.concatenate(texts), np.cumsum(sizes) - sizes, sizes)
    for text, total in zip(texts, got, strict=True):
        want = 0.0
        for i, own in enumerate(text):
            first = 0 if i < attention.WINDOW else attention.STRIDE * -(-(i + 1 - attention.WINDOW) // attention.STRIDE)
            before = [len(counts) if j == 0 else text[j - 1] for j in range(first, i + 1)]
            x = np.array([p["E"][voc.row[b]] + p["P"][j] for j, b in enumerate(before)])
            scores = (x @ p["K"]) @ (x[-1] @ p["Q"]) / attention.WIDTH**0.5
            share = np.exp(scores - scores.max())
            h = x[-1] + (share / share.sum()) @ (x @ p["V"]) @ p["O"]
            z = h @ p["C"] + p["b"] + voc.bias[voc.row[before[-1]]]
            z -= z.max()
            rank = voc.rank[before[-1]]
            want += (z[voc.klass[own]] - np.log(np.exp(z).sum())) / np.log(10) + voc.inside(np.array([rank]), np.array([own]))[0]
        assert abs(total - want) < 1e-3 * len(text)


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 5000) * (rng.random(5000) < 0.6)
    voc = attention.Vocabulary(counts, rng.integers(0, 4, attention.INPUTS**2) * (rng.random(attention.INPUTS**2) < 0.02))
    inputs = rng.integers(0, attention.INPUTS, (1, attention.WINDOW))
    p, every = attention.fresh(), np.arange(5000)
    for position in (0, 7, 31):
        klass = np.array([attention.class_log10(p, inputs, np.full(inputs.shape, c), voc.bias)[0, position] for c in range(attention.CLASSES)])
        total = (10.0 ** (klass[voc.klass] + voc.inside(np.full(5000, inputs[0, position]), every))).sum()
        assert abs(total - 1) < 1e-3
    text, at, first = attention.windows(np.array([1, 32, 33, 200]))
    scored = Counter()
    for t, a, f in zip(text, at, first, strict=True):
        scored.update((t, i) for i in range(f, min(a + attention.WINDOW, [1, 32, 33, 200][t])))
    assert set(scored.values()) == {1} and len(scored) == 266


def test_attention_gradients():
    rng = np.random.default_rng(2)
    voc = attention.Vocabulary(rng.integers(1, 9, 3000))
    p = {n: x.astype(np.float64) for n, x in attention.fresh().items()}
    inputs, klass = rng.integers(0, attention.INPUTS, (2, 32)), rng.integers(0, attention.CLASSES, (2, 32))
    real = rng.random((2, 32)) < 0.8
    g = attention.gradients(p, inputs, klass, real, voc.bias.astype(np.float64))
    loss = lambda: -attention.class_log10(p, inputs, klass, voc.bias.astype(np.float64))[real].mean() / np.log10(np.e)
    for n in attention.NAMES:
        at = np.unravel_index(np.abs(g[n]).argmax(), g[n].shape)
        p[n][at] += 1e-5
        up = loss()
        p[n][at] -= 2e-5
        down = loss()
        p[n][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[n][at]) < 1e-3 * max(1, abs(g[n][at])), n


def test_language_model_edges(spark):
    got = lm.lm_scores(spark.createDataFrame(EDGE, DOCS)).collect()
    assert len(got) == 7 and [r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert lm.lm_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_search_edges(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    q = spark.createDataFrame([(1, "WORDS words here"), (1, "words here"), (None, "long"), (3, None), (4, "absent")], "query_id long, text string")
    got = search.top_k(df, q, k=2).collect()
    assert sorted((str(r["query_id"]), r["rank"], str(r["doc_id"])) for r in got) == [("1", 1, "None"), ("1", 1, "None"), ("1", 2, "5"), ("1", 2, "5"), ("None", 1, "6")]
    assert search.top_k(df.limit(0), q).count() == 0 and search.top_k(df, q.limit(0)).count() == 0


def test_search_prunes_nothing_that_counts(spark, docs):
    """A shard at a time with thresholds carried over gives the exhaustive answer."""
    rng = np.random.default_rng(5)
    n, terms = 700, np.sort(rng.integers(0, 2**63, 90).astype(np.uint64))
    lists = [np.sort(rng.choice(n, int(rng.integers(1, n // (1 + i % 30))), replace=False)) for i in range(90)]
    starts = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate(lists)
    shard = search.Shard(terms, starts, flat, rng.integers(1, 6, len(flat)), np.arange(n), rng.integers(5, 90, n), 40.0)
    for _ in range(30):
        pick = np.sort(rng.choice(90, 40, replace=False))
        weights = rng.random(40) * 5
        full = np.zeros(n)
        for t, w in zip(pick, weights, strict=True):
            full[lists[t]] += w * shard.impact[starts[t] : starts[t + 1]]
        want = search.best(np.arange(n), full, 10)
        for least in (0.0, float(want[1][-1])):
            found, score = shard.search(terms[pick], weights, 10, least)
            assert search.best(found, score, 10)[0].tolist() == want[0].tolist()


def test_every_training_window_trains():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 3000, n).astype(np.uint16) for n in [1, 32, 33, 200, 5, 9000] * 100]
    voc = attention.Vocabulary(rng.integers(1, 9, 3000))
    got = list(lm.all_windows((x.tobytes() for x in texts), voc))
    assert max(len(i) for i, _, _ in got) <= lm.BATCH and sum(int(r.sum()) for _, _, r in got) == sum(map(len, texts))
    want = Counter(int(voc.klass[x]) for t in texts for x in t)  # each id once
    assert sum((Counter(k[r].tolist()) for _, k, r in got), Counter()) == want


def test_pipeline(spark, library):
    import corpus_pipeline
    from webgrain.staging import staged

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], SF), f"test-{name}"))
    kept, lined, single, mixed_, packed = frames[1:]
    for f in frames[1:5]:
        assert f.columns == docs.columns
    from webgrain.llm import quality

    assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.op2(spark, SF).where("kept").collect()}
    groups = brute_components({r["doc_id"]: r["text"] for r in lined.collect()})
    assert {r[0] for r in single.select("doc_id").collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert mixed_.join(single, "doc_id", "left_anti").count() == 0
    texts = {r["doc_id"]: r["text"] for r in mixed_.collect()}
    copies = Counter(r["doc_id"] for r in mixed_.collect())
    total = sum(copies[i] * (len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts.items())
    assert packed.agg(F.sum("length")).collect()[0][0] == total


def test_clashing_columns(spark):
    df = spark.createDataFrame(EDGE, DOCS).withColumns({c: F.lit(c) for c in ("n", "h", "node", "key", "sig", "ids", "part", "ord", "start", "length", "rid", "copy", "rate", "cdf")})
    assert {r["rate"] for r in mixing.mixed(df).collect()} <= {"rate"}
    for run in (token_files.token_files, packing.pack, minhash.near_duplicates, lm.lm_scores):
        assert run(df).count() >= len(EDGE)
    assert search.top_k(df, df.select(F.col("doc_id").alias("query_id"), "text", "node")).count() > 0


def test_search_skips_blocks(spark):
    """Documents of eight vocabularies: a query scores few of the others, and the answer is the exhaustive one."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(5, 60)), 400)) for i in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    row = search.build_index(df).collect()
    assert len(row) == 1
    part = [np.frombuffer(row[0][c], t) for c, t in zip(("terms", "starts", "docs", "counts", "ids"), (np.uint64, np.int64, np.uint32, np.uint32, np.int64), strict=True)]
    sizes = np.frombuffer(row[0]["sizes"], np.int64)
    shard = search.Shard(*part, sizes, float(sizes.mean()))
    n, queries = len(sizes), rng.choice(4000, 50, replace=False)
    for q in queries:
        raw = texts[q].encode()
        _, terms, _, _ = search.term_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        terms = np.sort(terms)
        at = np.searchsorted(shard.terms, terms)
        df_ = np.diff(shard.starts)[at]
        w = np.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
        full = np.zeros(n)
        for t, x in zip(at, w, strict=True):
            full[shard.docs[shard.starts[t] : shard.starts[t + 1]]] += x * shard.impact[shard.starts[t] : shard.starts[t + 1]]
        found, score = shard.search(terms, w, 10, 0.0)
        assert search.best(shard.ids[found], score, 10)[0].tolist() == search.best(shard.ids[full > 0], full[full > 0], 10)[0].tolist()
    assert shard.scored < 0.25 * n * len(queries)


def test_search_bounds_of_long_lists_are_sums():
    """Each block has every term, but one block alone has documents with all of them: the others aren't scored."""
    n, terms = 64 * search.BLOCK, np.arange(1, 9, dtype=np.uint64)
    best = np.arange(5 * search.BLOCK, 5 * search.BLOCK + 12)
    lists = [np.union1d(np.arange(t, n, 8), best) for t in range(8)]
    starts, flat = np.cumsum([0, *map(len, lists)]), np.concatenate(lists)
    shard = search.Shard(terms, starts, flat, np.ones(len(flat), np.int64), np.arange(n), np.full(n, 8), 8.0)
    found, score = shard.search(terms, np.ones(8), 10, 0.0)
    assert search.best(found, score, 10)[0].tolist() == best[:10].tolist()
    assert shard.scored <= search.SEEDS * search.BLOCK


def test_searches_together_are_searches_one_by_one(monkeypatch):
    """Lists of all lengths, terms that the shard lacks, no terms, a last block that isn't full; sums made for few queries at a time."""
    rng = np.random.default_rng(12)
    n, terms = 1003, np.arange(60, dtype=np.uint64) * 3
    lists = [np.sort(rng.choice(n, int(rng.integers(1, n // (1 + i % 40))), replace=False)) for i in range(60)]
    starts, flat = np.cumsum([0, *map(len, lists)]), np.concatenate(lists)
    shard = search.Shard(terms, starts, flat, rng.integers(1, 6, len(flat)), np.arange(n), rng.integers(5, 90, n), 40.0)
    queries = [(np.sort(rng.choice(200, m, replace=False)).astype(np.uint64), rng.random(m)) for m in (0, 1, 3, 20, 90, 150)]
    monkeypatch.setattr(search, "SUMS", 2 * shard.dense.shape[1])
    for (t, w), (found, score) in zip(queries, shard.search_all(queries, 10, [0.0] * 6), strict=True):
        full = np.zeros(n)
        for x, y in zip(t, w, strict=True):
            if x % 3 == 0 and x < 180:
                full[lists[int(x) // 3]] += y * shard.impact[starts[int(x) // 3] : starts[int(x) // 3 + 1]]
        want = search.best(np.flatnonzero(full), full[full > 0], 10)
        got = search.best(found, score, 10)
        assert got[0].tolist() == want[0].tolist() and np.allclose(got[1], want[1])


def test_search_over_many_shards(spark, docs, monkeypatch):
    """Shards cut small, weights joined by salted keys, null and extreme ids: the same answers."""
    df = spark.createDataFrame([*docs.items(), (None, docs[3]), (2**63 - 1, docs[3])], "doc_id long, text string")
    q = df.where("doc_id % 20 = 3").select(F.col("doc_id").alias("query_id"), "text")
    ask = lambda: sorted(map(str, search.top_k(df, q, k=5).drop("query_row").collect()))
    want = ask()
    assert any("doc_id=None" in x for x in want) and any(str(2**63 - 1) in x for x in want)
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "BROADCAST_TERMS", -1)
    assert ask() == want


def test_many_search_weights_are_not_broadcast(spark, monkeypatch):
    wanted = spark.range(40).selectExpr("id % 7 AS query_row", "id % 7 AS query_id", "id % 11 AS term")
    weight = spark.range(10).selectExpr("id AS term", "id + 0.5D AS w")
    joined = lambda: search.with_weights(wanted, weight)
    few = sorted(joined().select("query_row", "query_id", "term", "w").collect())
    monkeypatch.setattr(search, "BROADCAST_TERMS", 5)
    many = joined()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()  # small as Spark expects them to be
    assert sorted(many.select("query_row", "query_id", "term", "w").collect()) == few and len(few) == 37
