"""The whole pipeline on the smallest tables, stage by stage, against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import test_text_ops as plain

import corpus_pipeline
from webgrain.llm import lines, mixing, quality, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good_documents(docs, labels):
    trusted = {i for i, q, t in labels if q == 1 and t == 0} - {i for i, q, t in labels if not (q == 1 and t == 0)}
    counts = {i: plain.bucket_counts(t, quality.BUCKETS) for i, t in docs.items()}
    raw, target = Counter(), Counter()
    for i, c in counts.items():
        raw.update(c)
        if i in trusted:
            target.update(c)
    n, m, a, b = sum(raw.values()), sum(target.values()), quality.ALPHA, quality.BUCKETS
    out = {}
    for i, t in docs.items():
        words, _, _, _, repeated = plain.base_counts(t)
        weight = sum(k * (math.log((target[x] + a) / (m + a * b)) - math.log((raw[x] + a) / (n + a * b))) for x, k in counts[i].items())
        if words >= 20 and 100 * repeated <= 30 * words and weight / max(1, sum(counts[i].values())) >= quality.THRESHOLD:
            out[i] = t
    return out


def without_repeated_lines(docs):
    kinds, out = [], {}
    seen = set()
    for i in sorted(docs):
        if docs[i] is None:
            out[i] = None
            continue
        keep, gone = [], 0
        for x in docs[i].split("\n"):
            again = False
            if x in seen:
                again = bool(WORD.search(x)) or len(x) >= lines.LEAST_CHARS
            else:
                seen.add(x)
                if len(x) >= lines.LEAST_CHARS:
                    letters = Counter(x)
                    for y, other in kinds:
                        if abs(len(x) - len(y)) <= 2 and sum((letters - other).values()) <= 2 and plain.distance(x, y) <= 2:
                            again = True
                            break
                    kinds.append((x, letters))
            gone += again
            keep += [] if again else [x]
        text = "\n".join(keep)
        if not gone or WORD.search(text):
            out[i] = text
    return out


def one_of_each_group(docs):
    sets, holders, parent = {}, defaultdict(set), {i: i for i in docs}
    for i, t in docs.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[i]:
            holders[s].add(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in docs:
        for j in {j for s in sets[i] for j in holders[s] if j > i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def copies(docs, source):
    n = Counter(source[i] for i in docs)
    weight = {s: k**mixing.TEMPERATURE for s, k in n.items()}
    out = Counter()
    for i in docs:
        rate = weight[source[i]] * len(docs) / (sum(weight.values()) * n[source[i]])
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[: mixing.DIGITS], 16) / 16**mixing.DIGITS
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[i] = k
    return out


def test_pipeline_against_plain_python(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.collect()
    docs, source = {r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["source"] for r in rows}
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert len(docs) == len(rows)
    frame, stages = table, dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal frame
        frame = corpus_pipeline.staged(stages[name](spark, frame, SF), f"plain-{name}")
        return frame.collect()

    want = good_documents(docs, labels)
    assert {r["doc_id"]: r["text"] for r in step("quality_rules")} == want
    want = without_repeated_lines(want)
    got = step("line_dedup")
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] != docs[r["doc_id"]])
    want = one_of_each_group(want)
    assert {r["doc_id"]: r["text"] for r in step("minhash_near_dedup")} == want
    times = +copies(want, source)
    got = step("mixing")
    assert Counter(r["doc_id"] for r in got) == times and all(r["text"] == want[r["doc_id"]] for r in got)
    pieces = step("packing")
    ids = {i: len(tokens.encoder(tokens.default_path()).pack((want[i] or "").encode(), 2)) // 2 for i in times}
    assert sum(r["length"] for r in pieces) == sum(ids[i] * k for i, k in times.items())
    by_place = defaultdict(int)
    for r in pieces:
        assert r["doc_tokens"] == ids[r["doc_id"]] and 0 < r["length"] <= 4096
        by_place[r["doc_id"]] += r["length"]
    assert by_place == {i: ids[i] * k for i, k in times.items()}
    filled = defaultdict(list)
    for r in pieces:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 4096 or end & (end - 1) == 0
