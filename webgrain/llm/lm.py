"""Language-model scores of whole texts: a smoothed word unigram baseline and a causal self-attention model.

Held-out documents are those whose crc32 of the id as text is 0 modulo 10; everything is learned from the others, all of
them: word counts, subword counts, counts of subword pairs, and, for the attention weights, all their windows, once each.
Weights are trained in rounds over disjoint parts of the documents, which together are all; in a round each shard of the part
is a local pass, and the weights are averaged by what they have seen. Shards and their order follow from the documents. Only averages (a fixed number of values) reach
the driver. Words that are frequent are looked up in a table of bounded size, the counts
of all others are joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as numbers
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm import attention as att
from webgrain.llm.common import bounded_batches, hashed_words, row_chunks, sized_words, staged, utf8_column
from webgrain.llm.tokens import default_path, encoder

ALPHA = 0.1
#: The token that ends a text, where a vocabulary has one; else an id beyond its own.
END_TOKEN = "<|endoftext|>"
#: Words whose counts are broadcast at most (12 bytes each).
HEAD_WORDS = 300_000
#: Learning rates of the rounds, each over its own part of the training documents.
ROUND_RATES = (0.02, 0.015, 0.01, 0.004)
BATCH = 64
#: Texts whose windows are mixed; ids of a shard, about, whose pass gives weights of its own; shards of a round at most (they
#: are longer then).
SHUFFLED, SHARD_IDS, MOST_SHARDS = 500, 1_000_000, 4096
#: Decimals of averaged weights; weights that go to be averaged as one row.
DECIMALS, WEIGHTS = 7, 4096
WEIGHT_ROWS = "part int, x binary, seen long"


def held_out(doc_id: str = "doc_id"):
    """Whether a document is held out; one without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _pairs(keys: np.ndarray, counts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=names)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of each distinct word of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

        for b in batches:
            data, off = utf8_column(b.column(0))
            for lo, hi in row_chunks(off, 1 << 21):
                words, _, _ = hashed_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if len(words):
                    held.append(np.unique(words.view(np.int64), return_counts=True))
                if sum(len(k) for k, _ in held) > 4_000_000:  # bounded memory: what is counted goes out
                    yield from _pairs(*merged(), ["h", "c"])
                    held.clear()
        if held:
            yield from _pairs(*merged(), ["h", "c"])

    partial = docs.where(~held_out()).select("text").mapInArrow(count, "h long, c long")
    # a task's hashes hardly repeat, so they aren't aggregated before they are dealt out
    return staged(partial.repartition("h").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")


def head_of(counts: DataFrame, most: int = HEAD_WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and counts of all words from some count on, at most `most` words, and that count."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}  # some hundred rows
    least, total = 64 * 8, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    rows = counts.where(step >= least).toArrow()  # at most `most` rows
    h, c = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(h)
    return h[order], c[order], least


def describe(docs: DataFrame, head: tuple[np.ndarray, np.ndarray], n: int, v: int, ends: int, tokenizer: str) -> DataFrame:
    """Staged rows: rid, doc_id, held_out, n_tokens, known and base (of head words and the end), the other words' hashes
    and counts, and subword ids with the end id."""
    hashes, counts = docs.sparkSession.sparkContext.broadcast(head[0]), docs.sparkSession.sparkContext.broadcast(head[1])
    shape = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, words binary, times binary, ids binary"
    floor, end_score = np.log10(n + ALPHA * (v + 1)), np.log10((ends + ALPHA) / (n + ALPHA * (v + 1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, rid = encoder(tokenizer), TaskContext.get().partitionId() << 32
        end, kind = end_and_size(tokenizer)[0], np.dtype(f"<u{code.width}")
        top, weight = hashes.value, np.log10(counts.value + ALPHA) - floor
        # ids of the head words met so far, end to end, and where those of each begin
        store, begins, lengths = np.zeros(0, kind), np.full(max(1, len(top)), -1), np.zeros(max(1, len(top)), np.int64)
        for b in batches:
            data, off = utf8_column(b.column(2))
            for lo, hi in row_chunks(off, 1 << 21):
                part = data[off[lo] : off[hi]]
                words, first, starts, sizes = sized_words(part, off[lo : hi + 1] - off[lo])
                words, raw = words.view(np.int64), part.tobytes().lower()
                kinds, seen, which = distinct(words)
                at = np.searchsorted(top, kinds)
                at[at == len(top)] = 0
                hit = top[at] == kinds if len(top) else np.zeros(len(kinds), bool)
                # a head word is encoded when it is first met, each other one once a chunk; ids are laid out wherever words stand
                new, other = np.flatnonzero(hit & (begins[at] < 0)), np.flatnonzero(~hit)
                a, n = (x[seen[np.concatenate((new, other))]].tolist() for x in (starts, sizes))
                codes = [code[raw[i : i + k]] for i, k in zip(a[: len(new)], n, strict=False)]
                for i, k in zip(a[len(new) :], n[len(new) :], strict=True):
                    word = raw[i : i + k]
                    codes.append(code.get(word) or code.ids(word, False))
                counted = np.array([len(x) // code.width for x in codes], np.int64)
                place = len(store) + np.cumsum(counted) - counted
                begins[at[new]], lengths[at[new]] = place[: len(new)], counted[: len(new)]
                begin, n_ids, every = begins[at], lengths[at], np.concatenate((store, np.frombuffer(b"".join(codes), kind)))
                begin[other], n_ids[other] = place[len(new) :], counted[len(new) :]
                store = every[: len(store) + counted[: len(new)].sum()]
                per_word = n_ids[which]
                place = np.append(0, np.cumsum(per_word))
                laid = every[np.arange(place[-1]) + np.repeat(begin[which] - place[:-1], per_word)]
                hit, at = hit[which], at[which]
                score = np.append(0.0, np.cumsum(np.where(hit, weight[at], 0.0))) if len(top) else np.zeros(len(words) + 1)
                known = np.append(0, np.cumsum(hit))
                # the other words of each row, in order of their hashes
                other = np.flatnonzero(~hit)
                of_row = np.searchsorted(first, other, side="right") - 1
                rest, times = np.unique(of_row * len(kinds) + which[other], return_counts=True)
                cut = np.searchsorted(rest, np.arange(hi - lo + 1) * len(kinds))
                # ids with the end after each row's own
                n_rows, put = hi - lo, place[first]
                out = np.full(len(laid) + n_rows, end, kind)
                here = np.ones(len(out), bool)
                here[put[1:] + np.arange(n_rows)] = False
                out[here] = laid
                total = np.diff(score[first]) + end_score
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + n_rows)),
                        b.column(0).slice(lo, n_rows),
                        b.column(1).slice(lo, n_rows),
                        pa.array(np.diff(first).astype(np.int64) + 1),
                        pa.array(np.diff(known[first]).astype(np.int64) + (ends > 0)),
                        pa.array(total),
                        packed(kinds[rest % max(1, len(kinds))], cut),
                        packed(times.astype(np.uint32), cut),
                        packed(out, put + np.arange(n_rows + 1)),
                    ],
                    names=[x.split()[0] for x in shape.split(", ")]
                )
                rid += n_rows

    return staged(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(rows, shape), "lm-rows")


def distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a place of each, and the number of each word's among them."""
    order = np.argsort(words)
    ordered = words[order]
    first = np.append(np.ones(min(1, len(words)), bool), ordered[1:] != ordered[:-1])
    which = np.empty(len(words), np.int64)
    which[order] = np.cumsum(first) - 1
    return ordered[first], order[first], which


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary Arrow array: the bytes of values between each two neighbours of cuts."""
    cuts = cuts.astype(np.int64) * values.itemsize
    if cuts[-1] >= 1 << 31:  # one row alone, as chunks of rows are small
        raw = values.tobytes()
        return pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    offsets, data = pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, data])


def end_and_size(path: str) -> tuple[int, int]:
    """Id that ends a text, and the number of ids with it."""
    tokenizer = encoder(path).tokenizer
    size, end = tokenizer.get_vocab_size(with_added_tokens=True), tokenizer.token_to_id(END_TOKEN)
    return (size, size + 1) if end is None else (end, max(size, end + 1))


def _laid_out(ids: list[bytes], width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts, packed in `width` bytes each, end to end; each text's first place and size."""
    sizes = np.array([len(x) // width for x in ids], np.int64)
    return np.frombuffer(b"".join(ids), np.uint16 if width == 2 else np.uint32).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def vocabulary(rows: DataFrame, size: int, width: int = 2) -> att.Vocabulary:
    """From all training texts; what is collected is bounded by the numbers of ids and of ranked pairs."""
    spark = rows.sparkSession
    train = rows.where("NOT held_out").select("ids")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                total += np.bincount(_laid_out(b.column(0).slice(lo, 500).to_pylist(), width)[0], minlength=size)
        yield from _pairs(np.flatnonzero(total), total[total > 0], ["i", "c"])

    counts = np.zeros(size, np.int64)
    for r in train.mapInArrow(ids, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect():
        counts[r["i"]] = r["c"]
    rank = spark.sparkContext.broadcast(att.ranks(counts))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(att.INPUTS**2, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                flat, start, sizes = _laid_out(b.column(0).slice(lo, 500).to_pylist(), width)
                r = rank.value[flat].astype(np.int64)
                before = np.concatenate(([0], r[:-1]))
                before[start[sizes > 0]] = att.INPUTS - 1
                total += np.bincount(before * att.INPUTS + r, minlength=len(total))
        yield from _pairs(np.flatnonzero(total), total[total > 0], ["i", "c"])

    table = np.zeros(att.INPUTS**2)
    found = train.mapInArrow(pairs, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return att.Vocabulary(counts, table)


def all_windows(texts: Iterator[bytes], v: att.Vocabulary, width: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, classes, real positions) of every window of texts (packed ids), BATCH at a time, mixed among SHUFFLED texts."""
    for number in numbers():
        flat, start, sizes = _laid_out(list(islice(texts, SHUFFLED)), width)
        if not len(sizes):
            return
        before, klass = v.inputs(flat, start, sizes), v.klass[flat]
        text, at = att.training_windows(sizes)
        order = np.random.default_rng(number).permutation(len(text))  # windows of a text aren't learned in a row
        first, left = (start[text] + at)[order], np.minimum(sizes[text] - at, att.WINDOW)[order]
        steps = np.arange(att.WINDOW)
        for i in range(0, len(text), BATCH):
            where = np.minimum(first[i : i + BATCH, None] + steps, len(flat) - 1)  # what lies beyond a text is in nobody's past
            yield before[where], klass[where], steps < left[i : i + BATCH, None]


def train(rows: DataFrame, v: att.Vocabulary, width: int = 2) -> dict[str, np.ndarray]:
    """Attention weights after all rounds.

    What is learned together is fixed by the documents alone: a round's texts are dealt by hash into shards, as many as
    their ids ask for, and a shard's are learned in the order of their hashes. So the input's splits change nothing.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(v)

    rounds = len(ROUND_RATES)
    shards = min(MOST_SHARDS, max(1, -(-v.total // (rounds * SHARD_IDS))))
    part, mark = F.pmod(F.xxhash64("doc_id"), F.lit(rounds)), F.xxhash64("ids", "doc_id")
    params = att.flat(att.fresh())
    for i, rate in enumerate(ROUND_RATES):
        texts = rows.where(~F.col("held_out") & (part == i)).select("ids", "doc_id", mark.alias("mark"))
        dealt = texts.repartitionById(shards, F.pmod("mark", F.lit(shards)).cast("int"))
        train_rows = dealt.sortWithinPartitions("mark", "doc_id", "ids").select("ids")
        current = sc.broadcast(params)

        def learn(batches: Iterator[pa.RecordBatch], current=current, rate=rate) -> Iterator[pa.RecordBatch]:
            texts = (x for b in batches for x in b.column(0).to_pylist())
            new, seen = att.train(att.unflat(current.value), all_windows(texts, shared.value, width), rate, shared.value.bias)
            if seen:
                yield weight_rows(att.flat(new).astype(np.float64) * seen, seen)

        learned = train_rows.mapInArrow(learn, WEIGHT_ROWS).repartitionById(-(-len(params) // WEIGHTS), "part")
        sums = learned.mapInArrow(summed_weights, WEIGHT_ROWS).toArrow()  # a row for each WEIGHTS of the weights
        if sums.num_rows:
            params = params.copy()
            for number, x, seen in zip(*(sums.column(c).to_pylist() for c in range(3)), strict=True):
                mean = np.frombuffer(x) / seen
                params[number * WEIGHTS :][: len(mean)] = np.round(mean, DECIMALS)  # sums in any order are equal
    return att.unflat(params)


def weight_rows(sums: np.ndarray, seen: int) -> pa.RecordBatch:
    """Rows of WEIGHTS values each: sums of weights, and the positions that they have seen."""
    parts = [sums[i : i + WEIGHTS].tobytes() for i in range(0, len(sums), WEIGHTS)]
    numbers = pa.array(range(len(parts)), pa.int32())
    return pa.RecordBatch.from_arrays([numbers, pa.array(parts, pa.binary()), pa.array([seen] * len(parts), pa.int64())], names=["part", "x", "seen"])


def summed_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each part."""
    total: dict[int, tuple[np.ndarray, int]] = {}
    for b in batches:
        for part, x, seen in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            before, n = total.get(part, (0.0, 0))
            total[part] = before + np.frombuffer(x), n + seen
    for part, (x, seen) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["part", "x", "seen"]
        )


def lm_scores(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Base: words with A-Z as a-z and one end token for each text. score: log10 probability of the text, lower-cased alike,
    as a sequence of subword ids and an end id, in windows that overlap by a fixed context; each id is scored once.
    Defined results: null and empty texts are the end token alone; a null doc_id is held out; repeated rows are scored
    alike (and counted each); very long texts are scored whole; with no training text all counts are 0; an empty table
    gives an empty result; other columns are ignored. Words are counted by 64-bit hashes. Ids are packed in two bytes, or in
    four for vocabularies of more than 65,536. Scores don't depend on how docs is split or ordered.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_path()
    docs = docs.select("doc_id", "text")
    counts = word_counts(docs)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    ends = docs.where(~held_out()).count()
    n, v = n + ends, v + (ends > 0)
    *head, least = head_of(counts)
    rows = describe(docs, tuple(head), n, v, ends, path)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                cut = b.slice(lo, 1000)
                words = [np.frombuffer(x.as_buffer(), np.int64) for x in cut.column(1)]
                times = [np.frombuffer(x.as_buffer(), np.uint32) for x in cut.column(2)]
                rid = np.repeat(cut.column(0).to_numpy(zero_copy_only=False), [len(x) for x in words])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(np.concatenate(words)), pa.array(np.concatenate(times).astype(np.int64))],
                    names=["rid", "h", "times"]
                )

    rare = counts.where(F.floor(F.log2("c") * 8).cast("int") < least)
    spread_out = rows.select("rid", "words", "times").mapInArrow(spread, "rid long, h long, times long").join(rare, "h", "left")
    logs = F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / (F.lit(float(n)) + ALPHA * (v + 1)))
    tail = spread_out.groupBy("rid").agg(
        F.sum(logs * F.col("times")).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )

    width = encoder(path).width
    if width == 2 and end_and_size(path)[1] > 1 << 16:
        raise ValueError("the vocabulary's ids with an end of their own don't fit in two bytes")
    voc = vocabulary(rows, end_and_size(path)[1], width)
    sc = docs.sparkSession.sparkContext
    shared, weights = sc.broadcast(voc), sc.broadcast(train(rows, voc, width))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, p = shared.value, weights.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                cut = b.slice(lo, 500)
                flat, start, sizes = _laid_out(cut.column(6).to_pylist(), width)
                total = att.text_log10(p, voc, flat, start, sizes)
                yield pa.RecordBatch.from_arrays(
                    [*(cut.column(c) for c in range(6)), pa.array(total)],
                    names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score"]
                )

    scored = rows.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "ids").mapInArrow(
        score, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
    )
    return scored.join(tail, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
