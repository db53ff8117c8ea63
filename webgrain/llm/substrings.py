"""Substring dedup by sliding sentence spans and by word spans at places that the words choose.

Texts are cut into sentences (an overlong one into runs of a fixed number of words), every run of several consecutive
sentences is hashed, hashes are joined globally, and sentences that any non-first span covers are removed. Sentences need
not be in step in two documents, so runs of WORD_SPAN words are hashed too, at places chosen by their hashes alone
(winnowing): any PASSAGE_WORDS repeated words hold one, wherever they start. Only hashes are counted over the whole
corpus; texts are never shuffled unless very many documents change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import _SPACE, bounded_batches, coefficients, hashed_words, mix64, row_chunks, staged, utf8_column

#: Sentences of a span: so many that short lines which pages share, of a few short sentences, are none.
SPAN = 5
#: A sentence without an end goes on as a new one after so many words.
SENTENCE_WORDS = 16
#: Covered runs with fewer words stay. By default all of them go, as the method says.
LEAST_WORDS = 0
#: Any so many repeated words hold a whole word span: of each WINDOW consecutive word spans, the one of least hash is kept.
#: A word span is longer than a window, so that those of one passage leave no word between them.
PASSAGE_WORDS = 50
WORD_SPAN = PASSAGE_WORDS // 2 + 1
WINDOW = PASSAGE_WORDS - WORD_SPAN + 1
#: Repeated hashes, and positions to remove, up to which they are broadcast; beyond, they are joined by shuffling.
BROADCAST_HASHES = 100_000
BROADCAST_POSITIONS = 100_000

_COEF = coefficients(SENTENCE_WORDS + 8, 23)
_WORD_COEF = coefficients(WORD_SPAN, 29)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True
_CLOSERS = np.zeros(256, dtype=bool)
_CLOSERS[list(b"\"')]")] = True


class Sentences:
    """Sentences of the rows of an Arrow buffer: hash, first byte and words of each, and each row's first one; hashes and
    first bytes of all words, and each row's first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words, first, starts = hashed_words(data, off)
        n = len(words)
        self.word, self.word_start, self.word_row = words, starts, first
        self.row = np.zeros(len(off), np.int64)
        self.hash, self.start, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n:
            return
        space = _SPACE[data]
        stop = np.append(starts[1:], len(data))
        gaps = np.concatenate(([0], np.cumsum(space)))
        last = stop - 1 - (gaps[stop] - gaps[starts])  # a word's last byte: between two starts are the word and its gap
        ends = _ENDS[data[last]] | (_CLOSERS[data[last]] & (last > starts) & _ENDS[data[np.maximum(last - 1, 0)]])
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        begin = np.zeros(n, dtype=bool)
        begin[first[:-1][first[:-1] < n]] = True
        begin[1:] |= ends[:-1] | (lines[starts[1:]] > lines[last[:-1]])
        index = np.arange(n)
        within = index - np.maximum.accumulate(np.where(begin, index, 0))
        begin |= within % SENTENCE_WORDS == 0
        at = np.flatnonzero(begin)
        self.hash = mix64(np.add.reduceat(words * _COEF[within % SENTENCE_WORDS], at))
        self.start, self.words = starts[at], np.diff(np.append(at, n))
        self.row = np.searchsorted(at, first)

    def spans(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, place in the row) of every run of k consecutive sentences of a row."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h += self.hash[i : m + i] * _COEF[SENTENCE_WORDS + i]
        row = np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))
        ok = np.flatnonzero(row[:m] == row[k - 1 :])
        return mix64(h)[ok], row[ok], ok - self.row[row[ok]]

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first word in the row) of the chosen runs of WORD_SPAN words of a row."""
        m = len(self.word) - PASSAGE_WORDS + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(m + WINDOW - 1, np.uint64)
        for i in range(WORD_SPAN):
            h += self.word[i : len(h) + i] * _WORD_COEF[i]
        h = mix64(h)
        least, at, index = h[:m].copy(), np.arange(m), np.arange(m)
        for i in range(1, WINDOW):
            low = h[i : m + i] <= least
            np.copyto(least, h[i : m + i], where=low)
            np.copyto(at, index + i, where=low)
        row = np.repeat(np.arange(len(self.word_row) - 1), np.diff(self.word_row))
        chosen = np.unique(at[row[:m] == row[PASSAGE_WORDS - 1 :]])
        return h[chosen], row[chosen], chosen - self.word_row[row[chosen]]


def runs(places: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and ends of the runs of n words that the spans from places to ends cover."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, ends, -1)
    edge = np.diff(np.concatenate(([0], (np.cumsum(mark[:n]) > 0).astype(np.int64), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cut(text: bytes, places: np.ndarray, k: int, least: int) -> tuple[bytes, int, int]:
    """text without the words that spans at those places cover, sentences that lose words, and words removed. Places are
    twice a sentence's number, or twice a word's number plus 1."""
    s = Sentences(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    n, first = len(s.word), np.append(0, np.cumsum(s.words))
    of_sentences, of_words = places[places % 2 == 0] // 2, places[places % 2 == 1] // 2
    parts = [runs(first[of_sentences], first[np.minimum(of_sentences + k, len(s.words))], n), runs(of_words, of_words + WORD_SPAN, n)]
    long = [(a[b - a >= least], b[b - a >= least]) for a, b in parts]
    bounds = np.append(s.word_start, len(text))
    out, at, words, lost = [], 0, 0, np.zeros(n, bool)
    for a, b in zip(*runs(*(np.concatenate(x) for x in zip(*long, strict=True)), n), strict=True):
        out.append(text[at : bounds[a]])
        at, words = int(bounds[b]), words + int(b - a)
        lost[a:b] = True
    sentences = int(np.logical_or.reduceat(lost, first[:-1]).sum()) if n else 0
    return b"".join([*out, text[at:]]), sentences, words


def remove_repeats(docs: DataFrame, *, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, text without repeats, n_removed (sentences, whole or in part),
    removed_words and first_doc_ids, the sorted ids of the documents that hold the first occurrences of what its spans repeat.

    The first occurrence of a span is that with the least (doc_id, text hash, place), null ids last; all others are
    removed, in the same document too. Spans are compared word by word, A-Z as a-z, white space aside. Every repeated run
    of PASSAGE_WORDS words holds a span, and so loses WORD_SPAN words or more (if least_words allows); of its words at
    either end WINDOW - 1 at most stay.
    Defined results: a null text stays null, an empty one empty; runs of fewer than least_words words that spans of either
    kind cover stay; rows with equal id and text count as one occurrence; very long texts are handled
    whole; an empty table gives an empty result; other columns are ignored.
    """

    def hash_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8_column(b.column(2))
            for lo, hi in row_chunks(off):
                s = Sentences(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                (h, row, place), (h2, row2, word) = s.spans(span), s.word_spans()
                h, row, place = np.concatenate((h, h2)), np.concatenate((row, row2)), np.concatenate((2 * place, 2 * word + 1))
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(place)],
                    names=["h", "doc_id", "t", "place"]
                )

    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    spans = staged(source.mapInArrow(hash_spans, "h long, doc_id long, t long, place long"), "spans")
    repeated = staged(spans.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "spans-repeated")
    small = repeated.count() <= BROADCAST_HASHES
    hits = staged(spans.join(F.broadcast(repeated) if small else repeated, "h", "left_semi"), "spans-hits")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t", "place")
    # a table of its own: minima are combined before they are dealt out, and a join of two tables may split a hot hash
    firsts = staged(hits.groupBy("h").agg(F.min(order).alias("f")), "spans-firsts")
    later = hits.join(F.broadcast(firsts) if small else firsts, "h").where(order != F.col("f"))
    per_doc = later.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(
        F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.collect_set("f.doc_id")).alias("first_doc_ids")
    )
    removals = staged(per_doc, "spans-removals")
    size = removals.agg(F.coalesce(F.sum(F.size("places") + F.size("first_doc_ids")), F.lit(0))).collect()[0][0]
    marks = F.broadcast(removals) if size <= BROADCAST_POSITIONS else removals
    joined = source.join(
        marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")), "left"
    ).select("doc_id", "text", "places", "first_doc_ids")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "n_removed", "removed_words", "first_doc_ids"]
        for b in batches:
            changed = [i for i, p in enumerate(b.column(2).is_valid().to_pylist()) if p]
            n, w = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            text, ids = b.column(1), b.column(3)
            if changed:
                texts, ids = text.to_pylist(), ids.to_pylist()
                for i in changed:
                    new, n[i], w[i] = cut(texts[i].encode(), np.array(b.column(2)[i].as_py()), span, least_words)
                    texts[i] = new.decode()
                text = pa.array(texts, text.type)
                ids = pa.array([x if k else [] for x, k in zip(ids, n, strict=True)], pa.list_(pa.int64()))
            else:
                ids = pa.array([[]] * b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(n), pa.array(w), ids], names=names)

    return joined.mapInArrow(apply, "doc_id long, text string, n_removed long, removed_words long, first_doc_ids array<long>")


def op3(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
