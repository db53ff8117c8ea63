"""Exact top-k search: an inverted index in shards, BM25 with block-max pruning, merged with global statistics.

Of block-max WAND this has the pivots: blocks in document order whose summed block maxima reach the threshold. All lists have
the same blocks, so the sums are made for all blocks of a shard at once, and not list by list with cursors that skip.

A shard is the index of some documents of one input task, cut at a number of postings. Its documents are in the order of
their most frequent word and length, so that neighbours are alike; posting lists are in that order, in blocks of documents,
each with its greatest impact. A query's cursors walk the blocks in document order: the pivot is the next block whose block
maxima, summed over the query's lists, reach the threshold (of the longest lists the sums are known for each document, as they
are one product for many queries; there a block's maximum is that of the sums); blocks before it are skipped in all lists, and the postings of
pivot blocks alone are scored. Pivots are taken a growing number at a time, and the threshold rises after each such step.
A task carries each query's threshold from shard to shard. Queries are a table in the shared folder that tasks read block
by block, so they're neither broadcast nor joined with all rows, and their answers leave block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import bounded_batches, filesystem, fresh_path, hashed_words, row_chunks, staged, utf8_column

K1, B, TOP = 1.2, 0.75, 10
BLOCK = 32
#: Scores are compared after rounding, so equal texts tie whatever the order of their sums; ties go to the lower id.
DECIMALS = 6
EPSILON = 10.0**-DECIMALS
#: Blocks with the greatest bounds that a query without a threshold looks at first, and blocks of the first step.
SEEDS, STEP = 4, 64
#: Postings, and documents, of a shard at most (a longer document is a shard of its own).
SHARD_POSTINGS, SHARD_DOCS = 4_000_000, 65_536
#: Distinct terms of all queries up to which their weights are broadcast (16 bytes each); beyond, they are joined by salted keys.
BROADCAST_TERMS, SALTS = 300_000, 16
#: Lists of at least one document in so many are also kept as rows of impacts, so that many queries' sums over them are one product.
DENSE_SHARE, MOST_DENSE = 20, 512
#: Cells of those rows at most.
DENSE_CELLS = 1 << 24
#: Sums over dense lists (queries times documents) that are made at once.
SUMS = 1 << 21


def term_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, and each row's words."""
    words, first, _ = hashed_words(data, off)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    if not len(words):
        return row, words, np.zeros(0, np.int64), size
    new = np.concatenate(([True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])))
    at = np.flatnonzero(new)
    return row[at], words[at], np.diff(np.append(at, len(words))), size


class Shard:
    """The index of some documents: lists of postings, cut into entries, one for each block of documents that a list has."""

    def __init__(self, terms, starts, docs, counts, ids, sizes, mean: float, nulls=None):
        self.terms, self.starts, self.docs, self.ids = terms, starts, docs.astype(np.int32), ids
        self.nulls = np.zeros(len(ids), bool) if nulls is None else nulls
        norm = K1 * (1 - B + B * sizes / mean) if mean else np.full(len(sizes), K1)
        self.impact = counts.astype(np.float64)
        self.impact *= (K1 + 1) / (self.impact + norm[self.docs])
        which = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(starts))
        block = self.docs // BLOCK
        new = np.flatnonzero(
            np.concatenate(([True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])))
        ) if len(docs) else np.zeros(0, np.int64)
        self.n_blocks = -(-len(ids) // BLOCK)
        self.entry_block = block[new]
        self.entry_most = np.maximum.reduceat(self.impact, new) if len(new) else np.zeros(0)
        self.entry_from = np.append(new, len(docs))
        self.entry_starts = np.searchsorted(new, starts)
        size = np.diff(starts)
        long = np.argsort(-size, kind="stable")[: min(MOST_DENSE, DENSE_CELLS // max(1, len(sizes)))]
        long = long[size[long] * DENSE_SHARE >= len(sizes)]
        self.dense_row = np.full(len(terms), -1, np.int64)
        self.dense_row[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.n_blocks * BLOCK))
        for i, t in enumerate(long):
            self.dense[i, self.docs[starts[t] : starts[t + 1]]] = self.impact[starts[t] : starts[t + 1]]
        self.scored = 0  # documents of pivot blocks, over all queries

    def _gather(self, starts: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the lists, and which list each is in."""
        size = starts[lists + 1] - starts[lists]
        which = np.repeat(np.arange(len(lists)), size)
        return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + starts[lists][which], which

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that may be among the k best, given that k scores of `least` are known (0: none)."""
        return next(self.search_all([(terms, weights)], k, [least]))

    def search_all(self, queries: list, k: int, least: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What search gives for each of the queries (terms, weights). Sums over the dense lists are exact and made for many
        queries at once; so a block's bound is its greatest such sum and the block maxima of the other lists."""
        many = max(1, SUMS // max(1, self.dense.shape[1]))
        for i in range(0, len(queries), many):
            some = [self._lists(*q) for q in queries[i : i + many]]
            heads = np.zeros((len(some), len(self.dense)))
            for head, (at, w) in zip(heads, some, strict=True):
                row = self.dense_row[at]
                head[row[row >= 0]] = w[row >= 0]
            for sums, (at, w), known in zip(heads @ self.dense, some, least[i : i + many], strict=True):
                yield self._search(at, w, sums, k, known)

    def _lists(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of those terms that the shard has, and their weights."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return at[hit], weights[hit]

    def _search(self, at: np.ndarray, w: np.ndarray, acc: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """acc: sums over the dense lists, to which those over the others are added in pivot blocks."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        rare = self.dense_row[at] < 0
        at, w = at[rare], w[rare]
        entry, which = self._gather(self.entry_starts, at)
        block, entry_w = self.entry_block[entry], w[which]
        bound = acc.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, self.entry_most[entry] * entry_w, self.n_blocks)
        done = np.zeros(self.n_blocks, bool)
        best_k = np.zeros(0)

        def score(pivots: np.ndarray) -> None:
            nonlocal best_k, least
            done[pivots] = True
            chosen = np.zeros(self.n_blocks, bool)
            chosen[pivots] = True
            mine = np.flatnonzero(chosen[block])
            place, of = self._gather(self.entry_from, entry[mine])
            acc[:] += np.bincount(self.docs[place], self.impact[place] * entry_w[mine][of], len(acc))
            seen = acc.reshape(-1, BLOCK)[pivots].ravel()
            self.scored += len(seen)
            best_k = np.concatenate((best_k, seen))
            if len(best_k) > k:
                best_k = np.partition(best_k, len(best_k) - k)[len(best_k) - k :]
            if len(best_k) == k:
                least = max(least, float(best_k.min()))

        if least == 0 and self.n_blocks > SEEDS:
            score(np.sort(np.argpartition(-bound, SEEDS)[:SEEDS]))
        left, step = np.flatnonzero((bound > 0) & ~done), STEP
        while len(left := left[bound[left] >= least - EPSILON]):
            score(left[:step])  # the next pivots, in document order
            left, step = left[step:], 2 * step
        found = np.flatnonzero((acc > 0) & (acc >= least - EPSILON))  # in blocks that were left out no sum is as great
        return found, acc[found]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.round(scores, DECIMALS)))[:k]
    return ids[order], scores[order]


def neighbours(row: np.ndarray, term: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the documents by their most frequent term, then by length."""
    top, order = np.zeros(len(size), np.uint64), np.lexsort((term, -count.astype(np.int64), row))
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    top[row[first]] = term[order][first]
    return np.lexsort((size, top))


def build_index(docs: DataFrame) -> DataFrame:
    """A staged row for each shard: sorted terms, list starts, documents and counts of the lists, ids, null ids and sizes."""
    shape = "n_docs long, n_words long, terms binary, starts binary, docs binary, counts binary, ids binary, nulls binary, sizes binary"
    most_postings, most_docs = SHARD_POSTINGS, SHARD_DOCS

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        ids, nulls, size = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        before = np.cumsum([0, *(len(p[3]) for p in parts)])
        row = np.concatenate([p[0] + n for p, n in zip(parts, before, strict=False)])
        term, count = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = neighbours(row, term, count, size)
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        doc = rank[row]
        by = np.lexsort((doc, term))
        term, doc, count = term[by], doc[by].astype(np.uint32), count[by].astype(np.uint32)
        at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        starts = np.append(at, len(term)).astype(np.int64)
        values = (len(size), int(size.sum()), term[at], starts, doc, count, ids[order], nulls[order], size[order].astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([x if isinstance(x, int) else x.tobytes()]) for x in values], names=[x.split()[0] for x in shape.split(", ")]
        )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, held = [], 0, 0
        for b in batches:
            data, off = utf8_column(b.column(1))
            null = ~b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in row_chunks(off):
                row, term, count, size = term_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if parts and (n + len(term) > most_postings or held + hi - lo > most_docs):
                    yield shard(parts)
                    parts, n, held = [], 0, 0
                parts.append((row, term, count, ids[lo:hi], null[lo:hi], size))
                n, held = n + len(term), held + hi - lo
        if parts:
            yield shard(parts)

    return staged(docs.select("doc_id", "text").mapInArrow(index, shape), "search-index")


def with_weights(wanted: DataFrame, weight: DataFrame) -> DataFrame:
    """Rows of wanted (query_row, query_id, term) with their term's weight (term, w). Common words are in many queries:
    weights are broadcast while they are few, else dealt out by salted keys. Those are merged whatever size Spark expects,
    as it may take the weights, SALTS times each, for few enough to go through the driver."""
    if weight.count() <= BROADCAST_TERMS:
        return wanted.join(F.broadcast(weight), "term")
    salted = wanted.withColumn("salt", F.pmod("query_row", F.lit(SALTS)))
    copies = weight.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return salted.join(copies.hint("merge"), ["term", "salt"])


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of queries (query_id, text) the k best rows of docs (doc_id, text).

    BM25 over words with A-Z as a-z, each distinct word of the query once; df, the number of rows and the mean length
    count all rows of docs. Ties at six decimals go to the lower doc_id, null ids last.
    Defined results: null and empty texts match nothing, as queries or as documents (they count as rows of no length);
    documents that share no word with the query aren't returned, so a query may have fewer than k rows; repeated rows
    are separate results; repeated queries, or those with a null id, are answered each (told apart by query_row); very
    long texts are indexed whole; empty tables give no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    index = build_index(docs)
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).collect()[0]
    mean = n_words / n_docs if n_docs else 0.0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, starts in zip(b.column(0), b.column(1), strict=True):
                t, df = np.frombuffer(terms.as_buffer(), np.int64), np.diff(np.frombuffer(starts.as_buffer(), np.int64))
                for i in range(0, len(t), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(t[i : i + 100_000]), pa.array(df[i : i + 100_000])], names=["term", "df"])

    def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8_column(b.column(2))
            for lo, hi in row_chunks(off):
                row, term, _, _ = term_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(term.view(np.int64))], names=["query_row", "query_id", "term"]
                )

    asked = staged(queries.select(F.monotonically_increasing_id().alias("query_row"), "query_id", "text"), "search-queries")
    wanted = staged(asked.mapInArrow(query_terms, "query_row long, query_id long, term long"), "search-terms")
    held = index.select("terms", "starts").mapInArrow(spread, "term long, df long").withColumn("asked", F.lit(False))
    every = held.unionByName(wanted.select("term", F.lit(0).cast("long").alias("df"), F.lit(True).alias("asked")))
    df = every.groupBy("term").agg(F.sum("df").alias("df"), F.max("asked").alias("asked")).where("asked AND df > 0")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = staged(df.select("term", idf.alias("w")), "search-idf")
    both = with_weights(wanted, weight)
    weighed = both.select("query_row", "query_id", F.struct("term", "w").alias("t"))
    table = weighed.groupBy("query_row", "query_id").agg(F.array_sort(F.collect_list("t")).alias("t"))  # a query's own words
    path = fresh_path(spark, "search-weights")
    table.select("query_row", "query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")).write.parquet(path)

    def blocks(rows: int) -> Iterator[pa.RecordBatch]:
        """All queries, a bounded number at a time, always in the same order."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = filesystem(path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
        for f in files:
            with store.open_input_file(f) as stream:
                yield from pq.ParquetFile(stream).iter_batches(batch_size=rows)

    shape = "query_row long, query_id long, doc_id long, score double"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, float] = {}  # of each query, once k scores are known
        kinds = (np.uint64, np.int64, np.uint32, np.uint32, np.int64, np.bool_, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                *part, nulls, sizes = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in enumerate(kinds))
                shard = Shard(*part, sizes, mean, nulls)
                for q in blocks(256):
                    rows, which_row = [], q.column(0).to_pylist()
                    asking = [
                        sort_terms(t.values.to_numpy().view(np.uint64), w.values.to_numpy())
                        for t, w in zip(q.column(2), q.column(3), strict=True)
                    ]
                    answers = shard.search_all(asking, k, [least.get(row, 0.0) for row in which_row])
                    for row, qid, (found, score) in zip(which_row, q.column(1), answers, strict=True):
                        if len(found):
                            order = np.lexsort((shard.ids[found], shard.nulls[found], -np.round(score, DECIMALS)))[:k]
                            rows.append((row, qid.as_py(), found[order], score[order]))
                            if len(order) == k:
                                least[row] = max(least.get(row, 0.0), float(score[order].min()))
                    if rows:
                        docs, size = np.concatenate([x[2] for x in rows]), [len(x[2]) for x in rows]
                        which = pa.array(np.repeat(np.arange(len(rows)), size))
                        columns = [
                            pa.array([x[0] for x in rows], pa.int64()).take(which),
                            pa.array([x[1] for x in rows], pa.int64()).take(which),
                            pa.array(shard.ids[docs], mask=shard.nulls[docs]),
                            pa.array(np.concatenate([x[3] for x in rows])),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in shape.split(", ")])

    found = index.select("terms", "starts", "docs", "counts", "ids", "nulls", "sizes").mapInArrow(answer, shape)
    score: Column = F.round("score", DECIMALS)
    order = Window.partitionBy("query_row").orderBy(score.desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", score.alias("score"), "query_row")


def sort_terms(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms)
    return terms[order], weights[order]


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, queries).select("query_id", "rank", "doc_id", "score")


ORACLE_OP9 = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS c FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(c) AS n FROM tf GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(n) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS m),
df AS (SELECT t, ln(1 + (g.n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM tf, g GROUP BY t, g.n),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(df.w * d.c * {K1 + 1} / (d.c + {K1} * ({1 - B} + {B} * dl.n / g.m))) AS score
  FROM tf q JOIN df ON q.t = df.t JOIN tf d ON d.t = q.t JOIN dl ON dl.doc_id = d.doc_id, g
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id),
r AS (SELECT query_id, doc_id, round(score, {DECIMALS}) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {DECIMALS}) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
