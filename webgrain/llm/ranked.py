"""Ranked lexical search: the best documents for each item of a set, by a join of items and postings that thresholds prune.

With each term its greatest impacts are stored. The k-th of them, times the item's repeats, bounds the item's k-th score from
below, as k documents reach it by that term alone: the item's first threshold, before any document is scored. The item's
terms are put in order of their greatest contribution. The longest run of the least ones that together stay below the
threshold can't bring a document up by themselves, so postings of the other terms alone make candidates; these are then
scored term by term, greatest first, and dropped once all terms left can't lift them to the threshold any more. What is
left after the last term has its exact score. Thresholds rise with the scores that a task has found.

All scores are 64-bit integers. Documents are indexed in shards, of the terms that items have; items are a table in the shared
folder that tasks read block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import bounded_batches, dealt, filesystem, fresh_path, hashed_words, row_chunks, staged, utf8_column

TOP = 10
# Parameters of the score
SCALE, TF_SCALE, LENGTH_PERCENT, K1_X1000 = 1_000_000_000, 1000, 75, 8
#: Postings, and documents, of a shard at most (a longer document is a shard of its own).
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 16_384
#: Distinct terms of all items up to which tasks get them (8 bytes each) and index no others; beyond, all terms are indexed.
SENT_TERMS = 2_000_000
#: Items that a task holds at once.
ITEM_BLOCK = 512
#: Sums below this are exact in doubles.
EXACT = 1 << 53

_TERM_BYTES = np.arange(256, dtype=np.uint8)
_TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32
_TERM_BYTES[65:91] += 32


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each term, first term of each row: offsets): runs of letters, digits and bytes beyond ASCII."""
    return hashed_words(_TERM_BYTES[data], off, lower=False)[:2]


def counted(terms: np.ndarray, first: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, by row; those of known (sorted) alone, if it is given."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if known is None:
        known = np.unique(terms)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.searchsorted(known, terms)
    at[at == len(known)] = 0
    hit = known[at] == terms
    key, count = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
    return key // len(known), known[key % len(known)], count


def lengths_scaled(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part m of the score, for documents of these sizes, n_docs of which have n_terms together."""
    if not n_terms:
        return np.full(len(sizes), 100, np.int64)
    if int(sizes.max(initial=0)) * LENGTH_PERCENT * n_docs < 1 << 63:
        share = LENGTH_PERCENT * sizes * n_docs // n_terms
    else:
        share = np.array([LENGTH_PERCENT * int(n) * n_docs // n_terms for n in sizes], np.int64)
    return 100 - LENGTH_PERCENT + share


def added(at: np.ndarray, values: np.ndarray, n: int, most: int) -> np.ndarray:
    """Sums of integer values by place; most: what no sum exceeds."""
    if most < EXACT:
        return np.bincount(at, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


class Shard:
    """Posting lists of some documents, by term, each in document order."""

    COLUMNS = ("terms", "starts", "docs", "counts", "ids", "nulls", "sizes")
    KINDS = (np.uint64, np.int64, np.uint32, np.uint32, np.int64, np.bool_, np.int64)

    def __init__(self, values: list[bytes], n_docs: int, n_terms: int):
        self.terms, self.starts, self.docs, counts, self.ids, self.nulls, sizes = (
            np.frombuffer(v, t) for v, t in zip(values, self.KINDS, strict=True)
        )
        tf = counts.astype(np.int64)
        m = lengths_scaled(sizes, n_docs, n_terms)
        self.impact = SCALE * tf // (TF_SCALE * tf + K1_X1000 * m[self.docs])
        self.scored = 0  # candidates, over all items

    def greatest(self, k: int) -> pa.RecordBatch:
        """(term, df, impact): the k greatest impacts of each term; its number of documents on the first row, 0 on others."""
        size = np.diff(self.starts)
        which = np.repeat(np.arange(len(self.terms)), size)
        order = np.lexsort((-self.impact, which))
        place = np.arange(len(which)) - self.starts[which]
        kept = place < k
        which = which[kept]
        df = np.where(place[kept] == 0, size[which], 0)
        columns = [pa.array(self.terms[which].view(np.int64)), pa.array(df), pa.array(self.impact[order[kept]])]
        return pa.RecordBatch.from_arrays(columns, names=["term", "df", "impact"])

    def search(self, terms: np.ndarray, weights: np.ndarray, upto: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best of this shard with a score of least or more, best first.

        terms and weights of an item are in ascending order of greatest contribution; upto sums these from the start.
        """
        if not len(self.terms) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pruned = int(np.searchsorted(upto, least))  # terms before this one stay below least together
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        held = self.terms[at] == terms
        own = np.flatnonzero(held[pruned:]) + pruned
        size = self.starts[at[own] + 1] - self.starts[at[own]]
        which = np.repeat(np.arange(len(own)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.starts[at[own]][which]
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = added(self.docs[place], weights[own][which] * self.impact[place], len(self.ids), int(upto[-1]))
        rest = int(upto[pruned - 1]) if pruned else 0
        docs = np.flatnonzero((score > 0) & (score + rest >= least))
        score = score[docs]
        self.scored += len(docs)
        for t in range(pruned - 1, -1, -1):
            if not len(docs):
                break
            if held[t]:
                a, b = self.starts[at[t]], self.starts[at[t] + 1]
                found = np.searchsorted(self.docs[a:b], docs)
                found[found == b - a] = 0
                score = score + np.where(self.docs[a:b][found] == docs, weights[t] * self.impact[a:b][found], 0)
            left = int(upto[t - 1]) if t else 0
            stays = score + left >= least
            docs, score = docs[stays], score[stays]
        best = np.lexsort((self.ids[docs], self.nulls[docs], -score))[:k]
        return docs[best], score[best]


def build_index(docs: DataFrame, known: np.ndarray | None) -> DataFrame:
    """A staged row for each shard: numbers of documents with terms and of their terms, and the columns of Shard."""
    shape = "n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in Shard.COLUMNS)
    names = [c.split()[0] for c in shape.split(", ")]
    most_postings, most_docs = SHARD_POSTINGS, SHARD_DOCS
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        ids, nulls, size = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        before = np.cumsum([0, *(len(p[3]) for p in parts)])
        doc = np.concatenate([p[0] + n for p, n in zip(parts, before, strict=False)])
        term, count = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        by = np.argsort(term, kind="stable")
        term = term[by]
        at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        columns = (term[at], np.append(at, len(term)), doc[by], count[by], ids, nulls, size)
        data = [c.astype(t).tobytes() for c, t in zip(columns, Shard.KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (int((size > 0).sum()), int(size.sum()), *data)], names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, held = [], 0, 0
        for b in batches:
            data, off = utf8_column(b.column(1))
            null = ~b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in row_chunks(off):
                terms, first = term_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                row, term, count = counted(terms, first, sent.value)
                if parts and (n + len(term) > most_postings or held + hi - lo > most_docs):
                    yield shard(parts)
                    parts, n, held = [], 0, 0
                parts.append((row, term, count, ids[lo:hi], null[lo:hi], np.diff(first)))
                n, held = n + len(term), held + hi - lo
        if parts:
            yield shard(parts)

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, shape), "ranked-index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_row, item_id, term, repeats) of the distinct terms of each item, staged."""
    shape = "item_row long, item_id long, term long, repeats long"

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8_column(b.column(2))
            for lo, hi in row_chunks(off):
                terms, first = term_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                row, term, count = counted(terms, first, None)
                at = pa.array(row + lo)
                columns = [b.column(0).take(at), b.column(1).take(at), pa.array(term.view(np.int64)), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_row", "item_id", "term", "repeats"])

    numbered = items.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long"), "text")
    return staged(staged(numbered, "ranked-items").mapInArrow(terms_of, shape), "ranked-terms")


def stored_impacts(index: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, df, most, kth): documents of each term, its greatest impact, and its k-th, 0 where fewer documents have it."""

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield Shard([row[c] for c in Shard.COLUMNS], n_docs, n_terms).greatest(k)

    shards = staged(index.select(*Shard.COLUMNS).mapInArrow(greatest, "term long, df long, impact long"), "ranked-impacts")
    by_impact = Window.partitionBy("term").orderBy(F.col("impact").desc())
    ranked = shards.select("term", "impact").withColumn("place", F.row_number().over(by_impact)).where(F.col("place") <= k)
    best = ranked.groupBy("term").agg(
        F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth")
    )
    return shards.groupBy("term").agg(F.sum("df").alias("df")).join(best, "term")


def seeded_items(wanted: DataFrame, impacts: DataFrame, n_docs: int) -> DataFrame:
    """A row for each item that any document can score for: (item_row, item_id, least, t), t its (upto, term, weight) in
    ascending order of greatest contribution; weight: w times repeats."""
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(impacts, "term").withColumn("weight", w * F.col("repeats")).where("weight > 0")
    most = F.col("weight") * F.col("most")
    ascending = Window.partitionBy("item_row").orderBy(most, "term").rowsBetween(Window.unboundedPreceding, 0)
    summed = weighed.select(
        "item_row", "item_id", F.struct(F.sum(most).over(ascending).alias("upto"), "term", "weight").alias("t"),
        (F.col("weight") * F.col("kth")).alias("seed"),
    )
    return summed.groupBy("item_row", "item_id").agg(
        F.max("seed").alias("least"), F.array_sort(F.collect_list("t")).alias("t")  # an item's own terms
    )


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score, item_row): for each row of items (item_id, text) the k best rows of docs (doc_id, text).

    Terms, weights and scores are those of the contract of op11: integers, with counts over all rows of docs.
    Defined results: null and empty texts have no terms, as items or as documents, and count neither among the documents nor
    in their length; documents that score 0 aren't returned, so an item may have fewer than k rows, or none; equal scores
    go to the lower doc_id, null ids last; repeated documents are results each; repeated items, or those with a null id, are
    answered each (told apart by item_row); very long texts are read whole; empty tables give no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = item_terms(items)
    distinct = wanted.select("term").distinct()
    known = None
    if distinct.count() <= SENT_TERMS:
        known = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
    index = build_index(docs, known)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).collect()[0]
    path = fresh_path(spark, "ranked-seeds")
    seeded = seeded_items(wanted, stored_impacts(index, n_docs, n_terms, k), n_docs)
    seeded.select("item_row", "item_id", "least", "t.upto", "t.term", "t.weight").write.parquet(path)

    def blocks() -> Iterator[pa.RecordBatch]:
        """All items, a bounded number at a time."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = filesystem(path)
        for f in sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")):
            with store.open_input_file(f) as stream:
                yield from pq.ParquetFile(stream).iter_batches(batch_size=ITEM_BLOCK)

    shape = "item_row long, item_id long, doc_id long, score long"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # of each item, the k best scores that this task has found
        for b in batches:
            for row in b.to_pylist():
                shard = Shard([row[c] for c in Shard.COLUMNS], n_docs, n_terms)
                for items_ in blocks():
                    rows = []
                    for item, item_id, least, upto, term, weight in zip(*items_.columns, strict=True):
                        item, least = item.as_py(), max(1, least.as_py())
                        mine = best.get(item, np.zeros(0, np.int64))
                        if len(mine) == k:
                            least = max(least, int(mine[-1]))
                        t, w, u = (x.values.to_numpy() for x in (term, weight, upto))
                        found, score = shard.search(t.view(np.uint64), w, u, least, k)
                        if len(found):
                            best[item] = -np.sort(-np.concatenate((mine, score)))[:k]
                            rows.append((item, item_id.as_py(), found, score))
                    if rows:
                        at = pa.array(np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]))
                        found = np.concatenate([r[2] for r in rows])
                        columns = [
                            pa.array([r[0] for r in rows], pa.int64()).take(at), pa.array([r[1] for r in rows], pa.int64()).take(at),
                            pa.array(shard.ids[found], mask=shard.nulls[found]), pa.array(np.concatenate([r[3] for r in rows])),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["item_row", "item_id", "doc_id", "score"])

    scored = index.select(*Shard.COLUMNS).mapInArrow(answer, shape)
    order = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score", "item_row")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked_search(dealt(docs), items).select("item_id", "rank", "doc_id", "score")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE_OP11 = f"""
WITH q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS t FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM dl),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM dl, g),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
