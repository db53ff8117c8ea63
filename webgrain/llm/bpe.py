"""Byte-level BPE over a corpus: each distinct word is encoded once, whatever the number of its places.

Texts are split into words (matches of the vocabulary's pattern), and words are exploded with their places: a chunk, some
documents of one input task, keeps the sequence of its words as numbers, most frequent first, and gives its distinct words
to a global shuffle by hash. There a distinct word meets all chunks that have it, is encoded once, and its ids go back to
each of those chunks, where they are put in the words' places. A word that a third of the corpus consists of is one row of
each chunk. Both kinds of rows are packed (bytes a word instead of rows), and staged before they are shuffled, so numbers
and words of a chunk always stem from the same reading of the input.

Decoding looks ids up in the table of the tokens' bytes, which is as large as the vocabulary file.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import apart, bounded_batches, dealt, staged

#: Bytes of text of a chunk, about (a longer document is a chunk of its own).
CHUNK_BYTES = 32 << 20
#: Characters of a text whose words are listed at once; words of a longer one are listed by blocks.
LISTED_CHARS, BLOCK_WORDS = 1 << 22, 1 << 20
#: Distinct words whose ids a task keeps; beyond, it starts anew, and a word met again is encoded again.
KEPT_WORDS = 2_000_000
#: Least number of parts of the global shuffle; spark.sql.shuffle.partitions, if that is more.
LEAST_BUCKETS = 16
#: Compression of what is staged and shuffled.
LEVEL = 9
#: Words that are put together at once, about.
SLICE_WORDS = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def words_of(text: str, pattern) -> Iterator[list[str]]:
    """Lists of the pattern's matches, in order; a bounded number at a time for a long text."""
    if len(text) <= LISTED_CHARS:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while block := list(islice(found, BLOCK_WORDS)):
        yield block


def packed(values: np.ndarray | bytes) -> bytes:
    """Bytes, or those of an array one byte of each number after the other, compressed; their length comes first."""
    planes = values if isinstance(values, bytes) else values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(planes, asbytes=True)


def unpacked(data: bytes, kind: str | None = None):
    """The bytes, or the numbers of a kind, that were packed."""
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    if kind is None:
        return planes
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind)[:, 0] if size else np.zeros(0, kind)


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Documents whose words are numbered together."""

    def __init__(self) -> None:
        self.numbers, self.ids, self.sizes, self.places, self.bytes = Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, text: str, pattern) -> None:
        n = 0
        for words in words_of(text, pattern):
            self.places.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
            n += len(words)
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.bytes += len(text)

    def rows(self, chunk: int, buckets: int) -> Iterator[dict]:
        """The documents' row, with bucket -1, and for each bucket that has any a row of distinct words, most frequent first.

        The documents' row knows each word's bucket, so that words and, later, their ids travel without their numbers.
        """
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        words, ids, sizes = list(self.numbers), self.ids, np.array(self.sizes, np.int64)
        self.__init__()
        order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        places = rank[places]
        bucket = np.fromiter((zlib.crc32(words[i].encode()) % buckets for i in order), np.uint32, len(words))
        null = np.array([i is None for i in ids], np.uint8)
        head = {
            "doc_ids": packed(np.array([i or 0 for i in ids], np.int64)), "nulls": packed(null), "sizes": packed(sizes),
            "words": packed(bucket), "places": packed(places),
        }
        yield {"chunk": chunk, "bucket": -1, "n_words": len(words), **head}
        del places, head
        by = np.argsort(bucket, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else ():
            utf8 = [words[order[i]].encode() for i in group]
            lengths = packed(np.fromiter(map(len, utf8), np.int64, len(utf8)))
            row = {"chunk": chunk, "bucket": int(bucket[group[0]]), "n_words": len(group)}
            yield row | {"doc_ids": None, "nulls": None, "sizes": lengths, "words": packed(b"".join(utf8)), "places": None}


SPLIT_DDL = "chunk long, bucket int, n_words long, doc_ids binary, nulls binary, sizes binary, words binary, places binary"
SPLIT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n_words", pa.int64()), *((c.split()[0], pa.binary()) for c in SPLIT_DDL.split(", ")[3:])])


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    """data in pieces of these sizes."""
    edges = np.append(0, np.cumsum(sizes)).tolist()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def split_words(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """The chunks' rows (see Chunk.rows), staged."""
    most = CHUNK_BYTES

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        compiled, chunk = regex.compile(pattern), Chunk()
        number = TaskContext.get().partitionId() << 33  # chunks of a task follow each other from here

        def done() -> Iterator[pa.RecordBatch]:
            for row in chunk.rows(number, buckets):
                yield pa.RecordBatch.from_pylist([row], schema=SPLIT)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunk.add(doc_id, text.as_py() or "", compiled)
                if chunk.bytes >= most:
                    yield from done()
                    number += 1
        if chunk.ids:
            yield from done()

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, SPLIT_DDL), "bpe-words")


def encode_words(words: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """The rows of distinct words with their ids: equal words meet in one task, which encodes them once."""
    most = KEPT_WORDS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        model = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

        class Known(dict):
            def __missing__(self, word: bytes) -> bytes:
                self[word] = ids = np.array(model.encode_ordinary(word.decode()), "<u4").tobytes()
                return ids

        known = Known()
        for b in batches:
            for row in b.to_pylist():
                ids = list(map(known.__getitem__, cut(unpacked(row["words"]), unpacked(row["sizes"], "i8"))))
                row["sizes"] = packed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
                row["words"] = packed(np.frombuffer(b"".join(ids), "<u4"))
                yield pa.RecordBatch.from_pylist([row], schema=SPLIT)
                if len(known) > most:
                    known.clear()

    return words.repartitionById(buckets, F.col("bucket")).mapInArrow(encode, SPLIT_DDL)


def put_together(parts: DataFrame) -> DataFrame:
    """(doc_id, ids) from the rows of documents and of encoded words of each chunk."""

    def chunk(head: dict, words: list[dict]) -> Iterator[pa.RecordBatch]:
        flat = [unpacked(w["words"], "<u4") for w in words]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        sizes = np.concatenate([np.zeros(0, np.int64), *(unpacked(w["sizes"], "i8") for w in words)])
        if len(sizes) != head["n_words"]:
            raise RuntimeError("a chunk lacks ids of some of its words")
        by = np.argsort(unpacked(head["words"], "u4"), kind="stable")  # rows of words come by bucket, their words by number
        size, start = np.empty_like(sizes), np.empty_like(sizes)
        size[by], start[by] = sizes, np.cumsum(sizes) - sizes
        places, n = unpacked(head["places"], "u4"), unpacked(head["sizes"], "i8")
        first = np.append(0, np.cumsum(n))
        ids = pa.array(unpacked(head["doc_ids"], "i8"), mask=unpacked(head["nulls"], "u1").astype(bool))
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE_WORDS, side="right")) - 1)
            place = places[first[a] : first[b]]
            upto = np.append(0, np.cumsum(size[place]))[first[a : b + 1] - first[a]]
            data = ragged(flat, start[place], size[place]).astype("<u4").tobytes()
            texts = pa.array(cut(data, 4 * np.diff(upto)), pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), texts], names=["doc_id", "ids"])
            a = b

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, words = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] >= 0:
                    words.append(row)
                    continue
                if head:
                    yield from chunk(head, words)
                head, words = row, []
        if head:
            yield from chunk(head, words)

    sorted_ = parts.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return sorted_.mapInArrow(assemble, "doc_id long, ids binary")


def encode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text): its token ids, as little-endian unsigned 32-bit integers.

    path: a file of ranks, which every executor can read; pattern: the regular expression whose matches are encoded each.
    The ids are those of the tiktoken library without special tokens, whose text is encoded like any other.
    Defined results: null and empty texts have no ids; null ids of documents pass through; repeated rows give a row each;
    very long texts are encoded whole, and very long words by the library; an empty table gives no rows; other columns are
    ignored. Rows come in no order.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path, pattern = path or default_path(), pattern or default_pattern()
    buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = split_words(docs, pattern, buckets)
    encoded = encode_words(parts.where("bucket >= 0"), path, pattern, buckets)
    return put_together(parts.where("bucket < 0").unionByName(encoded))


def decode(rows: DataFrame, *, path: str | None = None) -> DataFrame:
    """rows with a column decoded, the bytes of their ids, in place of ids (little-endian unsigned 32-bit integers).

    Defined results: null ids decode to null, none to no bytes; an id that the file doesn't have is an error; other columns
    and repeated rows pass through; an empty table stays empty.
    """
    bounded_batches(rows.sparkSession)
    path = path or default_path()
    row, others = apart(rows.withColumn("_", F.lit(0)), ["ids"], "ids")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        token = dict(zip(ranks.values(), ranks, strict=True))
        size = np.full(max(token, default=-1) + 1, -1, np.int64)
        for i, t in token.items():
            size[i] = len(t)
        flat = np.frombuffer(b"".join(token.get(i, b"") for i in range(len(size))), np.uint8)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        for b in batches:
            out = []
            for value in b.column(1):
                if not value.is_valid:
                    out.append(None)
                    continue
                ids = np.frombuffer(value.as_buffer(), "<u4")
                if len(ids) and (ids.max() >= len(size) or size[ids].min() < 0):
                    raise ValueError("an id is not in the vocabulary")
                cuts = range(0, len(ids), SLICE_WORDS)
                out.append(b"".join(ragged(flat, start[x], size[x]).tobytes() for x in (ids[c : c + SLICE_WORDS] for c in cuts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["row", "decoded"])

    return row.mapInArrow(look_up, row.drop("ids").schema.add("decoded", "binary")).select(*others, "decoded").drop("_")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(dealt(docs)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids"
    )
    return decode(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
