"""Token-ID files: patched frame-of-reference blocks with an index of block starts.

A corpus becomes shards, in ascending order of document ids. A shard file holds

    magic "WGP1", block size (uint32)
    blocks: minimum (uint32), width in bits (uint8), exceptions (uint16), the block's values less the minimum packed at
            that width (little-endian bits; exceptions packed as 0), positions (uint16) and values (uint32) of exceptions
    block starts (uint64 each), document ids (int64 each), null marks (uint8 each), tokens before each document and at
            the end (uint64 each)
    footer: blocks, documents, tokens, place of the block starts (uint64 each), magic

The width is that of the block's 95th percentile; larger values are the exceptions. A task writes its shard under a name of
its own and reports it in a manifest that Spark commits, so repeated or lost tasks never spoil what is read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import filesystem, fresh_path, staged
from webgrain.llm.tokens import binary_texts, default_path, encoder

MAGIC = b"WGP1"
BLOCK = 256
PERCENTILE = 95
HEAD, FOOT = struct.Struct("<IBH"), struct.Struct("<QQQQ4s")
#: Ids that are gathered before blocks are written, and decoded at once at most.
CHUNK = 1 << 20


def bit_widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ids (the last may be short; it is padded with its own last value)."""
    if not len(ids):
        return []
    pad = -len(ids) % block
    x = np.concatenate((ids, np.repeat(ids[-1:], pad))).astype(np.uint32).reshape(-1, block)
    low = x.min(axis=1)
    d = x - low[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = bit_widths(np.partition(d, rank, axis=1)[:, rank])
    over = d >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    packed: list[bytes] = [b""] * len(x)
    kept = np.where(over, 0, d).astype(np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 1024)):
            bits = ((kept[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            for i, b in zip(part, np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little"), strict=True):
                packed[i] = b.tobytes()
    out = []
    for i in range(len(x)):
        at = np.flatnonzero(over[i])
        out.append(
            HEAD.pack(int(low[i]), int(width[i]), len(at)) + packed[i] + at.astype("<u2").tobytes() + d[i][at].astype("<u4").tobytes()
        )
    return out


def decode_blocks(data: bytes, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Values of the blocks at those byte starts in data, as uint32."""
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    out = np.zeros((len(starts), block), dtype=np.uint32)
    heads = [HEAD.unpack_from(data, s) for s in starts]
    low = np.array([h[0] for h in heads], dtype=np.uint32)
    width = np.array([h[1] for h in heads], dtype=np.int64)
    for w in np.unique(width):
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        bit = np.arange(block, dtype=np.int64) * w
        at = (starts[rows] + HEAD.size)[:, None] + (bit >> 3)[None, :]
        word = np.zeros(at.shape, dtype=np.uint64)
        for k in range((int(w) + 7 + 7) // 8):
            word |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
        out[rows] = ((word >> (bit & 7).astype(np.uint64)[None, :]) & np.uint64((1 << int(w)) - 1)).astype(np.uint32)
    for i, (_, w, n) in enumerate(heads):
        if n:
            p = int(starts[i]) + HEAD.size + (block * w + 7) // 8
            out[i][np.frombuffer(data, "<u2", n, p)] = np.frombuffer(data, "<u4", n, p + 2 * n)
    out += low[:, None]
    return out.reshape(-1)


class ShardWriter:
    """Writes a shard to a binary stream; memory is one chunk of ids and the index."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block = stream, block
        self.pending: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.starts: list[int] = []
        self.ids: list[int] = []
        self.nulls: list[int] = []
        self.before: list[int] = []
        self.at = stream.write(MAGIC + struct.pack("<I", block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.before.append(self.tokens)
        self.tokens += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= CHUNK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // self.block * self.block
        for b in encode_blocks(ids[:cut], self.block):
            self.starts.append(self.at)
            self.stream.write(b)
            self.at += len(b)
        self.pending, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        index = self.at
        for x, kind in ((self.starts, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), ([*self.before, self.tokens], "<u8")):
            self.stream.write(np.array(x, dtype=kind).tobytes())
        self.stream.write(FOOT.pack(len(self.starts), len(self.ids), self.tokens, index, MAGIC))


class ShardReader:
    """Random access to a shard: only the blocks that a range of tokens lies in are read."""

    def __init__(self, stream: io.RawIOBase, size: int):
        self.stream = stream
        self.block = struct.unpack("<4sI", self._at(0, 8))[1]
        n_blocks, n_docs, self.tokens, index, magic = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token shard, or a torn one")
        data = self._at(index, size - FOOT.size - index)
        self.starts = np.append(np.frombuffer(data, "<u8", n_blocks), index).astype(np.int64)
        ids = np.frombuffer(data, "<i8", n_docs, 8 * n_blocks)
        nulls = np.frombuffer(data, "u1", n_docs, 8 * (n_blocks + n_docs))
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        self.before = np.frombuffer(data, "<u8", n_docs + 1, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of tokens start to stop (exclusive)."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        lo = int(self.starts[a])
        data = self._at(lo, int(self.starts[b]) - lo)
        return decode_blocks(data, self.starts[a:b] - lo, self.block)[start - a * self.block : stop - a * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, tokens before it in the shard, tokens, crc32 of its ids), decoding at most about CHUNK ids at once."""
        n, first = len(self.doc_ids), 0
        while first < n:
            last = first + 1
            while last < n and self.before[last + 1] - self.before[first] <= CHUNK:
                last += 1
            if last == first + 1:  # perhaps one very long document
                a, b, crc = int(self.before[first]), int(self.before[last]), 0
                for x in range(a, b, CHUNK):
                    crc = zlib.crc32(self.read(x, min(b, x + CHUNK)).astype("<u4").tobytes(), crc)
                yield self.doc_ids[first], a, b - a, crc
            else:
                a = int(self.before[first])
                ids = self.read(a, int(self.before[last])).astype("<u4")
                for i in range(first, last):
                    x, y = int(self.before[i]), int(self.before[i + 1])
                    yield self.doc_ids[i], x, y - x, zlib.crc32(ids[x - a : y - a].tobytes())
            first = last


def write_shards(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes docs (doc_id, text) as shards into folder, a URI that driver and executors share; returns the manifest
    (shard, path, n_docs, n_tokens), committed as a table."""
    path_of = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        path, out, code = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.wgp", None, encoder(path_of)
        kind = np.dtype("<u2" if code.width == 2 else "<u4")
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), binary_texts(b.column(1)), strict=True):
                if out is None:
                    stream = fs.open_output_stream(path)
                    out = ShardWriter(stream)
                out.add(doc, np.frombuffer(code.pack(text, end_id), dtype=kind))
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(out.ids), "n_tokens": out.tokens}])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard: read back from the files alone."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):  # one short row for each shard file
        rows.append((r["shard"], r["path"], start))
        start += r["n_tokens"]
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
    names = [x.split()[0] for x in shape.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(r["path"]) as f:
                    reader, found = ShardReader(f, f.size()), []
                    for doc, at, n, crc in reader.documents():
                        found.append((doc, r["start"] + at, n, crc, r["shard"]))
                        if len(found) == 10_000:
                            yield _rows(found, names)
                            found = []
                    if found:
                        yield _rows(found, names)

    if not rows:
        return spark.createDataFrame([], shape)
    return spark.createDataFrame(rows, "shard long, path string, start long").mapInArrow(read, shape)


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def token_files(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes docs as token shards and returns what the files hold, a row for each document.

    Defined results: null and empty texts have the end id alone; a null doc_id comes first and stays null; repeated rows
    are written each; very long texts are split over blocks, not cut; an empty table writes no file and gives no row;
    other columns of docs are ignored.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, folder, tokenizer=tokenizer, end_id=end_id), folder)


def op5(spark, sf_dir: str) -> DataFrame:
    out = token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", F.col("shard"))
