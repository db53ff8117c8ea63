"""Helpers shared by the training-data operators: words, hashing, staging in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.staging import fresh_path, shared_dir, staged  # noqa: F401  (used by the operators)

#: Characters between words: space and U+0009..U+000D.
WS_CLASS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


#: Bytes of an Arrow batch that goes to a Python worker, so that neither side holds many texts at a time.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bytes to an Arrow batch to BATCH_BYTES where they are more; rows to a batch say little of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def dealt(df: DataFrame) -> DataFrame:
    """A table as it is read or, if it has fewer splits than there are cores, dealt out over them: for work on each row
    that costs far more than moving it. df: a scan, so that looking at its splits runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def apart(docs: DataFrame, own: list[str], *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs as a struct `row` beside the columns needed, so that its other names can't clash with an operator's, and how to
    select them again: all columns but those named like own ones, in either case."""
    kept = [c for c in docs.columns if c.lower() not in own]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *needed)
    return packed, [F.col("row").getField(c).alias(c) for c in kept]


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a whole text, in order; null and blank texts have none."""
    return F.filter(F.split(text, WS_CLASS), lambda w: w != "")


def filesystem(uri: str):
    """pyarrow file system and path of a shared URI; works on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --- vectorised word hashing over an Arrow string column --------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What each byte counts for in a word's hash, as it is and with A-Z as a-z.
_VALUE, _VALUE_LOWER = np.arange(1, 257, dtype=np.uint64), _LOWER.astype(np.uint64) + np.uint64(1)
#: Bytes of a word that are hashed for all words at once, place by place.
EACH_BYTE = 24


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def coefficients(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers, the same everywhere."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_COEF = coefficients(4096, 7)


def utf8_column(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (relative, nulls as empty) of an Arrow string or large_string array."""
    import pyarrow as pa

    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def hashed_words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each row: offsets, byte start of each word)."""
    return sized_words(data, off, lower)[:3]


def sized_words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each row: offsets, byte start of each word, bytes of each word).

    The hash is multilinear in the bytes with a coefficient for each position, then mixed; equal words have equal
    hashes everywhere, and two words collide with a chance of about 2**-56.
    """
    global _COEF
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    first[edges] = inside[edges]  # a row's first byte starts a word even after the former row's last one
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), starts, starts
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    sizes = np.flatnonzero(last) + 1 - starts
    if (top := int(sizes.max())) > len(_COEF):
        _COEF = coefficients(1 << top.bit_length(), 7)
    value, total = _VALUE_LOWER if lower else _VALUE, np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(sizes, EACH_BYTE + 1).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(np.minimum(sizes, EACH_BYTE + 1), minlength=EACH_BYTE + 2))  # words of k bytes at most
    at, sums = starts[order], np.zeros(len(starts), np.uint64)
    for k in range(min(top, EACH_BYTE)):  # byte k of all words that have one; the shorter ones come first
        a = ends[k]
        sums[a:] += value[data[at[a:] + k]] * _COEF[k]
    if top > EACH_BYTE:  # the other bytes of the long words, one after another
        a = ends[EACH_BYTE]
        n = sizes[order[a:]] - EACH_BYTE
        begin = np.cumsum(n) - n
        pos = np.arange(begin[-1] + n[-1]) - np.repeat(begin, n) + EACH_BYTE
        sums[a:] += np.add.reduceat(value[data[np.repeat(at[a:], n) + pos]] * _COEF[pos], begin)
    total[order] = sums
    return mix64(total), np.searchsorted(starts, off), starts, sizes


def row_chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each at most (a longer row is a range of its own)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
