"""Packing documents into training sequences by minimum bin slack.

A document's ids are cut into whole windows of the capacity and a remainder. Remainders are packed by a plan over their
length histogram alone (at most capacity - 1 rows, whatever the corpus): a bitset subset-sum dynamic program finds the
multiset of lengths that fills a window closest to capacity, counts are backtracked, and the pattern is repeated as often
as its lengths last. Where slack stays, a longer remainder is cut to fill it and its rest goes back into the histogram; the
last window's rest is cut at powers of two, which need no padding. The plan assigns (length, rank) intervals to windows;
ranks are counted in each input task and shifted by window sums over tasks, so no task ever holds all rows of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import bounded_batches, staged
from webgrain.llm.tokens import binary_texts, default_path, encoder

CAPACITY = 4096
END_ID = 2
#: Cut remainders up to which their keys are broadcast to fetch their ids; beyond, they are joined by shuffling.
BROADCAST_CUTS = 100_000
RANK_BITS = 44


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the multiset of lengths (in descending order, each available counts[l] times) whose sum is closest to
    capacity from below. A bitset holds the reachable sums; one state is kept for each binary-split item."""
    bits, goal, states = 1, 1 << capacity, []
    mask = (goal << 1) - 1
    for l in lengths:
        if l > capacity:
            continue
        left, step = min(counts[l], capacity // l), 1
        while left > 0:
            k = min(step, left)
            states.append((l, k, bits))
            bits = (bits | bits << (k * l)) & mask
            left -= k
            step *= 2
        if bits & goal:
            break
    at, found = bits.bit_length() - 1, {}
    for l, k, before in reversed(states):
        if not before >> at & 1:
            at -= k * l
            found[l] = found.get(l, 0) + k
    return found


class Plan:
    """Intervals of ranks for each length: where they are placed, or where they are cut.

    Rows: (length, first rank, ranks, cut, window, per window, offset, next rank). With cut 0 a rank is placed whole:
    window + d // per at offset + (d % per) * length, d its distance from the first rank. With cut s > 0 its first s ids
    go to window + d at offset, and the rest is rank next + d of length - s.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.rows, self.windows = capacity, [], 0
        self.sizes: list[tuple[int, int]] = []  # (windows, filled length) in order
        left = {l: n for l, n in histogram.items() if n > 0}
        self.used, self.known = dict.fromkeys(left, 0), dict(left)
        while left:
            self._pattern(left)

    def _take(self, left: dict[int, int], l: int, n: int) -> int:
        """First of n ranks of length l, which are used up."""
        at = self.used[l]
        self.used[l] = at + n
        left[l] -= n
        if not left[l]:
            del left[l]
        return at

    def _put(self, left: dict[int, int], l: int, n: int) -> int:
        """First of n new ranks of length l, after all that the length has had."""
        at = self.known.get(l, 0)
        self.known[l] = at + n
        self.used.setdefault(l, 0)
        left[l] = left.get(l, 0) + n
        return at

    def _pattern(self, left: dict[int, int]) -> None:
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        if sum(l * n for l, n in left.items()) < self.capacity:
            return self._tail(left)
        left[top] -= 1
        chosen = fill(lengths, left, self.capacity - top)
        left[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        slack = self.capacity - sum(l * n for l, n in chosen.items())
        times = min(left[l] // n for l, n in chosen.items())
        offset = 0
        if slack:  # whatever is left over is longer than the slack, or it would have been chosen
            spare = next(l for l in lengths if left[l] > chosen.get(l, 0))
            times = min(times, max(1, left[spare] // (chosen.get(spare, 0) + 1)))
        for l in sorted(chosen, reverse=True):
            at = self._take(left, l, chosen[l] * times)
            self.rows.append((l, at, chosen[l] * times, 0, self.windows, chosen[l], offset, 0))
            offset += chosen[l] * l
        if slack:
            at = self._take(left, spare, times)
            after = self._put(left, spare - slack, times)
            self.rows.append((spare, at, times, slack, self.windows, 1, offset, after))
        self.sizes.append((times, self.capacity))
        self.windows += times

    def _tail(self, left: dict[int, int]) -> None:
        """Fewer ids than one window: sequences of powers of two in length, pieces cut where one is full."""
        total = sum(l * n for l, n in left.items())
        rooms = [1 << i for i in range(total.bit_length() - 1, -1, -1) if total >> i & 1]
        filled = 0
        while left:
            l = max(left)
            at = self._take(left, l, 1)
            if (s := rooms[0] - filled) >= l:
                self.rows.append((l, at, 1, 0, self.windows, 1, filled, 0))
                filled += l
            else:
                self.rows.append((l, at, 1, s, self.windows, 1, filled, self._put(left, l - s, 1)))
                filled = rooms[0]
            if filled == rooms[0]:
                self.sizes.append((1, filled))
                self.windows, filled = self.windows + 1, 0
                rooms.pop(0)

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 8)
        names = ("length", "first", "ranks", "cut", "window", "per", "offset", "next")
        out = {n: rows[:, i] for i, n in enumerate(names)}
        out["key"] = (out["length"] << RANK_BITS) | out["first"]
        return out


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray, start: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Pieces of remainders: row (index of the remainder), start, length, window, offset, cut; a batch for each depth of cuts."""
    row, was_cut = np.arange(len(length)), np.zeros(len(length), bool)
    while len(row):
        i = np.searchsorted(plan["key"], (length << RANK_BITS) | rank, side="right") - 1
        d, cut = rank - plan["first"][i], plan["cut"][i]
        per, whole = plan["per"][i], cut == 0
        yield {
            "row": row,
            "start": start,
            "length": np.where(whole, length, cut),
            "window": plan["window"][i] + d // per,
            "offset": plan["offset"][i] + (d % per) * np.where(whole, length, 0),
            "cut": was_cut | ~whole,
        }
        rest = ~whole
        row, start, rank, length = row[rest], (start + cut)[rest], (plan["next"][i] + d)[rest], (length - cut)[rest]
        was_cut = np.ones(len(row), bool)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Staged rows of docs with their ids and what packing needs: part and ord (the input task and the row in it), the ids'
    width, crc32 of each whole window, and the remainder's length, crc32 and rank among the task's equal lengths."""
    shape = "part long, ord long, doc_id long, doc_tokens long, windows_before long, crcs array<long>, rest long, rest_crc long, rest_rank long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if code.width == 2 else "<u4")
        ranks, windows, ordinal = np.zeros(capacity, np.int64), 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                cut, rows = b.slice(lo, 1000), []
                for doc, text in zip(cut.column(0).to_pylist(), binary_texts(cut.column(1)), strict=True):
                    ids = code.pack(text, end_id)
                    wide = np.frombuffer(ids, dtype=kind).astype("<u4")
                    n, rest = len(wide) // capacity, len(wide) % capacity
                    crcs = [zlib.crc32(wide[i * capacity : (i + 1) * capacity].tobytes()) for i in range(n)]
                    rows.append(
                        (
                            part,
                            ordinal,
                            doc,
                            len(wide),
                            windows,
                            crcs,
                            rest,
                            zlib.crc32(wide[n * capacity :].tobytes()),
                            int(ranks[rest]),
                            ids
                        )
                    )
                    windows, ordinal = windows + n, ordinal + 1
                    ranks[rest] += 1
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] + [pa.int64()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=[x.split()[0] for x in shape.split(", ")]
                    )

    return staged(docs.select("doc_id", "text").mapInArrow(encode, shape), "packing-tokens")


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row of docs lies in exactly one piece; pieces of a sequence lie gapless from offset 0. All sequences
    have the capacity in ids but the last few, whose lengths are falling powers of two.
    Defined results: null and empty texts are the end id alone; null doc_ids pass through; repeated rows are packed each
    (their pieces may be told apart by sequence and offset only); very long texts fill windows of their own; an empty
    table gives no piece; other columns of docs are ignored.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    table = token_table(docs, tokenizer or default_path(), end_id, capacity)
    parts = table.groupBy("part").agg((F.max_by("windows_before", "ord") + F.max_by(F.size("crcs"), "ord")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(F.col("part").alias("p"), before.alias("shift"))  # a row for each input task
    full = (
        table.where(F.size("crcs") > 0)
        .select("part", "doc_id", "doc_tokens", "windows_before", F.posexplode("crcs").alias("i", "ids_crc32"))
        .join(shifts, F.col("part") == F.col("p"))
        .select(
            "doc_id",
            (F.col("i") * capacity).cast("long").alias("start"),
            F.lit(capacity).cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("shift") + F.col("windows_before") + F.col("i")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    n_full = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]

    rests = table.where("rest > 0").select("part", "ord", "doc_id", "doc_tokens", "rest", "rest_crc", "rest_rank")
    counts = rests.groupBy("part", "rest").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("p"), F.col("rest").alias("r"), earlier.alias("rank_shift"))
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # under capacity rows
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity).arrays())  # bounded: lengths and patterns under the capacity

    shape = "part long, ord long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            num = {n: col[n].to_numpy(zero_copy_only=False) for n in ("rest", "rank", "doc_tokens")}
            for x in place(p, num["rest"], num["rank"], num["doc_tokens"] - num["rest"]):
                at = pa.array(x["row"])
                crc = pa.array(col["rest_crc"].take(at).to_numpy(zero_copy_only=False), pa.int64(), mask=x["cut"])
                arrays = [
                    col["part"].take(at),
                    col["ord"].take(at),
                    col["doc_id"].take(at),
                    pa.array(x["start"]),
                    pa.array(x["length"]),
                    crc,
                    col["doc_tokens"].take(at),
                    pa.array(x["window"] + n_full),
                    pa.array(x["offset"])
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[y.split()[0] for y in shape.split(", ")])

    ranked = rests.join(
        offsets, (F.col("part") == F.col("p")) & (F.col("rest") == F.col("r"))
    ).withColumn("rank", F.col("rest_rank") + F.col("rank_shift")).drop("p", "r", "rest_rank", "rank_shift")
    pieces = staged(ranked.mapInArrow(assign, shape), "packing-pieces")

    cuts = pieces.where("ids_crc32 IS NULL").select(
        F.col("part").alias("p"), F.col("ord").alias("o"), "start", "length", "sequence_id", "offset"
    )
    few = cuts.count() <= BROADCAST_CUTS
    fetched = table.select("part", "ord", "doc_id", "doc_tokens", "ids").join(
        F.broadcast(cuts) if few else cuts, (F.col("part") == F.col("p")) & (F.col("ord") == F.col("o"))
    )
    fetched = fetched.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    final = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for r in b.select(["start", "length", "doc_tokens", "ids"]).to_pylist():
                width = len(r["ids"]) // r["doc_tokens"]
                ids = np.frombuffer(r["ids"], dtype="<u2" if width == 2 else "<u4", count=r["length"], offset=r["start"] * width)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)} | {"ids_crc32": pa.array(crcs, pa.int64())}
            names = [y.split()[0] for y in final.split(", ")]
            yield pa.RecordBatch.from_arrays([col[n] for n in names], names=names)

    whole = pieces.where("ids_crc32 IS NOT NULL").select(*full.columns)
    return full.unionByName(whole).unionByName(fetched.mapInArrow(digest, final))


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
