"""Near-duplicates: MinHash bands, sequential Bayesian verification of signatures, exact verification of survivors.

Documents with equal shingle sets are one class from the start, so copies never meet in pairs. Within each band bucket
every class is first compared with the bucket's least class; then, with the components found so far, only pairs that still
lie in different components are compared. That loses no component and keeps large groups linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import bounded_batches, coefficients, hashed_words, mix64, row_chunks, staged, utf8_column
from webgrain.operators.components import connected_components

SHINGLE = 5
#: Similarity in hundredths from which documents are linked.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature positions that are compared at a time, and the chance of missing a link that pruning may add at each step.
BATCH, MISS = 32, 1e-6
#: Classes that hold a shingle up to which it is rare.
RARE = 8
#: Classes up to which their row keys are broadcast to fetch their texts; beyond, they are joined by shuffling.
BROADCAST_CLASSES = 300_000

_A, _B = coefficients(HASHES, 11), coefficients(HASHES, 13)
_C = coefficients(SHINGLE + 1, 17)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its k-word shingles; with fewer words, of the whole sequence."""
    words, first, _ = hashed_words(data, off)
    n = len(words)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            acc += words[i : n - k + 1 + i] * _C[i]
        acc = mix64(acc)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(acc[a : b - k + 1])
        elif b > a:
            parts = np.append(words[a:b] * _C[: b - a], _C[k : k + 1] * np.uint64(b - a))
            yield mix64(parts.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set, as uint32."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that identify a set."""
    a = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix64(s * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def least_matches(batch: int = BATCH, hashes: int = HASHES, percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For n compared positions, the fewest matches with which a pair stays: with a uniform prior the posterior is
    Beta(m + 1, n - m + 1), and its mass from the threshold up is the chance that n + 1 trials have at most m hits."""
    t, out = percent / 100, {}
    for n in range(batch, hashes + 1, batch):
        mass = 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                out[n] = m
                break
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose last column is the text, with each row's shingle set."""
    for b in batches:
        data, off = utf8_column(b.column(b.num_columns - 1))
        for lo, hi in row_chunks(off):
            yield b.slice(lo, hi - lo), list(shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id, text_hash, stays.

    class_id numbers documents with equal shingle sets (null without words). stays marks one (doc_id, text) of each
    component, the least by id and text hash, null ids last, and every text without words; links between classes of different sets are
    found whole but for the chance that banding or pruning misses one (about 1e-5 at the threshold itself).
    Defined results: null, empty and blank texts have n_shingles 0, are their own component and kept; repeated rows are
    linked with each other, and each is kept if its id is the component's; a null doc_id never names a component unless
    all its documents have none, and a row is kept if its id equals the component's, null included; an empty table gives
    an empty result; other columns are ignored.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, shingle):
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                    pa.array([signature(s).tobytes() if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                ],
                names=["doc_id", "h", "n_shingles", "key", "sig"],
            )

    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    described = staged(source.mapInArrow(describe, "doc_id long, h long, n_shingles long, key binary, sig binary"), "minhash-rows")
    # the class of a set, and the row whose text stands for it
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    grouped = described.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("low"), F.min(order).alias("r"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig")
    )
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
            keys = mix64((sig * _C[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C[SHINGLE]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1)),
                    pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)),
                    pa.array(np.repeat(b.column(1).to_numpy(zero_copy_only=False), BANDS))
                ],
                names=["bucket", "node", "n"]
            )

    bands = classes.select("node", "n", "sig").mapInArrow(band, "bucket long, node long, n long")
    # a bucket's least class comes with its size, so that nothing has to be dealt out by that class, which may be that of many
    ends = bands.groupBy("bucket").agg(F.min("node").alias("least"), F.min_by("n", "node").alias("na"), F.max("node").alias("most"))
    shared = ends.where("least < most").drop("most")
    members = staged(bands.join(shared, "bucket"), "minhash-members")

    involved = members.select("node").distinct()
    reps = classes.join(involved, "node", "left_semi").select("node", F.col("r.doc_id").alias("d"), F.col("r.h").alias("rh"))
    few = involved.count() <= BROADCAST_CLASSES

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    texts = source.join(
        F.broadcast(reps) if few else reps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("rh"))
    ).select("node", "text")
    sets = staged(texts.mapInArrow(to_sets, "node long, hashes binary").dropDuplicates(["node"]), "minhash-sets")
    sigs = classes.select("node", "sig")
    floor = least_matches(percent=percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.arange(b.num_rows)
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, HASHES) for i in (2, 3))
            hits = np.zeros(b.num_rows, np.int64)
            for n in range(BATCH, HASHES + 1, BATCH):
                hits[left] += (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(axis=1)
                left = left[hits[left] >= floor[n]]
            at = pa.array(left)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        signed = pairs.join(
            sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a"
        ).join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        likely = signed.select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long")
        held = likely.join(
            sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a"
        ).join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        return staged(held.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), f"minhash-links-{name}")

    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    stars = members.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    star = stars.where(sized).select("a", "b").distinct()
    star_links = links(star, "star")
    edges = star_links

    # Pairs that lie in different components yet. A shingle that no other such class has is in no intersection, so of n
    # shingles the u that others share bound every overlap: |a & b| <= min(ua, ub). Copies with edits of their own,
    # whose pairs would be many, fall out here one by one; the best shared class of each bucket gathers the rest.
    def still_open(rows: DataFrame, name: str) -> DataFrame:
        """rows (bucket, node, n, ...) of buckets whose members lie in several components, with their component c."""
        found = connected_components(edges)
        labelled = rows.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        several = labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("bucket")
        return staged(labelled.join(several, "bucket", "left_semi"), f"minhash-{name}")

    def explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cut = b.slice(lo, 256)
                parts = [np.frombuffer(x, np.int64) for x in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(cut.column(0).to_numpy(zero_copy_only=False), [len(x) for x in parts])),
                        pa.array(np.concatenate(parts))
                    ],
                    names=["node", "x"]
                )

    rest = still_open(members.drop("na"), "open")
    holders = staged(
        sets.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(explode_sets, "node long, x long"), "minhash-holders"
    )
    held_twice = holders.groupBy("x").agg(F.count("*").alias("df")).where("df > 1").select("x")
    shared_by = holders.join(held_twice, "x", "left_semi").groupBy("node").agg(F.count("*").alias("u"))
    rest = staged(rest.join(shared_by, "node").where(f"100 * u >= {percent} * n"), "minhash-shared")
    bound = f"{100 + percent} * least(ua, ub) >= {percent} * (na + nb)"
    pivots = rest.groupBy("bucket").agg(F.max(F.struct((F.col("u") / F.col("n")).alias("q"), "node", "n", "u", "c")).alias("p"))
    around = rest.join(pivots, "bucket").where("c <> p.c").select(
        F.least("node", "p.node").alias("a"),
        F.greatest("node", "p.node").alias("b"),
        F.col("n").alias("na"),
        F.col("p.n").alias("nb"),
        F.col("u").alias("ua"),
        F.col("p.u").alias("ub")
    )
    edges = edges.unionByName(links(around.where(sized).where(bound).select("a", "b").distinct(), "around"))
    # The last pairs. A pair that shares a rare shingle is found by it; one that shares none overlaps in common shingles
    # alone, so at most in the fewer of the two. Of the buckets that two classes share, the least one names the pair.
    rest = still_open(rest.drop("c", "u"), "open-again")
    own = rest.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("c").alias("c"), F.collect_set("bucket").alias("buckets"))
    held = holders.join(own.select("node"), "node", "left_semi")
    df = held.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    counted = staged(held.join(df, "x").select("node", "x", "df"), "minhash-counted")
    common = counted.where(F.col("df") > RARE).groupBy("node").agg(F.count("*").alias("k"))
    own = staged(own.join(common, "node", "left").withColumn("k", F.coalesce("k", F.lit(0))), "minhash-own")
    side = lambda x: own.select(
        F.col("node").alias(x),
        F.col("n").alias(f"n{x}"),
        F.col("c").alias(f"c{x}"),
        F.col("k").alias(f"k{x}"),
        F.col("buckets").alias(f"s{x}")
    )
    a, b = side("a"), side("b")
    enough = f"{100 + percent} * least(ka, kb) >= {percent} * (na + nb)"
    able = f"100 * k{{0}} >= {percent} * n{{0}}"  # what `enough` asks of either side alone
    l, r = (x.where(able.format(n)).withColumn("bucket", F.explode(f"s{n}")) for x, n in ((a, "a"), (b, "b")))
    first = F.array_min(F.array_intersect("sa", "sb")) == l["bucket"]
    by_bucket = l.join(
        r, (l["bucket"] == r["bucket"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & F.expr(sized) & F.expr(enough) & first
    ).select("a", "b")
    rare = counted.where(F.col("df") <= RARE)
    by_rare = rare.select("x", F.col("node").alias("a")).join(
        rare.select("x", F.col("node").alias("b")), "x"
    ).where("a < b").select("a", "b").distinct()
    by_rare = by_rare.join(a.drop("sa"), "a").join(b.drop("sb"), "b").where("ca <> cb").where(sized).select("a", "b")
    cross = by_bucket.unionByName(by_rare).distinct()
    component = connected_components(edges.unionByName(links(cross, "cross")))

    labels = classes.select("node", "key", "low", "r").join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    named = labels.groupBy("component").agg(F.min("low").alias("component_id"), F.min("r").alias("first"))
    per_class = labels.drop("r").join(named, "component").select("key", F.col("node").alias("class_id"), "component_id", "first")
    out = described.select("doc_id", "h", "n_shingles", "key").join(per_class, "key", "left")
    worded = F.col("n_shingles") > 0
    cid = F.when(worded, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        cid.alias("component_id"),
        F.col("doc_id").eqNullSafe(cid).alias("kept"),
        "class_id",
        F.col("h").alias("text_hash"),
        (~worded | (order == F.col("first"))).alias("stays"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s),
c AS (SELECT s, n, min(doc_id) AS c FROM n WHERE n > 0 GROUP BY s, n),
u AS (SELECT c, n, unnest(s) AS x FROM c),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.c, b.c),
e AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT c AS x, c AS y FROM c UNION SELECT r.x, d.b FROM r JOIN d ON r.y = d.a),
m AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, CASE WHEN n.n > 0 THEN m.m ELSE n.doc_id END AS component_id,
       n.doc_id = (CASE WHEN n.n > 0 THEN m.m ELSE n.doc_id END) AS kept
FROM n LEFT JOIN c ON n.s = c.s LEFT JOIN m ON m.x = c.c
"""
