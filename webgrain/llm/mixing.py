"""Mixing sources to target weights: hash-seeded Poisson replication and a global shuffle.

Native: DataFrame functions only. Each source has a mean repetition rate (its target share of the rows over its real
share, times the size of the mixture over the size of the input); each document's count is the Poisson quantile of its own
uniform number, a hash of the seed and the document id, so that any executor that repeats the work gets the same copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import apart

#: Sources up to which the table of sources (one short row each) is broadcast; beyond, a salted shuffle join takes its place.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: With no weights given, a source's target share grows with this power of its row count.
TEMPERATURE = 0.5
SEED = "mix-1"
#: Hexadecimal digits of a hash that make a uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    hexed = F.substring(F.md5(F.concat_ws(":", *cols)), 1, DIGITS)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k from 0 to rate + 12 * sqrt(rate) + 30, beyond which a double is 1 but for rounding."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, size: float | None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, n, rate. Rates above 600 are split off as whole copies by `mixed`, as exp(-rate) must not underflow."""
    n = docs.groupBy(F.col("source").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = n.withColumn("w", F.pow(F.col("n"), F.lit(temperature)))
    else:
        if any(not (w >= 0 and math.isfinite(w)) for w in weights.values()):
            raise ValueError("weights are finite numbers of at least 0")
        if not weights:
            return n.withColumn("rate", F.lit(0.0))
        pairs = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
        raw = n.withColumn("w", F.coalesce(F.when(F.col("source").isNotNull(), F.try_element_at(pairs, F.col("source"))), F.lit(0.0)))
    whole = raw.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    target = F.lit(float(size)) if size is not None else F.col("all_n").cast("double")
    return raw.crossJoin(F.broadcast(whole)).select(
        "source", "n", F.coalesce(F.try_divide(F.col("w") * target, F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate")
    )  # whole: one row


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    size: float | None = None,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
) -> DataFrame:
    """docs (doc_id, source, ...), each row as often as its Poisson count, shuffled globally.

    Appends copy (0-based), n_copies, and shuffle_key (uniform in [0, 1)), by which and doc_id and copy the mixture is
    totally ordered; rows lie in partitions by a hash of the key and the row, sorted within, which is a uniform random order.
    size: expected number of rows of the mixture; the input's by default.
    Defined results: a null source is a source of its own (weight 0 where weights are given); a source that weights
    doesn't name gets none; null doc_ids share one uniform number; repeated rows get equal counts; an empty table gives
    an empty mixture; a column of docs named like an appended one (in either case) is replaced. Texts pass through untouched.
    """
    own = ["copy", "n_copies", "shuffle_key"]
    docs, columns = apart(docs, own, "doc_id", "source")
    rates = source_rates(docs.select("source"), weights, size, temperature)
    most = F.floor(F.col("rate") / 600)  # whole copies for huge rates, the rest from the Poisson law of what is left
    table = rates.select(
        F.col("source").alias("__source"),
        (most * 600).cast("long").alias("__whole"),
        poisson_cdf(F.col("rate") - most * 600).alias("__cdf")
    )
    few = table.limit(BROADCAST_SOURCES + 1).collect()  # bounded: short rows, at most BROADCAST_SOURCES + 1
    if len(few) <= BROADCAST_SOURCES:
        small = docs.sparkSession.createDataFrame([tuple(r) for r in few], table.schema)
        joined = docs.join(F.broadcast(small), docs["source"].eqNullSafe(small["__source"]))
    else:
        salted = table.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = marked.join(
            salted, marked["source"].eqNullSafe(salted["__source"]) & (marked["__salt"] == salted["__s"])
        ).drop("__salt", "__s")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = uniform(seed, named)
    n = F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))) + F.col("__whole")
    counted = joined.withColumn("__u", u).withColumn("n_copies", n.cast("long")).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", uniform(seed, F.lit("order"), named, F.col("copy").cast("string")))
    dealt = keyed.select(*columns, *own)
    told = [F.col(f"`{c}`") for c, kind in dealt.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = dealt.repartition("shuffle_key", F.xxhash64(*told))  # rows of one id, or of none, don't meet in one task
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op4(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same mixture in DuckDB. Powers, exponentials and products are the same double operations in the same order.
ORACLE_OP4 = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n, {TEMPERATURE}) AS w FROM n),
r AS (SELECT source, coalesce(w * (SELECT sum(n) FROM n)::DOUBLE / nullif((SELECT sum(w) FROM w) * n, 0), 0.0) AS rate FROM w),
t AS (SELECT source, rate - floor(rate / 600) * 600 AS rate, (floor(rate / 600) * 600)::BIGINT AS whole FROM r),
p AS (
  SELECT source, rate, whole, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM t
  UNION ALL
  SELECT source, rate, whole, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
l AS (SELECT source, whole, list(c ORDER BY k) AS cdf FROM p GROUP BY source, whole),
d AS (
  SELECT d.*, whole + len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, 'null'))), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}.0)) AS n_copies
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT *, unnest(range(n_copies::BIGINT)) AS copy FROM d)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, n_copies::BIGINT AS n_copies,
       ('0x' || substr(md5(concat('{SEED}:order:', coalesce(doc_id::VARCHAR, 'null'), ':', copy)), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}.0 AS shuffle_key
FROM e
"""
