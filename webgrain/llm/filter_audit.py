"""Filter interaction audit: which filters do the work, in every order, from counts of joint failures.

Each document is read once, for a mask of the filters that it fails. The documents that fail all filters of a set, for each
of the sets, are sums of products of those flags: the joint failures. All else follows from these few numbers by
inclusion and exclusion, without applying any order of filters to documents: survivors of a prefix, what a filter alone
rejects, what an earlier one already took, and the Shapley value, which the dividends of the game "documents removed by
a set of filters" give, (-1)**(|S| + 1) times the joint failures of S, shared out evenly within S.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import WS_CLASS, dealt, staged, text_or_empty

# The filters' limits
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FILTERS = "ABCDE"
#: Labelled rows up to which labels are broadcast (about 20 bytes each); beyond, they are joined by shuffling.
BROADCAST_LABELS = 1_000_000


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails filter A (short), B (repetitive), C (capitals), D (symbols)."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just the filters of mask (bit i: filter i).

    Filter E, a text that equals one with a smaller id, needs no row of its own to be looked up again: equal texts share the
    other flags, so rows are counted by text, part and labels first, and of each text all but those of its least id fail.
    A text that a third of all rows share is then a few counts.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_or_empty("text").alias("text"),
    ).select("*", F.array_remove(F.split("text", WS_CLASS), "").alias("words"))
    flags = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    digest = F.unhex(F.sha2("text", 256))
    # rows without an id are spread by text: as a join key alone they would all meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    narrow = read.select("doc_id", "part", mask.cast("int").alias("mask"), digest.alias("digest"), spread.alias("spread"))

    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"
    )
    known = known.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    known = known.withColumn("spread", F.lit(0).cast("long"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    marked = narrow.join(known, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])

    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = marked.groupBy("doc_id", "spread", *kind).agg(F.count("*").alias("c"))  # repeated rows of one id and text
    texts = rows.groupBy(*kind).agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("c"))), F.lit(0)).alias("with_id"),
        F.min("doc_id").alias("least"),
        F.min_by("c", "doc_id").alias("of_least"),
    )
    texts = staged(texts, "audit-texts")  # read twice below: documents are read once
    # kinds of one text: as many as parts times labels, not as many as rows
    smallest = texts.groupBy("digest").agg(F.min("least").alias("first_id"), F.sum("with_id").alias("all"))
    smallest = smallest.where("all > 1").select("digest", "first_id")
    both = texts.join(smallest, "digest", "left")
    first = F.when(F.col("least") == F.col("first_id"), F.col("of_least")).otherwise(0)
    repeated = F.when(F.col("first_id").isNull(), F.lit(0)).otherwise(F.col("with_id") - first)
    cells = both.withColumn("copies", repeated).groupBy("part", "mask", "good", "toxic")
    cells = cells.agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    e = 1 << FILTERS.index("E")
    split = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
            F.struct((F.col("mask") + e).alias("mask"), F.col("copies").alias("n")),
        )
    ).alias("x")
    return cells.select("part", "good", "toxic", split).select("part", "x.mask", "good", "toxic", "x.n")


def joint_failures(failures: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, joint): for every set s of filters, how many documents fail all of them, and how many good and toxic ones.

    failures: (part, mask, good, toxic, n). A document counts for s if the product of its flags in s is 1. Nulls don't
    occur; an empty table gives no row; each part has an entry for each set, with zeros.
    """
    of = F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("s")
    sets = failures.select("part", "mask", "good", "toxic", "n", of)
    flag = [(F.shiftright("mask", i) % 2) for i in range(len(filters))]
    wanted = [(F.shiftright("s", i) % 2) == 1 for i in range(len(filters))]
    product = F.lit(1)
    for f, w in zip(flag, wanted, strict=True):
        product = product * F.when(w, f).otherwise(1)
    total = lambda weight: F.sum(product * F.col("n") * weight).cast("long")
    counts = sets.groupBy("part", "s").agg(
        total(F.lit(1)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic")
    )
    return counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("joint"))


def _signed(joint: Column, chosen, value) -> Column:
    """Sum of (-1)**|s| * value(entry) over the entries of joint with chosen(s)."""
    sign = lambda s: 1 - 2 * (F.bit_count(s) % 2)
    picked = F.filter(joint, lambda x: chosen(x["s"]))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda sum_, x: sum_ + sign(x["s"]).cast("long") * value(x))


def attribution(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the joint failures alone (for at most 6 filters)."""
    if len(filters) > 6:
        raise ValueError("orders are enumerated: at most 6 filters")
    orders = ",".join("".join(p) for p in permutations(filters))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bits = lambda upto: sum(
        (F.when(F.instr("filter_order", f) <= upto, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)), F.lit(0)
    )
    steps = joint.select("part", "joint", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    steps = steps.select("*", bits(F.col("step") - 1).alias("before"), bits(F.col("step")).alias("after"))
    steps = steps.withColumn("own", F.col("after") - F.col("before"))
    within = lambda mask: lambda s: s.bitwiseAND(F.col(mask)) == s
    left = lambda mask, field: _signed(F.col("joint"), within(mask), lambda x: x[field])
    has_own = lambda s: s.bitwiseAND(F.col("own")) != 0
    alone = -_signed(F.col("joint"), has_own, lambda x: x["n"])
    orders_of = factorial(len(filters))
    dividends = -_signed(F.col("joint"), has_own, lambda x: (F.lit(orders_of) / F.bit_count(x["s"])).cast("long") * x["n"])
    failing = F.aggregate(
        F.filter("joint", lambda x: x["s"] == F.col("own")), F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"]
    )
    counted = steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), letter.alias("filter"), left("after", "n").alias("kept"),
        (left("before", "n") - left("after", "n")).alias("removed"), failing.alias("failing"), alone.alias("unique_fails"),
        (left("before", "good") - left("after", "good")).alias("good_lost"),
        (left("before", "toxic") - left("after", "toxic")).alias("toxic_lost"), dividends.alias("shapley"),
    )
    return counted.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley", "filter",
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over docs (doc_id, text, source) with labels (doc_id, quality, toxic), for each source.

    Defined results: a null text is empty, and so fails A alone, or also E; a null source is the part ''; a null id is
    neither smaller nor greater than another, so its row never fails E nor makes another fail it; rows of equal id and text
    count each and don't fail E by each other; labels that repeat or contradict each other count as good if any says so, and
    as toxic likewise, and those of unknown or null ids count nowhere; very long texts are read whole; an empty table gives
    no rows; other columns are ignored.
    """
    return attribution(joint_failures(document_failures(docs, labels)))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return filter_audit(dealt(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("filter")


ORACLE_OP12 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS m
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)),
o AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31),
k AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
a AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(CASE WHEN m & before = 0 AND m & own = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & before = 0 AND m & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & before <> 0 AND m & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a
"""
