"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Native: DataFrame functions only. Two passes over the texts; between them there is one row per hash bucket, whose number
is a parameter, so what is broadcast is bounded whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import WS_CHARS, apart, let, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Pieces of a text that n-grams are made of: runs of letters, digits or underscores, and runs of other visible characters.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"
BUCKETS = 1 << 15
ALPHA = 0.5
#: Trusted ids up to which they are broadcast (about 30 MB); beyond, texts are joined with them by shuffling.
BROADCAST_TRUSTED = 1_000_000
#: A document is kept when its mean log ratio per n-gram (nats) is at least this.
THRESHOLD = -0.1


def repeated_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            order,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(
                            F.get(s, k + 1)["h"] == x["h"], F.lit(False)
                        ),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, b: a + b
            )
        )

    def hashes(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(n >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def base_columns(text: Column) -> Column:
    """Struct of the counts that the rules use, from one tokenisation of the whole text."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.ltrim(s, F.lit(WS_CHARS)) != "")
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def buckets_of(text: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all unigrams and bigrams of lower-cased pieces, with repeats."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))
    return let(
        F.transform(pieces, lambda p: F.xxhash64(p)),
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
            F.transform(
                F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(h[i], x), F.lit(buckets)).cast("int")
            ),
        ),
    )


def bucket_ratios(docs: DataFrame, target: Column, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """One row: weights array<double>, the log ratio of the two smoothed multinomials for each bucket."""
    grams = docs.select(target.cast("long").alias("t"), F.explode(buckets_of(text_or_empty("text"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = every.join(F.broadcast(counts), "b", "left").select(
        "b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    total = filled.agg(
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
        F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("rows")
    )
    smooth = lambda c, n: (c + F.lit(alpha)) / (n + F.lit(alpha * buckets))
    return total.select(
        F.transform(
            "rows", lambda x: F.log(smooth(x["target"], F.col("n_target"))) - F.log(smooth(x["raw"], F.col("n_raw")))
        ).alias("weights")
    )


def quality_rules(
    docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, alpha: float = ALPHA, threshold: float = THRESHOLD
) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with the rule columns, `llr` and `kept` appended.

    trusted: one column doc_id, the trusted documents; repeated ids count once. The raw corpus is docs itself.
    Defined results: null or blank text has no words, no n-grams, llr 0 and fails the base rules; a null doc_id is never
    trusted; repeated rows are scored alike and both returned; an empty table gives an empty result; a column of docs
    named like an appended one (in either case) is replaced. With no trusted document the target is uniform over the buckets.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "n_grams"]
    docs, columns = apart(docs, own, "doc_id", "text")
    marks = trusted.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__t", F.lit(True))
    few = marks.count() <= BROADCAST_TRUSTED
    flagged = docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("__id"), "left")
    weights = bucket_ratios(flagged, F.coalesce("__t", F.lit(False)), buckets, alpha)
    text = text_or_empty("text")
    weighed = let(
        buckets_of(text, buckets),
        lambda b: F.struct(
            F.size(b).cast("long").alias("n"), F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(F.col("__w"), x)).alias("total")
        ),
    )

    def verdict(x: Column) -> Column:
        r, g = x["r"], x["g"]
        failed = (r["n_words"] < 20) | (100 * r["n_repeat_words"] > 30 * r["n_words"])
        llr = F.when(g["n"] > 0, g["total"] / g["n"]).otherwise(0.0)
        return F.struct(
            *[r[c].alias(c) for c in own[:5]],
            failed.alias("base_failed"),
            (~failed & (llr >= threshold)).alias("kept"),
            llr.alias("llr"),
            g["n"].alias("n_grams")
        )

    # One expression for all results: a filter on one of them, pushed below, then repeats nothing.
    found = let(F.struct(base_columns(text).alias("r"), weighed.alias("g")), verdict)
    judged = docs.withColumn("__w", weights.scalar()).withColumn("__q", found)  # weights: one row, bounded by the buckets
    return judged.select(*columns, "__q.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic; a document with any contrary label isn't trusted."""
    return labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok")).where("ok").select("doc_id")


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules(docs.select("doc_id", "text"), trusted_ids(labels))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "n_grams"
    )
