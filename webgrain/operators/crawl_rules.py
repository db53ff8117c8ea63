"""Which fetched or found URLs an audit leaves out, and why: one ordered rule list as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.functions import urls as ur

HTML = r"(?i)text/html|application/xhtml\+xml"


def bucket_ceiling(urls: DataFrame, ordinal: str, most: int, *, bucket: str = "bucket") -> DataFrame:
    """urls with `over`: whether a row comes after the first `most` of its bucket, by `ordinal`.

    Only each bucket's first rows are ranked (a group limit before and after the shuffle); the last of them is its cutoff,
    a row to a bucket, so that one bucket with most of the rows is no burden on a task.
    """
    first = F.row_number().over(Window.partitionBy("full_bucket").orderBy("o"))
    ranked = urls.select(
        F.col(bucket).alias("full_bucket"), F.col(ordinal).alias("o")
    ).withColumn("place", first).where(F.col("place") <= most)
    cutoffs = ranked.groupBy("full_bucket").agg(F.max("o").alias("cutoff"), F.count("*").alias("held"))
    full = cutoffs.where(F.col("held") == most).drop("held")
    marked = urls.join(full, F.col(bucket).eqNullSafe(F.col("full_bucket")), "left")
    return marked.withColumn("over", F.coalesce(F.col(ordinal) > F.col("cutoff"), F.lit(False))).drop("full_bucket", "cutoff")


#: Parts in which the rows of one bucket are ranked before its first rows are put together.
RANK_SALTS = 32


def level_ceiling(level: DataFrame, counted: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """The level's rows (url, bucket) with `over`, and the counts (bucket, held) with these rows: how many rows of each
    bucket have come so far, `most` at most. counted: the counts before this level.

    Earlier levels are in the counts alone, so no earlier row is ranked again. Only buckets that this level fills are ranked,
    each in parts first, so that no task sorts a bucket with most of the rows.
    """
    added = level.groupBy("bucket").agg(F.count("*").alias("n"))
    before = added.withColumn("held", F.lit(0).cast("long")) if counted is None else added.join(
        counted.select(F.col("bucket").alias("b"), "held"), F.col("bucket").eqNullSafe(F.col("b")), "left"
    ).drop("b").fillna(0, ["held"])
    filled = before.where(F.col("held") + F.col("n") > most).select(F.col("bucket").alias("b"), (most - F.col("held")).alias("room"))
    same = F.col("bucket").eqNullSafe(F.col("b"))
    rows = level.join(filled, same).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(RANK_SALTS)))
    of_part, of_bucket = Window.partitionBy("b", "salt").orderBy("url"), Window.partitionBy("b").orderBy("url")
    first = rows.withColumn("place", F.row_number().over(of_part)).where("place <= room")
    cutoff = first.withColumn("place", F.row_number().over(of_bucket)).where("place = room").select("b", F.col("url").alias("cutoff"))
    full = filled.select(F.col("b").alias("full_bucket")).join(cutoff, F.col("full_bucket").eqNullSafe(F.col("b")), "left").drop("b")
    marked = level.join(full.withColumn("is_full", F.lit(True)), F.col("bucket").eqNullSafe(F.col("full_bucket")), "left")
    over = F.col("is_full") & (F.col("cutoff").isNull() | (F.col("url") > F.col("cutoff")))
    held = F.least(F.sum("held"), F.lit(most)).cast("long").alias("held")
    both = added.select("bucket", F.col("n").alias("held"))
    both = both if counted is None else both.unionByName(counted)
    return marked.withColumn("over", F.coalesce(over, F.lit(False))).drop("is_full", "full_bucket", "cutoff"), both.groupBy("bucket").agg(held)


def before_fetching(config: AuditConfig, url: Column) -> Column:
    """Reason to leave a URL out that its spelling gives, in the order configured, archive, too_deep; else null."""
    deep = ur.depth(url) > config.max_depth if config.max_depth is not None else F.lit(False)
    archive = ur.is_archive(url) if config.exclude_archives else F.lit(False)
    return F.when(ur.excluded(url, list(config.exclude_paths)), "configured").when(archive, "archive").when(deep, "too_deep")


def after_fetching(start_url: str) -> Column:
    """Reason that a fetched row (final_url, content_type, error) gives; else null."""
    inside = ur.same_host(F.col("final_url"), F.lit(start_url))
    html = F.coalesce(F.col("content_type"), F.lit("")).rlike(HTML)
    return F.when(F.col("error").isNotNull(), "fetch_error").when(~inside, "off_domain").when(~html, "not_html")


def unindexable(status: Column, robots: Column) -> Column:
    """Reason that keeps an extracted page out of the report: noindex, or a status outside 200 to 299; else null."""
    return F.when(F.array_contains(robots, "noindex"), "noindex").when(~status.between(200, 299), "http_status")


def with_reasons(log: DataFrame, config: AuditConfig) -> DataFrame:
    """log (ordinal, url, final_url, status, content_type, chain, error, allowed) with `reason`, null for pages to analyse.

    Rules hold in the order configured, archive, too_deep, bucket_full, robots, fetch_error, off_domain, not_html. Rows that
    lead into another host's sign-in or payment flow are left out, without a reason. `allowed` is what robots rules say.
    """
    early = log.withColumn("reason", before_fetching(config, F.col("url"))).withColumn("bucket", ur.bucket(F.col("url")))
    open_ = bucket_ceiling(early.where("reason IS NULL"), "ordinal", config.max_urls_per_path)
    late = F.when(F.col("over"), "bucket_full").when(~F.col("allowed"), "robots").otherwise(after_fetching(config.start_url))
    judged = open_.withColumn("reason", late).drop("over")
    gated = F.coalesce(ur.gated_flow(F.col("url"), F.col("final_url"), F.col("chain")), F.lit(False)) & (F.size("chain") > 0)
    fetched = ~F.coalesce(F.col("reason").isin("bucket_full", "robots"), F.lit(False))
    return early.where("reason IS NOT NULL").unionByName(judged.where(~(gated & fetched))).drop("bucket")


def redirects(log: DataFrame) -> DataFrame:
    """(url, final_url, status, chain, classification) of redirects that do more than add or drop a slash."""
    url, final, chain = F.col("url"), F.col("final_url"), F.col("chain")
    told = log.where((F.size("chain") > 0) & F.col("error").isNull())
    told = told.where(~F.coalesce(ur.gated_flow(url, final, chain) | ur.slash_redirect(url, final), F.lit(False)))
    return told.select("url", "final_url", "status", "chain", ur.redirect_class(url, final, chain).alias("classification"))
