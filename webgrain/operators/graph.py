"""The internal link graph: incoming links, click depth, orphans, canonicals, broken and blocked links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.functions.urls import host
from webgrain.sources.sinks import SOCIAL
from webgrain.staging import staged


def incoming_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(key, incoming): distinct (source, target URL) pairs whose target's key is a page. Two spellings of a target from
    one page count twice, and a page's links to itself count."""
    edges = links.select("source", "target", "target_key").distinct()
    counts = edges.join(
        pages.select(F.col("key").alias("target_key")).distinct(), "target_key", "left_semi"
    ).groupBy("target_key").agg(F.count("*").alias("n"))
    return pages.join(counts, F.col("key") == F.col("target_key"), "left").select("key", F.coalesce("n", F.lit(0)).alias("incoming"))


#: Levels after which the tables of seen pages are written as one.
LEVELS_A_TABLE = 8


def click_depths(pages: DataFrame, edges: DataFrame, start: DataFrame, *, max_levels: int | None = None) -> DataFrame:
    """(key, depth) for all pages, null where no path of links leads from a start page.

    Breadth-first: each level is a join of the frontier with the edges less what has been seen, as a durable table, so
    lineage doesn't grow. A page is on no level but its own, so a frontier needs comparing with pages seen only where edges
    lead back; the tables of levels are written as one every few levels. The loop ends with the first empty level; with
    max_levels given, pages beyond raise.
    """
    keys = pages.select("key").distinct()
    inner = edges.select("source", "target").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")
    real = staged(inner.where("source <> target").distinct(), "bfs-edges")
    most = real.count()  # no level has more pages than edges lead to
    level = staged(keys.join(start.select("key").distinct(), "key", "left_semi").withColumn("depth", F.lit(0)), "bfs-level")
    seen, n = level, 0
    while not level.isEmpty():
        n += 1
        if max_levels is not None and n > max_levels + 1:
            raise RuntimeError(f"pages lie deeper than {max_levels} levels")
        step = real.join(level.select(F.col("key").alias("source")), "source").select(F.col("target").alias("key")).distinct()
        level = staged(step.join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(n)), "bfs-level", rows=most)
        seen = seen.unionByName(level)
        if n % LEVELS_A_TABLE == 0:
            seen = staged(seen, "bfs-seen", rows=most)
    return keys.join(seen, "key", "left")


def orphans(pages: DataFrame, *, exhaustive: bool) -> DataFrame:
    """pages (key, incoming, is_start) with `orphan`, which only an exhaustive crawl can tell."""
    return pages.withColumn("orphan", F.lit(exhaustive) & ~F.col("is_start") & (F.col("incoming") == 0))


def canonical_problems(pages: DataFrame, dropped: DataFrame) -> DataFrame:
    """pages (key, canonical_key) with `chain` (the canonical's own canonical is another page) and `bad_status` (of a
    canonical outside the pages that isn't 200)."""
    target = pages.select(F.col("key").alias("t"), F.col("canonical_key").alias("next"))
    other = dropped.select(F.col("key").alias("d"), F.col("status").alias("s"))
    both = pages.join(target, F.col("canonical_key") == F.col("t"), "left").join(other, F.col("canonical_key") == F.col("d"), "left")
    chain = F.coalesce(F.col("next").isNotNull() & (F.col("next") != F.col("t")), F.lit(False))
    return both.select(*pages.columns, chain.alias("chain"), F.when(F.col("s") != 200, F.col("s")).alias("bad_status"))


def broken_links(links: DataFrame, failures: DataFrame) -> DataFrame:
    """A row for each occurrence of an internal link to a URL that failed (status 400 or more)."""
    bad = failures.where("status >= 400").select(F.col("url").alias("target"), "status")
    return links.where("internal").join(bad, "target").select("source", "text", "target", "status")


def redirect_sources(redirects: DataFrame, links: DataFrame) -> DataFrame:
    """Redirects (url) with the sorted distinct pages that link to them."""
    by = links.select("source", "target").distinct()
    return redirects.join(by, F.col("url") == F.col("target"), "left").groupBy("url").agg(
        F.array_sort(F.collect_set("source")).alias("sources")
    )


def external_targets(links: DataFrame) -> DataFrame:
    """External URLs with the number of linking pages and their least one."""
    return links.where("NOT internal").groupBy("target").agg(
        F.countDistinct("source").alias("pages"), F.min("source").alias("first_source")
    )


def external_sources(links: DataFrame) -> DataFrame:
    """External URLs with the sorted distinct pages that link to them."""
    return links.where("NOT internal").groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def link_inventory(links: DataFrame, *key: str) -> DataFrame:
    """links (source, text, target, ...) by internal or external, text and target: occurrences and pages. Links to share
    buttons and those that jump to the page's content don't count; key: the columns to group by, these by default."""
    shared = F.coalesce(host(F.col("target")).rlike(SOCIAL), F.lit(False))
    jump = F.col("text").rlike(r"(?i)^skip (to )?(main )?content$")
    rows = links.where(~shared & ~F.coalesce(jump, F.lit(False)))
    return rows.groupBy(*(key or ("internal", "text", "target"))).agg(
        F.count("*").alias("occurrences"), F.countDistinct("source").alias("pages")
    )


def blocked_targets(links: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row: distinct internal targets among blocked pages (key)."""
    hit = links.where("internal").select(F.col("target_key").alias("key")).join(blocked.select("key"), "key", "left_semi")
    return hit.agg(F.countDistinct("key").alias("blocked"))
