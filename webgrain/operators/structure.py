"""Findings that need the whole site, and the figures of its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.operators.enrich import percent

DEEP_CLICKS = 3
STALE_DAYS = 730
# Types of structured data that say nothing about a page of its own, and page types that need none.
PLAIN_TYPES = ("Organization", "WebSite", "BreadcrumbList", "SiteNavigationElement", "ImageObject")
NO_SCHEMA_PAGES = ("feed", "search_archive")


def _finding(rows: DataFrame, rule: str, severity: str, message: Column, evidence: Column) -> DataFrame:
    head = [F.lit("seo").alias("category"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule")]
    return rows.select("page", *head, message.cast("string").alias("message"), evidence.cast("string").alias("evidence"))


def site_findings(pages: DataFrame, components: DataFrame) -> DataFrame:
    """(page, category, severity, rule, message, evidence) of the rules that need more than one page.

    pages: page, url, depth, orphan, canonical_key, target_canonical (the canonical's own, where it is a page), chain,
    bad_status, render_error; components: (page, component) of near-duplicates. Rules: javascript_render_failed,
    orphan_page, deep_click_depth, canonical_chain, canonical_non_200, near_duplicate_content.
    """
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else F.coalesce(y.cast("string"), F.lit("")) for y in x])
    rendered = _finding(
        pages.where("render_error IS NOT NULL"), "javascript_render_failed", "warning",
        text("Scripts couldn't be run; the raw page was read. ", F.col("render_error")), F.lit(None),
    )
    lonely = _finding(
        pages.where("orphan"), "orphan_page", "warning",
        F.lit("No page that was found links to this one."), F.lit("Known from outside the link graph of a full crawl."),
    )
    deep = _finding(
        pages.where(F.col("depth") > DEEP_CLICKS), "deep_click_depth", "info",
        text("The page is ", F.col("depth"), " clicks away from the start."), F.lit("Shortest way by internal links."),
    )
    chained = _finding(
        pages.where("chain"), "canonical_chain", "warning",
        F.lit("The canonical page names another canonical page."), F.concat_ws(" > ", "url", "canonical_key", "target_canonical"),
    )
    dead = _finding(
        pages.where("bad_status IS NOT NULL"), "canonical_non_200", "critical",
        text("The canonical page answers with status ", F.col("bad_status")), F.col("canonical_key"),
    )
    sizes = components.groupBy("component").agg(F.count("*").alias("size"), F.min("page").alias("first"))
    groups = components.join(sizes, "component").where("size > 1")
    alike = _finding(
        groups, "near_duplicate_content", "warning",
        text("The page is much like ", F.col("size") - 1, " others."), text("Group of page ", F.col("first")),
    )
    out = rendered
    for other in (lonely, deep, chained, dead, alike):
        out = out.unionByName(other)
    return out


def own_schema(schemas: Column) -> Column:
    """Whether a page has valid structured data of a type that is about the page."""
    telling = lambda t: ~t.isin(*PLAIN_TYPES)
    return F.exists(schemas, lambda s: s["valid"] & F.exists(s["types"], telling))


def summary(pages: DataFrame) -> DataFrame:
    """One row of ratios and counts over analysed pages: depth, orphan, page_type, has_schema, listed (in a sitemap),
    canonical, canonical_self, chain, bad_status, heading_skip, mixed, content_age_days."""
    eligible = ~F.coalesce(F.col("page_type"), F.lit("")).isin(*NO_SCHEMA_PAGES)
    canonical = F.col("canonical").isNotNull()
    return pages.agg(
        F.count("*").alias("pages"),
        F.count_if("orphan").alias("orphan_pages"),
        F.avg("depth").alias("average_click_depth"),
        percent(F.col("has_schema"), eligible).alias("schema_coverage"),
        percent(F.col("canonical_self"), canonical).alias("canonical_self_rate"),
        F.count_if("chain").alias("canonical_chains"),
        F.count_if(F.col("bad_status").isNotNull()).alias("canonical_non_200"),
        F.count_if(F.col("heading_skip").isNotNull()).alias("heading_violations"),
        F.count_if("mixed").alias("mixed_content_pages"),
        F.count_if(F.col("content_age_days") > STALE_DAYS).alias("stale_pages"),
        F.count_if("listed").alias("listed_pages"),
    )


def document_counts(pages: DataFrame) -> DataFrame:
    """One row: pages without title, description, main heading or canonical; mean words and response time where they are
    known and not 0; images without alternative text; canonicals that name another page."""
    empty = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    mean = lambda c: F.avg(F.nullif(F.col(c), F.lit(0)))
    return pages.agg(
        empty("title").alias("missing_titles"),
        empty("description").alias("missing_descriptions"),
        empty("h1").alias("missing_h1s"),
        empty("canonical").alias("missing_canonicals"),
        mean("words").alias("average_words"),
        mean("response_ms").alias("average_response_ms"),
        F.coalesce(F.sum("images_without_alt"), F.lit(0)).alias("images_without_alt"),
        F.count_if((F.coalesce(F.col("canonical"), F.lit("")) != "") & (F.col("canonical") != F.col("url"))).alias("canonical_mismatches"),
    )


def performance_means(reports: DataFrame) -> DataFrame:
    """One row of the means of known values: lab_lcp, lab_cls, lab_tbt and field_inp."""
    return reports.agg(*[F.avg(c).alias(c.split("_")[1]) for c in ("lab_lcp", "lab_cls", "field_inp", "lab_tbt")])


def crawl_waste(blocked: DataFrame, extra: DataFrame) -> DataFrame:
    """One row: blocked pages that are linked (blocked), URLs that differ in parameters alone (extra), and their sum."""
    both = blocked.crossJoin(F.broadcast(extra))  # one row each
    return both.withColumn("crawl_waste", F.col("blocked") + F.col("extra"))
