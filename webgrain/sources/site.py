"""Site files: sitemaps, robots rules, fetch logs and performance reports."""

from __future__ import annotations

import warnings
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions.urls import link_form, same_host

MAX_SITEMAPS = 100
CRAWLERS = ("OAI-SearchBot", "GPTBot", "ChatGPT-User", "Googlebot", "Bingbot")
LAB = {
    "lcp": "largest-contentful-paint",
    "fcp": "first-contentful-paint",
    "cls": "cumulative-layout-shift",
    "tbt": "total-blocking-time",
    "speed_index": "speed-index"
}
FIELD = {
    "lcp": "LARGEST_CONTENTFUL_PAINT_MS",
    "inp": "INTERACTION_TO_NEXT_PAINT",
    "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE",
    "fcp": "FIRST_CONTENTFUL_PAINT_MS"
}
SCORES = {"performance": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo"}


def sitemap_report(files: DataFrame, start_url: str) -> DataFrame:
    """files (url, status, xml): url, status, kind, entries (locations of the audited host), ok (a status of 200 and a known
    kind); of files that weren't found only those that something names should be given."""
    entries = sitemap_entries(files, start_url)
    told = files.select(F.col("url").alias("u"), "status").join(entries, F.col("u") == F.col("url")).drop("u")
    return told.select(
        "url", "status", "kind", F.size("locations").alias("entries"), ((F.col("status") == 200) & (F.col("kind") != "unknown")).alias("ok")
    )


def sitemap_pages(files: DataFrame, start_url: str) -> DataFrame:
    """(url): distinct page locations of the audited host in sitemaps (url, xml)."""
    listed = sitemap_entries(files, start_url).where("kind = 'urlset'")
    return listed.select(F.explode("locations").alias("url")).distinct()


def sitemap_entries(files: DataFrame, start_url: str | None = None) -> DataFrame:
    """files (url, xml): url, kind (index, urlset, unknown) and locations in link form, unusable ones left out, and with
    start_url those of other hosts."""
    xml = F.coalesce("xml", F.lit(""))
    kind = F.when(xml.rlike("<sitemapindex[ >]"), "index").when(xml.rlike("<urlset[ >]"), "urlset").otherwise("unknown")
    found = F.transform(
        F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), F.lit(1)),
        lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))
    )
    usable = lambda u: u.isNotNull() & (same_host(u, F.lit(start_url)) if start_url else F.lit(True))
    return files.select("url", kind.alias("kind"), F.filter(F.transform(found, link_form), usable).alias("locations"))


def reachable_sitemaps(files: DataFrame, start: list[str], *, most: int = MAX_SITEMAPS) -> DataFrame:
    """Entries of the sitemaps that lead from `start` through indexes, at most `most` files, as a level-by-level join."""
    entries = sitemap_entries(files)
    todo, seen = list(dict.fromkeys(start)), []
    while todo and len(seen) < most:
        seen += todo[: most - len(seen)]
        level = entries.where(
            F.col("url").isin(todo) & (F.col("kind") == "index")
        ).select(F.explode("locations").alias("u")).distinct().limit(most)
        todo = [u for u in sorted(r["u"] for r in level.collect()) if u not in seen]  # at most `most` rows
    if todo:
        warnings.warn(f"{most} sitemaps are read; more are named, {todo[0]} among them", stacklevel=2)
    return entries.where(F.col("url").isin(seen))


def allowed(rules: dict[str, str], url: str, agent: str) -> bool:
    """Whether robots rules (text by origin) let an agent fetch a URL; no rules allow all."""
    origin = "/".join(url.split("/")[:3])
    parser = RobotFileParser()
    parser.parse(rules.get(origin, "").splitlines())
    return parser.can_fetch(agent, url)


def with_allowed(urls: DataFrame, rules: dict[str, str], agent: str) -> DataFrame:
    """urls (url) with `allowed`; the rules are a small table by origin, one parser each in a worker."""
    parsers: dict[str, RobotFileParser] = {}

    def check(u: pd.Series) -> pd.Series:
        def one(x):
            origin = "/".join((x or "").split("/")[:3])
            if origin not in parsers:
                parsers[origin] = RobotFileParser()
                parsers[origin].parse(rules.get(origin, "").splitlines())
            return parsers[origin].can_fetch(agent, x or "")

        return u.map(one)

    return urls.withColumn("allowed", F.pandas_udf(check, "boolean")("url"))


def crawler_access(rules: dict[str, str], start_url: str) -> list[dict]:
    return [{"crawler": c, "allowed": allowed(rules, start_url, c)} for c in CRAWLERS]


def needs_rendering(page) -> Column:
    """Whether a page's HTML is a shell: little text, no structure, few links or no metadata; page[...]: body_chars,
    has_structure, link_count, has_metadata."""
    return (page["body_chars"] < 400) | ~page["has_structure"] | (page["link_count"] < 3) | ~page["has_metadata"]


def performance(reports: DataFrame, key: str, body: str) -> DataFrame:
    """Scores, lab and field metrics from performance reports in JSON; what a report lacks is null."""
    at = lambda path: F.get_json_object(F.col(body), path).try_cast("double")
    return reports.select(
        key,
        *[(F.floor(at(f"$.lighthouseResult.categories['{p}'].score") * 100 + 0.5)).alias(n) for n, p in SCORES.items()],
        *[at(f"$.lighthouseResult.audits['{p}'].numericValue").alias(f"lab_{n}") for n, p in LAB.items()],
        *[at(f"$.loadingExperience.metrics['{p}'].percentile").alias(f"field_{n}") for n, p in FIELD.items()],
    )


def retry_wait(attempt: int, retry_after: str | None) -> float:
    """Seconds before the next try of a limited API: what it asks for, within 1 to 60, else 2, 5, 15, 30."""
    try:
        return min(60.0, max(1.0, float(retry_after)))
    except (TypeError, ValueError):
        return (2.0, 5.0, 15.0, 30.0)[min(attempt, 3)]


def skipped_after_limit(reports: DataFrame, ordinal: str, limited: str) -> DataFrame:
    """reports with `skipped`: rows after the first limited one (found by one aggregate, not by an ordered window)."""
    first = reports.where(limited).agg(F.min(ordinal).alias("f"))
    return reports.withColumn("skipped", F.coalesce(F.col(ordinal) > first.scalar(), F.lit(False)))
