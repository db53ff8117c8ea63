"""python -m webgrain START_URL OUT: crawls or reads a fetch log, audits it, and writes the report's files."""

from __future__ import annotations

import argparse
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.operators import history, views
from webgrain.session import AuditSession
from webgrain.sources import exports, fetch, sinks, site


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webgrain")
    p.add_argument("start_url")
    p.add_argument("out")
    p.add_argument("--log", help="Parquet of fetched rows; without it the site is crawled")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--max-keywords", type=int, default=500)
    p.add_argument("--max-rankings", type=int, default=100)
    p.add_argument("--max-depth", type=int, default=12)
    p.add_argument("--exclude", action="append", default=[], metavar="PATH")
    p.add_argument("--exclude-archives", action="store_true")
    p.add_argument("--delay-ms", type=int, default=0, help="pause between two requests to a host")
    p.add_argument("--concurrency", type=int, default=1, help="requests to a host at once")
    p.add_argument("--no-sitemaps", action="store_true", help="start from the start URL alone")
    p.add_argument("--search-export")
    p.add_argument("--analytics-export")
    p.add_argument("--external-depth", type=int, default=0)
    p.add_argument("--no-images", action="store_true")
    p.add_argument("--no-broken-links", action="store_true")
    p.add_argument("--no-schema", action="store_true")
    return p


def settings(a: argparse.Namespace) -> AuditConfig:
    return AuditConfig(
        start_url=a.start_url, max_pages=a.max_pages, max_keywords=a.max_keywords, max_rankings=a.max_rankings, max_depth=a.max_depth,
        exclude_paths=tuple(a.exclude), exclude_archives=a.exclude_archives, external_depth=a.external_depth,
        delay_ms=a.delay_ms, concurrency=a.concurrency,
        analyze_images=not a.no_images, report_broken_links=not a.no_broken_links, analyze_schema=not a.no_schema,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None, get=fetch.http_get) -> None:
    a = parser().parse_args(argv)
    spark, config = spark or SparkSession.builder.appName("webgrain").getOrCreate(), settings(a)
    origin = "/".join(a.start_url.split("/")[:3])
    answer = fetch.follow(f"{origin}/robots.txt", get)
    robots = {origin: answer["html"] or ""} if answer["status"] == 200 else {}  # no rules allow all
    files = pages = None
    if a.log:
        log = spark.read.parquet(a.log)
    else:
        if not a.no_sitemaps:
            listed = fetch.listed_sitemaps(robots.get(origin, ""), a.start_url)
            files = fetch.sitemap_files(spark, listed, get, config)
            if "sitemap:" not in robots.get(origin, "").lower():  # a place that is only guessed isn't missed
                files = files.where(~F.col("url").isin(listed) | (F.col("status") == 200))
            pages = site.sitemap_pages(files, a.start_url)
        log = fetch.crawl(spark, [a.start_url], get, config=config, robots=robots, sitemap=pages)
    search = analytics = None
    if a.search_export:
        search = exports.search_rows(exports.read_export(spark, a.search_export, exports.SEARCH_DIMENSIONS, exports.SEARCH_METRICS))
    if a.analytics_export:
        analytics = exports.analytics_rows(
            exports.read_export(spark, a.analytics_export, exports.ANALYTICS_DIMENSIONS, exports.ANALYTICS_METRICS)
        )
    session = AuditSession(spark, config)
    report = session.run(log, robots=robots, sitemaps=files, search=search, analytics=analytics)
    if config.external_depth and not a.log:
        report["external"] = fetch.external_checks(report["links"].select(F.col("url").alias("source"), "target", "internal"), get, config)
    host = F.regexp_extract("target", "//([^/:]+)", 1)
    tables = {
        "pages": sinks.page_rows(report["pages"]),
        "links": sinks.link_rows(report["links"].select(F.col("url").alias("source"), "text", "target", "internal"), host),
        "technical": views.technical_view(report),
        "keywords": sinks.keyword_rows(report["keywords"]),
        "images": report["images"],
    }
    for name, df in tables.items():
        sinks.write_csv(df, f"{a.out}/{name}.csv")
    for name, df in report.items():
        sinks.write_json(df, f"{a.out}/report/{name}")
    facts = {
        "domain": urlsplit(a.start_url).hostname,
        "config_fingerprint": history.config_fingerprint(config.settings()),
        "scan_type": history.scan_type(config.settings())
    }
    sinks.write_json(spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} string" for k in facts)), f"{a.out}/report/run")


if __name__ == "__main__":
    main()
