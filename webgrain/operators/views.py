"""Filtered and ordered views of report tables, as a report's reader asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.operators.findings import DIMENSIONS
from webgrain.sources.sinks import technical_rows

SEVERITY = {"critical": 0, "warning": 1, "info": 2}
# Words that sort by rank instead of spelling
RANKED = {
    **SEVERITY, "high": 0, "medium": 1, "low": 2, "strong": 0, "generally ready": 1, "partial": 2, "significant barriers": 3,
}


def _has(col: str, text: str | None) -> Column:
    return F.lit(True) if not text else F.lower(F.coalesce(F.col(col), F.lit(""))).contains(text.lower())


def keyword_view(
    keywords: DataFrame, *, text: str | None = None, page: str | None = None, position: float | None = None, unavailable: bool = False
) -> DataFrame:
    """keywords (keyword, pages array<string>, position, impressions, score_h) by phrase, page, and position up to a bound
    or not known; observed ones first."""
    out = keywords.where(_has("keyword", text))
    if page:
        out = out.where(F.exists("pages", lambda p: F.lower(p).contains(page.lower())))
    if unavailable:
        out = out.where("position IS NULL")
    elif position is not None:
        out = out.where(F.col("position") <= position)
    return out.orderBy(F.desc(F.col("position").isNotNull()), F.desc_nulls_last("impressions"), F.desc("score_h"), "keyword")


def search_view(queries: DataFrame, *, text: str | None = None, position: float | None = None) -> DataFrame:
    out = queries.where(_has("query", text))
    return (out if position is None else out.where(F.col("position") <= position)).orderBy(F.desc("impressions"), "query")


def analytics_view(pages: DataFrame, *, text: str | None = None, min_sessions: float = 0, key_events: bool | None = None) -> DataFrame:
    """pages (url, sessions, key_events) with analytics, most sessions first."""
    out = pages.where(F.col("sessions").isNotNull() & _has("url", text) & (F.col("sessions") >= min_sessions))
    if key_events is not None:
        out = out.where((F.coalesce("key_events", F.lit(0)) > 0) == F.lit(key_events))
    return out.orderBy(F.desc("sessions"), "url")


def finding_view(findings: DataFrame, *, severity: str | None = None) -> DataFrame:
    """findings (severity, category, url, ...), most severe first, then by category and URL."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in SEVERITY.items()], F.lit(3))
    out = findings if severity is None else findings.where(F.col("severity") == severity)
    return out.orderBy(rank, "category", "url")


def search_rows(rows: DataFrame, text: str) -> DataFrame:
    """Rows any of whose cells, as they are shown, contains a text."""
    shown = F.concat_ws(
        " ",
        *[F.col(f"`{c}`").cast("string") if not k.startswith(("array", "struct", "map")) else F.to_json(f"`{c}`") for c, k in rows.dtypes]
    )
    return rows.where(F.lower(shown).contains(text.lower()))


def natural_order(text: Column) -> Column:
    """A key by which texts sort with their numbers as numbers: runs of digits by value, the rest without case."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"))
    digits = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    number = lambda x: F.concat(F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x))


def sorted_rows(rows: DataFrame, column: str, *, descending: bool = False, ordinal: str | None = None) -> DataFrame:
    """Rows by a column, missing and empty values last either way; equal ones by `ordinal`. Numbers in texts count as numbers,
    severities, impacts and labels by rank."""
    c = F.col(f"`{column}`")
    keys = [c]
    if dict(rows.dtypes)[column] == "string":
        given = F.when(c != "", c)
        rank = F.coalesce(*[F.when(F.lower(c) == w, F.lit(n)) for w, n in RANKED.items()])
        keys = [rank, natural_order(given), given]
    return rows.orderBy(
        *[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys], *([ordinal] if ordinal else [])
    )


def dashboard_totals(pages: DataFrame) -> DataFrame:
    """One row of key figures from pages (score, sessions, users, engaged, bounce)."""
    known = F.when(F.col("bounce").isNotNull(), F.col("sessions"))
    return pages.agg(
        F.floor(F.avg("score") + 0.5).alias("score"),
        F.sum("sessions").alias("sessions"),
        F.sum("users").alias("users"),
        F.sum("engaged").alias("engaged"),
        F.try_divide(F.sum("engaged"), F.sum("sessions")).alias("engagement_rate"),
        F.try_divide(F.sum(F.col("bounce") * known), F.sum(known)).alias("bounce_rate"),
    )


def document_keywords(keywords: DataFrame) -> DataFrame:
    """Keywords as a document lists them: observed ones first, by position, those without one last, then by phrase."""
    return keywords.orderBy(F.desc("observed"), F.asc_nulls_last("position"), "keyword")


def executive_view(report: dict[str, DataFrame]) -> DataFrame:
    """One row: the summary's figures, severity counts, label, and key figures of the pages."""
    totals = [report["summary"], report["health"].drop("pages")]
    if "sessions" in report["pages"].columns:
        totals.append(dashboard_totals(report["pages"]))
    out = totals[0]
    for one in totals[1:]:
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def page_view(pages: DataFrame, *, text: str | None = None, page_type: str | None = None) -> DataFrame:
    out = pages.where(_has("url", text) | _has("title", text))
    out = out if page_type is None else out.where(F.col("page_type") == page_type)
    return out.select("url", "page_type", "status", "title", "words", "incoming", "depth", "orphan", "score", "label").orderBy("url")


def content_view(pages: DataFrame) -> DataFrame:
    """What pages say of themselves, thin and stale ones first."""
    columns = ["url", "title", "description", "h1", "words", "grade", "words_per_sentence", "content_age_days"]
    return pages.select(*columns).orderBy("words", F.desc_nulls_last("content_age_days"), "url")


def technical_view(report: dict[str, DataFrame]) -> DataFrame:
    """Broken links, redirects, external pages and excluded URLs as rows of one shape."""
    external = report["external"]
    target = "target" if "target" in external.columns else "url"
    outside = external.select(F.get("sources", 0).alias("first_source"), F.col(target).alias("target"), F.size("sources").alias("pages"))
    broken = report.get("broken_links")
    if broken is None:
        broken = report["excluded"].limit(0).select(F.lit("").alias("source"), F.lit("").alias("text"), F.lit("").alias("target"), "status")
    return technical_rows(broken, report["redirects"], outside, report["excluded"])


def readiness_view(pages: DataFrame) -> DataFrame:
    """Answer readiness by page, the least ready first."""
    return pages.select("url", "score", "label", *DIMENSIONS).orderBy("score", "url")


def image_view(images: DataFrame, *, missing: bool = False) -> DataFrame:
    out = images.where(F.coalesce(F.col("alt"), F.lit("")) == "") if missing else images
    return out.orderBy(F.desc("pages"), F.desc("occurrences"), "src")


def performance_view(reports: DataFrame) -> DataFrame:
    """Performance reports, the slowest first, those without a score last."""
    return reports.orderBy(
        F.asc_nulls_last("performance"), "url"
    ) if "performance" in reports.columns else reports.orderBy(F.desc_nulls_last("lab_lcp"), "url")


def priority_view(priorities: DataFrame, *, impact: str | None = None) -> DataFrame:
    return (priorities if impact is None else priorities.where(F.col("impact") == impact)).orderBy("rank")


def report_views(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every view of a report, by name; those of what it lacks are left out."""
    pages = report["pages"]
    views = {
        "executive": executive_view(report),
        "priorities": priority_view(report["priorities"]),
        "pages": page_view(pages),
        "content": content_view(pages),
        "technical": technical_view(report),
        "readiness": readiness_view(pages),
        "keywords": document_keywords(report["keywords"]),
        "images": image_view(report["images"]),
        "findings": finding_view(report["findings"]),
    }
    if "search" in report:
        views["search"] = search_view(report["search"])
    if "sessions" in pages.columns:
        views["analytics"] = analytics_view(pages)
    if report.get("performance") is not None:
        views["performance"] = performance_view(report["performance"])
    return views
