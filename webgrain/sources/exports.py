"""Search and analytics exports: quoted CSV files with preambles, found headers, and dates."""

from __future__ import annotations

import csv
import io
import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.operators.enrich import number, rate
from webgrain.sources.quoted import bare, read_quoted

# Spellings of fields in exports, by their letters and digits.
SEARCH_DIMENSIONS = {"query": ("query", "queries", "topqueries"), "page": ("page", "pages", "toppages"), "date": ("date",)}
SEARCH_METRICS = {"clicks": ("clicks",), "impressions": ("impressions",), "ctr": ("ctr",), "position": ("position", "averageposition")}
ANALYTICS_DIMENSIONS = {
    "page": ("landingpage", "landingpagequerystring", "pagepath", "pagepathquerystring", "pagepathandscreenclass", "page", "pages"),
    "date": ("date",),
}
ANALYTICS_METRICS = {
    "sessions": ("sessions",),
    "users": ("totalusers", "activeusers", "users"),
    "engaged": ("engagedsessions",),
    "engagement_rate": ("engagementrate",),
    "bounce": ("bouncerate",),
    "key_events": ("keyevents", "conversions"),
}
#: What analytics writes for visits without a page.
NOT_SET = "(not set)"
#: Queries with a search operator aren't searches of visitors.
OPERATOR = r"(?i)^(site|cache|related|info|filetype|inurl|intitle|allinurl|allintitle):"
DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%Y%m%d", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y")


def table(text: str) -> list[list[str]]:
    """Rows of a CSV with quoted cells, blank rows left out."""
    return [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n"))) if any(c.strip() for c in r)]


def read_export(spark: SparkSession, path: str, dimensions: dict, metrics: dict) -> DataFrame:
    """All data rows of an export, a file or a folder of them, as strings in columns named by field, with `ordinal`.

    Each file's header is the first line, however late, with a known dimension and a known metric; a field that it lacks is
    null. Rows are in the order of the files' paths, and within one as they come. See read_quoted for how files are read.
    """
    rows = read_quoted(spark, path, dimensions, metrics)
    return rows.select(*dimensions, *metrics, F.struct("file", "block", "line").alias("ordinal"))


def search_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of a search export without queries that use an operator; a missing page stays null."""
    typed = raw.select(
        F.col("query"),
        F.nullif(F.col("page"), F.lit("")).alias("page"),
        number(F.col("clicks")).alias("clicks"),
        number(F.col("impressions")).alias("impressions"),
        rate(F.col("ctr")).alias("ctr"),
        number(F.col("position")).alias("position"),
        "ordinal"
    )
    return typed.where((F.coalesce("query", F.lit("")) != "") & ~F.coalesce(F.col("query").rlike(OPERATOR), F.lit(False)))


def analytics_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of an analytics export but those of no page; rates that aren't in the file, or are blank, stay null."""
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", rate(F.col(c)))
    return raw.where(~F.coalesce("page", F.lit("")).isin("", NOT_SET)).select(
        "page",
        *[number(F.col(c)).alias(c) for c in ("sessions", "users", "engaged", "key_events")],
        known("engagement_rate").alias("engagement_rate"),
        known("bounce").alias("bounce"),
        "ordinal"
    )


def combined(raw: DataFrame) -> bool:
    """Whether an export has queries and pages; such files win over those with one of the two."""
    return raw.where("query IS NOT NULL AND page IS NOT NULL").limit(1).count() > 0


def merge_search(combined_files: list[DataFrame], single_files: list[DataFrame]) -> DataFrame | None:
    """Typed rows of the search exports that count: files with queries and pages, where there are any, else all others;
    together they would count twice. `ordinal` follows the order of the files. None without files."""
    chosen = combined_files or single_files
    out = None
    for i, rows in enumerate(chosen):
        placed = rows.withColumn("ordinal", F.struct(F.lit(i).alias("file"), "ordinal"))
        out = placed if out is None else out.unionByName(placed)
    return out


def chosen_period(given: dict | None, *detected: dict | None) -> dict | None:
    """The period that the caller or an interface gives, else the first one that is found in the files."""
    return next((p for p in (given, *detected) if p), None)


def parse_date(text: str) -> date | None:
    for f in DATE_FORMATS:
        try:
            return datetime.strptime(text.strip(), f).date()
        except ValueError:
            pass
    return None


def period(text: str, dimensions: dict) -> dict | None:
    """The period of an export: a filter row with two dates or a label, a 'Date:' line, or the dates of its rows."""
    rows = table(text)
    listed = next((i for i, r in enumerate(rows) if bare(r[0]) == "filter"), len(rows))
    for r in rows[listed + 1 :]:
        if len(r) >= 2 and bare(r[0]) in ("date", "daterange"):
            days = [d for p in re.split(r"\s+(?:-|–|to)\s+", r[1]) if (d := parse_date(p))]
            if len(days) == 2:
                return {"start": min(days), "end": max(days), "label": None, "source": "filter"}
            if len(r) == 2 and not parse_date(r[1]) and not re.search(r"\d", r[1].split()[0] if r[1].split() else ""):
                return {"start": None, "end": None, "label": r[1].strip(), "source": "label"}
    marks = {m[1].lower(): parse_date(m[2]) for m in re.finditer(r"(?im)^#?\s*(start|end) date:\s*(\S+)", text)}
    if marks.get("start") and marks.get("end"):
        return {"start": marks["start"], "end": marks["end"], "label": None, "source": "metadata"}
    if m := re.search(r"(?im)^#?\s*date(?: range)?:\s*(.+?),*\s*$", text):
        days = [d for p in re.split(r"\s*(?:–| to | - |-(?=\d{8}))\s*", m[1]) if (d := parse_date(p))]
        if len(days) == 2:
            return {"start": min(days), "end": max(days), "label": None, "source": "metadata"}
        return {"start": None, "end": None, "label": m[1], "source": "label"}
    heads = [i for i, r in enumerate(rows) if any(bare(c) in dimensions["date"] for c in r) and len(r) > 1]
    if heads:
        at = next(i for i, c in enumerate(rows[heads[0]]) if bare(c) in dimensions["date"])
        days = [d for r in rows[heads[0] + 1 :] if len(r) > at and (d := parse_date(r[at]))]
        if days:
            return {"start": min(days), "end": max(days), "label": None, "source": "rows"}
    return None
