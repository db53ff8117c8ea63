"""Answers of outside services as DataFrames. Each takes the function that asks the service, so that nothing here knows an
address or a key; that function runs in Python workers and must be picklable."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
    StringContains,
)

from webgrain.sources.site import retry_wait

PAGE_ROWS, MOST_ROWS = 25_000, 50_000
SEARCH_SHAPE = "query string, page string, clicks double, impressions double, ctr double, position double, ordinal long"
PACE_S, TRIES = 1.1, 4


def search_console_rows(
    spark: SparkSession, ask: Callable[[int, int], list[dict]], *, most: int = MOST_ROWS, page: int = PAGE_ROWS
) -> DataFrame:
    """Search rows by query and page, up to `most`. ask(first row, row limit) gives rows with keys [query, page], clicks,
    impressions, ctr and position; a page that isn't full is the last. Pages are asked for each in a task of its own; rows
    of later pages than the last one are none."""
    if not 1 <= most <= MOST_ROWS:
        raise ValueError(f"most is from 1 to {MOST_ROWS}")
    names = [c.split()[0] for c in SEARCH_SHAPE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first, limit in zip(f["first"], f["limit"], strict=True):
                got = ask(int(first), int(limit))
                rows = [
                    (*(list(r.get("keys") or []) + [None, None])[:2], *(float(r.get(c) or 0) for c in names[2:6]), int(first) + i) for i,
                    r in enumerate(got)
                ]
                yield pd.DataFrame(rows, columns=names)

    pages = spark.createDataFrame([(a, min(page, most - a)) for a in range(0, most, page)], "first long, limit long")
    return pages.repartition(len(range(0, most, page)), "first").mapInPandas(run, SEARCH_SHAPE)


SEARCH_FIELDS = "date date, query string, page string, clicks double, impressions double, ctr double, position double, ordinal long"


class SearchSource(DataSource):
    """Search rows by date, query and page as a table: spark.read.format("webgrain_search").

    Options: asker ('module:function'), most and page (rows in all, and of a request). The function is given first, limit, start
    and end (dates, both included, or None) and filters ((field, 'equals' or 'contains', value), ...), and returns rows with keys
    [date, query, page], clicks, impressions, ctr and position, as search_console_rows's does. Conditions on date and page
    become part of the request (with spark.sql.python.filterPushdown.enabled); each request is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "webgrain_search"

    def schema(self) -> str:
        return SEARCH_FIELDS

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.asker = options["asker"]
        self.most, self.page = int(options.get("most", MOST_ROWS)), int(options.get("page", PAGE_ROWS))
        if not 1 <= self.most <= MOST_ROWS or self.page < 1:
            raise ValueError(f"most is from 1 to {MOST_ROWS}, page at least 1")
        self.start = self.end = None
        self.filters: list[tuple[str, str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of date and an exact page; what a page contains narrows the request, and Spark looks again."""
        day = timedelta(days=1)
        for f in filters:
            field, value = ".".join(f.attribute) if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if field == "date" and isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThanOrEqual | LessThan):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    first = value + day if isinstance(f, GreaterThan) else value
                    self.start = first if self.start is None else max(self.start, first)
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    last = value - day if isinstance(f, LessThan) else value
                    self.end = last if self.end is None else min(self.end, last)
            elif field == "page" and isinstance(f, EqualTo):
                self.filters.append(("page", "equals", value))
            else:
                if field == "page" and isinstance(f, StringContains):
                    self.filters.append(("page", "contains", value))
                yield f

    def partitions(self):
        if self.start is not None and self.end is not None and self.start > self.end:
            return [InputPartition((0, 0))]
        return [InputPartition((a, min(self.page, self.most - a))) for a in range(0, self.most, self.page)]

    def read(self, partition) -> Iterator[tuple]:
        first, limit = partition.value
        if not limit:
            return
        module, name = self.asker.split(":")
        ask = getattr(importlib.import_module(module), name)
        for i, r in enumerate(ask(first=first, limit=limit, start=self.start, end=self.end, filters=list(self.filters))):
            day, query, page = (list(r.get("keys") or []) + [None] * 3)[:3]
            figures = (float(r.get(c) or 0) for c in ("clicks", "impressions", "ctr", "position"))
            yield (date.fromisoformat(day) if day else None, query, page, *figures, first + i)


def performance_reports(
    urls: DataFrame, ask: Callable[[str], dict], *, pace: float = PACE_S, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """(ordinal, url, body, error_code, skipped) of a report for each of urls (ordinal, url), one after the other.

    ask(url): status, body, retry_after. A limited (429) or failing (500 and above) answer is tried again TRIES times at
    most, after what it asks for; once the limit holds, the rest is skipped. The service's pace, not the data, sets the time,
    so one task asks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limited, first = False, True
        for f in frames:
            rows = []
            for ordinal, url in zip(f["ordinal"], f["url"], strict=True):
                if limited:
                    rows.append((ordinal, url, None, "skipped_after_rate_limit", True))
                    continue
                if not first:
                    wait(pace)
                first, answer = False, {}
                for attempt in range(TRIES):
                    answer = ask(url)
                    if answer["status"] != 429 and answer["status"] < 500:
                        break
                    if attempt < TRIES - 1:
                        wait(retry_wait(attempt, answer.get("retry_after")))
                limited = answer["status"] == 429
                code = None if answer["status"] == 200 else "rate_limited" if limited else f"http_{answer['status']}"
                rows.append((ordinal, url, answer.get("body") if code is None else None, code, False))
            yield pd.DataFrame(rows, columns=["ordinal", "url", "body", "error_code", "skipped"])

    ordered = urls.select(F.col("ordinal").cast("long").alias("ordinal"), "url").repartition(1).sortWithinPartitions("ordinal")
    return ordered.mapInPandas(run, "ordinal long, url string, body string, error_code string, skipped boolean")


def lookup_rankings(keywords: DataFrame, ask: Callable[[str, str], dict], domain: str, *, at_once: int = 3) -> DataFrame:
    """(keyword, position, ranking_url) for the keywords that a ranking service answers for; failures give no row. At most
    `at_once` tasks ask at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k in f["keyword"]:
                try:
                    r = ask(k, domain)
                except Exception:  # noqa: BLE001  whatever the service raises, the keyword has no ranking
                    continue
                rows.append((k, r.get("position"), r.get("ranking_url")))
            yield pd.DataFrame(rows, columns=["keyword", "position", "ranking_url"]).astype({"position": "Int64"})

    return keywords.select("keyword").coalesce(at_once).mapInPandas(run, "keyword string, position long, ranking_url string")


def image_analysis(images: DataFrame, ask: Callable[[str], dict]) -> DataFrame:
    """(src, alt, filename, description) of the image sources that a vision service answers for; failures give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for src in f["src"]:
                try:
                    r = ask(src)
                except Exception:  # noqa: BLE001  the suggestion from the page stays
                    continue
                rows.append((src, r.get("alt"), r.get("filename"), r.get("description")))
            yield pd.DataFrame(rows, columns=["src", "alt", "filename", "description"], dtype=object)

    return images.select("src").distinct().mapInPandas(run, "src string, alt string, filename string, description string")


def stored_json(path: str) -> dict:
    """A small JSON document of a stored run, such as its settings."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
