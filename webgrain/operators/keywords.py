"""Keyword targeting: page signals, site keywords, suppression of weaker parts, competing pages.

Scores are whole hundredths until the last projection, so sums are exact and order never depends on rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions.text import keyword_tokens

#: Hundredths that one occurrence adds, and the phrase lengths that count, by place.
PLACES = {"title": (800, 1, 4), "h1": (700, 1, 4), "h2": (400, 2, 4), "description": (300, 2, 4), "body": (12, 2, 4)}
LEAST_LENGTH, LEAST_SCORE, PER_PAGE = 4, 200, 40
#: Pages that are listed with a keyword, and parts in which those of one keyword are ranked first.
PAGES_LISTED, RANK_PARTS = 100, 16


def page_signals(
    pages: DataFrame, key: str, columns: dict[str, Column], *, per_page: int = PER_PAGE, body_chars: int | None = None
) -> DataFrame:
    """(key, phrase, score_h, places, rank): the best phrases of each page, from text columns by place.

    Ties go to the longer phrase (in words), then to the first one in the page's order of places, lengths and positions.
    body_chars cuts the body (None: the whole). A page's phrases are counted where the page is, in Arrow batches, and only
    its best leave: phrases are never shuffled. A row of pages is a page; null texts have no phrase.
    """
    places = [p for p in PLACES if p in columns]
    cut = lambda p: F.substring(columns[p], 1, body_chars) if p == "body" and body_chars else columns[p]
    tokens = pages.select(key, *[keyword_tokens(cut(p)).alias(f"tokens_{p}") for p in places])

    def best(lists: list[list[str] | None]) -> list[tuple]:
        score: Counter[str] = Counter()
        grams, held = [], {}
        for place, words in zip(places, lists, strict=True):
            weight, low, high = PLACES[place]
            for n in range(low, high + 1):
                own = list(map(" ".join, zip(*[(words or [])[i:] for i in range(n)], strict=False)))
                grams.append((place, n, own))
                for phrase, times in Counter(own).items():
                    score[phrase] += weight * times
        kept = {p for p, s in score.items() if s >= LEAST_SCORE and len(p) >= LEAST_LENGTH}
        at = 0
        for place, n, own in grams if kept else ():
            for i, phrase in enumerate(own):
                if phrase in kept:
                    held.setdefault(phrase, [-score[phrase], -n, at + i, set()])[3].add(place)
            at += len(own)
        order = sorted(held, key=lambda p: held[p][:3])[:per_page]
        return [(p, score[p], sorted(held[p][3]), rank) for rank, p in enumerate(order, 1)]

    shape = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [best(list(lists)) for lists in zip(*(b.column(i + 1).to_pylist() for i in range(len(places))), strict=True)]
            found = list(zip(*[x for r in rows for x in r], strict=True)) or [(), (), (), ()]
            of = b.column(0).take(pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows])))
            made = [
                pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], shape), pa.array(found[3], pa.int32())
            ]
            yield pa.RecordBatch.from_arrays([of, *made], names=[key, "phrase", "score_h", "places", "rank"])

    kind = pages.select(key).dtypes[0][1]
    return tokens.mapInArrow(run, f"`{key}` {kind}, phrase string, score_h long, places array<string>, rank int")


def site_keywords(signals: DataFrame, key: str) -> DataFrame:
    """One row for each phrase of two words or more: score_h, pages, top page and score (the first page of equal ones),
    and confidence_h, at most 98."""
    many = signals.where(F.col("phrase").contains(" "))
    best = F.max_by(
        F.struct(F.col(key).alias("page"), F.col("score_h").alias("s")), F.struct(F.col("score_h").alias("s"), (-F.col(key)).alias("k"))
    )
    grouped = many.groupBy("phrase").agg(F.sum("score_h").alias("score_h"), F.count("*").alias("pages"), best.alias("b"))
    return grouped.select(
        "phrase",
        "score_h",
        "pages",
        F.col("b.page").alias("top_page"),
        F.col("b.s").alias("top_h"),
        F.least(F.lit(98), F.expr("(1525 + 2 * b.s) div 50")).alias("confidence_h")
    )


def _first_of_each(rows: DataFrame, key: str, order: list[Column], part: Column, most: int) -> DataFrame:
    """The first `most` rows of each key, with their `place`: ranked in parts, then the first rows of these. A key that most of
    the rows have is so many rows of each part in the end, and no list is ever longer."""
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(part), F.lit(RANK_PARTS)))
    for by in ([key, "_part"], [key]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
    return salted.drop("_part")


def keyword_pages(signals: DataFrame, key: str, most: int = PAGES_LISTED) -> DataFrame:
    """(phrase, place, key, score_h, places): the best pages of each phrase of two words or more, `most` at most, the first page
    of equal ones first; places are the evidence, where on the page the phrase is."""
    many = signals.where(F.col("phrase").contains(" ")).select("phrase", key, "score_h", "places")
    return _first_of_each(many, "phrase", [F.desc("score_h"), F.col(key)], F.col(key), most)


def query_pages(metrics: DataFrame, most: int = PAGES_LISTED) -> DataFrame:
    """Rows of observed_page_metrics with their `place`: the pages of each query that were shown most, `most` at most."""
    order = [F.desc("impressions"), F.desc("clicks"), F.col("page")]
    return _first_of_each(metrics, "query", order, F.col("page"), most)


def with_page_lists(keywords: DataFrame, listed: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """keywords with the pages of each: page_scores (url, score_h, places) by place, from listed (phrase, place, url, score_h,
    places); page_metrics (page, clicks, impressions, ctr, position) by place, from shown (rows of query_pages); and pages, the
    URLs of both, those of the site first. Keywords without any have empty lists."""
    own = F.array_sort(F.collect_list(F.struct("place", "url", "score_h", "places")))
    site = listed.groupBy(F.lower("phrase").alias("_k")).agg(own.alias("_s"))
    both = keywords.withColumn("_key", F.lower("keyword")).join(site, F.col("_key") == F.col("_k"), "left").drop("_k")
    metric = "struct<place:int,page:string,clicks:double,impressions:double,ctr:double,position:double>"
    if shown is None:
        both = both.withColumn("_m", F.lit(None).cast(f"array<{metric}>"))
    else:
        row = F.struct("place", F.col("page").cast("string").alias("page"), "clicks", "impressions", "ctr", "position").cast(metric)
        seen = shown.groupBy(F.lower("query").alias("_k")).agg(F.array_sort(F.collect_list(row)).alias("_m"))
        both = both.join(seen, F.col("_key") == F.col("_k"), "left").drop("_k")
    scores = F.transform(F.coalesce("_s", F.array()), lambda x: F.struct(x["url"].alias("url"), x["score_h"].alias("score_h"), x["places"].alias("places")))
    names = ("page", "clicks", "impressions", "ctr", "position")
    figures = F.transform(F.coalesce("_m", F.array()), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    urls = F.array_union(F.transform("page_scores", lambda x: x["url"]), F.transform("page_metrics", lambda x: x["page"]))
    listed_ = both.withColumn("page_scores", scores).withColumn("page_metrics", figures).withColumn("pages", urls)
    return listed_.drop("_s", "_m", "_key")


def suppress_parts(keywords: DataFrame) -> DataFrame:
    """Keywords but for those that a longer one of the same top page, and no lower score, contains.

    Equal to picking greedily by score: what suppresses a dropped phrase also suppresses what that one would have. The
    join is on the top page, whose phrases are few (the limit of signals per page); no phrase is compared across pages.
    """
    other = keywords.select(F.col("phrase").alias("p"), F.col("score_h").alias("s"), F.col("top_page").alias("t"))
    inside = (F.col("t") == F.col("top_page")) & (F.col("s") >= F.col("score_h")) & (
        F.length("p") > F.length("phrase")
    ) & F.col("p").contains(F.col("phrase"))
    return keywords.join(other, inside, "left_anti")


def competing_pages(signals: DataFrame, key: str) -> DataFrame:
    """Phrases that several pages target: contenders score at least 5 and 65 % of the best; likely if the second has 80 %."""
    w = Window.partitionBy("phrase")
    many = signals.where(F.col("phrase").contains(" ")).withColumn("top", F.max("score_h").over(w))
    contenders = many.where((F.col("score_h") >= 500) & (100 * F.col("score_h") >= 65 * F.col("top")))
    ranked = contenders.withColumn("n", F.row_number().over(w.orderBy(F.desc("score_h"), key)))
    grouped = ranked.groupBy("phrase").agg(
        F.count("*").alias("contenders"), F.max("top").alias("top_h"), F.max(F.when(F.col("n") == 2, F.col("score_h"))).alias("second_h")
    )
    return grouped.where("contenders > 1").select(
        "phrase",
        "contenders",
        "top_h",
        "second_h",
        F.when(F.col("second_h") * 10 >= F.col("top_h") * 8, "likely").otherwise("possible").alias("severity")
    )


def observed_queries(rows: DataFrame) -> DataFrame:
    """Search rows (query, page, clicks, impressions, position, ordinal) by query: sums, click rate, impression-weighted
    position (the last row's where nothing was shown), pages."""
    weighted = F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions"))
    return rows.groupBy("query").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.coalesce(F.try_divide(F.sum("clicks"), F.sum("impressions")), F.lit(0.0)).alias("ctr"),
        F.coalesce(weighted, F.max_by("position", "ordinal")).alias("position"),
        F.countDistinct("page").alias("pages"),
    )


def observed_page_metrics(rows: DataFrame) -> DataFrame:
    """The same for each query and page: (query, page, clicks, impressions, ctr, position); rows without a page are left out."""
    paged = rows.where("page IS NOT NULL")
    weighted = F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions"))
    return paged.groupBy("query", "page").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.coalesce(F.try_divide(F.sum("clicks"), F.sum("impressions")), F.lit(0.0)).alias("ctr"),
        F.coalesce(weighted, F.max_by("position", "ordinal")).alias("position"),
    )


def with_page_metrics(queries: DataFrame, metrics: DataFrame) -> DataFrame:
    """queries with `page_metrics`, a map from each page to its figures."""
    entry = F.struct("page", F.struct("clicks", "impressions", "ctr", "position"))
    maps = metrics.groupBy("query").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("page_metrics"))
    return queries.join(maps, "query", "left")


def average_position(queries: DataFrame) -> DataFrame:
    """One row: the impression-weighted mean position, the plain mean without impressions, null without rows."""
    return queries.agg(
        F.coalesce(F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")), F.avg("position")).alias("position")
    )


def observed_competition(rows: DataFrame) -> DataFrame:
    """Queries shown for several pages: none if the leader has 90 % of the impressions, likely if it has less than 65 %
    and there are more than two pages."""
    per = rows.groupBy("query", "page").agg(F.sum("impressions").alias("i"))
    grouped = per.groupBy("query").agg(
        F.count("*").alias("pages"),
        F.sum("i").alias("impressions"),
        F.coalesce(F.try_divide(F.max("i"), F.sum("i")), F.lit(0.0)).alias("leader_share")
    )
    open_ = grouped.where((F.col("pages") > 1) & (F.col("leader_share") < 0.9))
    return open_.withColumn("severity", F.when((F.col("leader_share") < 0.65) & (F.col("pages") > 2), "likely").otherwise("possible"))


def merge_observed(keywords: DataFrame, observed: DataFrame) -> DataFrame:
    """Full outer join of keywords and observed queries on the lower-cased phrase; `final_keywords` orders and cuts it."""
    k = keywords.withColumn("join_key", F.lower("phrase"))
    o = observed.withColumn("join_key", F.lower("query"))
    both = k.join(o, "join_key", "full_outer")
    more = []
    if "confidence_h" in keywords.columns:  # what visitors searched for is certain
        more.append(F.coalesce("confidence_h", F.lit(100)).alias("confidence_h"))
    if "ctr" in observed.columns:
        more.append(F.col("ctr"))
    return both.select(
        F.coalesce("phrase", "query").alias("keyword"),
        F.col("query").isNotNull().alias("observed"),
        F.coalesce("score_h", F.lit(0)).alias("score_h"),
        F.coalesce("impressions", F.lit(0)).alias("impressions"),
        F.coalesce("clicks", F.lit(0)).alias("clicks"),
        "position",
        *more,
    )


def final_keywords(merged: DataFrame, most: int) -> DataFrame:
    """The first `most` keywords with `rank`: observed ones first, then by impressions, score and phrase."""
    order = [F.desc("observed"), F.desc("impressions"), F.desc("score_h"), F.col("keyword")]
    return merged.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of `most` rows


def primary_keywords(pages: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """(key, primary_keyword): a page's best phrase of several words, else its first main heading, else its title."""
    best = signals.where(F.col("phrase").contains(" ")).groupBy(key).agg(F.min_by("phrase", "rank").alias("p"))
    own = F.coalesce("p", F.nullif(F.get("h1s", 0), F.lit("")), F.nullif(F.col("title"), F.lit("")))
    return pages.join(best, key, "left").select(key, own.alias("primary_keyword"))


def with_rankings(keywords: DataFrame, rankings: DataFrame) -> DataFrame:
    """Keywords with their ranking (position), null where none was looked up."""
    return keywords.join(rankings.select("keyword", F.col("position").alias("ranking")), "keyword", "left")
