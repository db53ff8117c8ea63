"""Page lists of keywords: bounded, ranked in parts, and what views make of them; sorting of shown columns."""

import random

import pytest
from pyspark.sql import functions as F

from webgrain.operators import keywords, views

SIGNALS = "phrase string, page long, score_h long, places array<string>"


@pytest.mark.parametrize("most", [1, 3, 100])
def test_lists_are_the_best_pages_of_each_phrase(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["red shoe"] * 6 + ["blue hat", "one"]), i, 100 * rng.randrange(9), ["title"]) for i in range(200)]
    got = keywords.keyword_pages(spark.createDataFrame(rows, SIGNALS).repartition(5), "page", most).collect()
    want = {}
    for phrase in ("red shoe", "blue hat"):
        best = sorted(((-s, p) for x, p, s, _ in rows if x == phrase))[:most]
        want |= {(phrase, n): (p, -s) for n, (s, p) in enumerate(best, 1)}
    assert {(r["phrase"], r["place"]): (r["page"], r["score_h"]) for r in got} == want


def test_a_plan_ranks_in_parts_before_it_ranks_all(spark):
    plan = keywords.keyword_pages(spark.createDataFrame([], SIGNALS), "page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "_part" in plan


def test_keywords_with_lists_and_their_view(spark):
    merged = spark.createDataFrame(
        [("red shoe", False, 900, 0.0, None), ("Red Shoe", True, 0, 50.0, 3.0), ("Only Seen", True, 0, 9.0, 12.0), ("bare", False, 1, 0.0, None)],
        "keyword string, observed boolean, score_h long, impressions double, position double",
    )
    listed = spark.createDataFrame([("red shoe", 2, "https://a.example/B", 300, ["body"]), ("red shoe", 1, "https://a.example/a", 600, ["h1", "title"])], "phrase string, place int, url string, score_h long, places array<string>")
    rows = spark.createDataFrame([("Red Shoe", "https://a.example/a", 1.0, 40.0, 2.0, 1), ("RED shoe", "https://a.example/c", 0.0, 10.0, 7.0, 2), ("only seen", None, 0.0, 9.0, 12.0, 3)], "query string, page string, clicks double, impressions double, position double, ordinal long")
    metrics = keywords.query_pages(keywords.observed_page_metrics(rows))
    full = {r["keyword"]: r for r in keywords.with_page_lists(merged, listed, metrics).collect()}
    assert full["red shoe"]["pages"] == ["https://a.example/a", "https://a.example/B", "https://a.example/c"]
    assert [x["places"] for x in full["Red Shoe"]["page_scores"]] == [["h1", "title"], ["body"]]
    assert full["Only Seen"]["pages"] == full["bare"]["pages"] == [] and full["bare"]["page_metrics"] == []
    shown = views.keyword_view(keywords.with_page_lists(merged, listed, metrics), page="/b")
    assert [r["keyword"] for r in shown.collect()] == ["Red Shoe", "red shoe"]
    assert keywords.with_page_lists(merged, listed).where(F.size("page_metrics") > 0).count() == 0


def test_shown_columns_sort_by_number_and_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["10", "2", None, "9", "", "item 12", "Item 3", "item 003", "007"])], "o int, v string")
    order = lambda **kw: [r["v"] for r in views.sorted_rows(df, "v", ordinal="o", **kw).collect()]
    assert order() == ["2", "007", "9", "10", "Item 3", "item 003", "item 12", None, ""]
    assert order(descending=True)[:3] == ["item 12", "item 003", "Item 3"] and order(descending=True)[-2:] == [None, ""]
    ranks = spark.createDataFrame([(i, v) for i, v in enumerate(["info", "critical", "warning", None])], "o int, v string")
    assert [r["v"] for r in views.sorted_rows(ranks, "v").collect()] == ["critical", "warning", "info", None]
    numbers = spark.createDataFrame([(10,), (2,), (None,)], "n int")
    assert [r["n"] for r in views.sorted_rows(numbers, "n").collect()] == [2, 10, None]
