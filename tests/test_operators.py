"""Graph, keyword, duplicate, history and finding operators against plain Python."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.operators import components, duplicates, enrich, findings, graph, history, keywords


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_click_depth_is_breadth_first_with_cycles(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (0, 3), (5, 6), (3, 9)]
    pages = spark.createDataFrame([(i,) for i in range(7)], "key long")
    got = {r["key"]: r["depth"] for r in graph.click_depths(pages, spark.createDataFrame(edges, "source long, target long"), pages.where("key = 0")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: None, 5: None, 6: None}


@given(st.lists(st.tuples(st.text("ab ", min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 2)), max_size=12, unique_by=lambda x: x[0]))
def test_suppression_equals_the_greedy_choice(rows):
    order = sorted(rows, key=lambda r: (-r[1], -len(r[0]), r[0]))
    chosen = []
    for p, s, t in order:
        if not any(t == u and p in q and c >= 0.75 * s for q, c, u in chosen):
            chosen.append((p, s, t))
    joined = {p for p, s, t in rows if not any(t == u and c >= s and len(q) > len(p) and p in q for q, c, u in rows)}
    assert {p for p, _, _ in chosen} == joined


def test_suppression_and_signals(spark):
    k = spark.createDataFrame([("red shoe", 900, 1, 1), ("red shoe shop", 950, 1, 1), ("red", 990, 1, 1), ("red shoe", 100, 1, 2)], "phrase string, score_h long, pages long, top_page long")
    assert sorted(r["phrase"] for r in keywords.suppress_parts(k).where("top_page = 1").collect()) == ["red", "red shoe shop"]
    pages = spark.createDataFrame([(1, "Red shoe shop", "body " * 3), (2, "", None)], "id long, title string, body string")
    got = keywords.page_signals(pages, "id", {"title": F.col("title"), "body": F.col("body")}).orderBy("rank").collect()
    assert got[0]["phrase"] == "red shoe shop" and got[0]["score_h"] == 800 and {r["id"] for r in got} == {1}


def test_observed_competition(spark):
    rows = spark.createDataFrame([("q", "a", 50.0, 5.0), ("q", "b", 40.0, 5.0), ("q", "c", 20.0, 5.0), ("r", "a", 95.0, 1.0), ("r", "b", 5.0, 1.0)], "query string, page string, impressions double, position double")
    assert [(r["query"], r["severity"]) for r in keywords.observed_competition(rows).collect()] == [("q", "likely")]


def test_near_duplicates_share_titles_and_descriptions(spark):
    rows = [(1, "t", "Same", "x", 0, 100), (2, "t", "other", "same", 1 << 50, 100), (3, "t", None, "", -1, 0), (4, "t", "", None, -1, 0), (5, "u", "same", None, 1 << 40, 900)]
    df = spark.createDataFrame(rows, "page long, page_type string, title string, description string, fingerprint long, words int")
    assert {r["page"]: r["component"] for r in duplicates.duplicate_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_finding_states_over_runs(spark):
    runs = spark.createDataFrame([("d", f"r{i}", i, "a" if i != 3 else "b", "1" if i < 5 else "2") for i in range(1, 6)], "domain string, run_id string, generated_at int, config_fp string, ruleset string")
    seen = {1: "xy", 2: "x", 3: "xyz", 4: "", 5: "x"}
    f = spark.createDataFrame([(f"r{i}", c) for i, cs in seen.items() for c in cs + cs[:1]], "run_id string, fingerprint string")
    got = {(r["run_id"], r["fingerprint"]): r["state"] for r in history.finding_deltas(runs, f).collect()}
    assert got == {("r2", "x"): "PERSISTING", ("r2", "y"): "RESOLVED", ("r3", "x"): "PERSISTING", ("r3", "y"): "REOPENED", ("r3", "z"): "OPENED", ("r4", "x"): "RESOLVED", ("r4", "y"): "RESOLVED", ("r4", "z"): "RESOLVED"}
    assert [r["comparison"] for r in history.run_sequence(runs).orderBy("n").collect()] == ["BASELINE", "COMPARABLE", "PARTIAL", "PARTIAL", "NOT_COMPARABLE"]


def test_history_rules():
    a = AuditConfig(max_pages=10)
    assert history.config_fingerprint(a.settings()) == history.config_fingerprint(AuditConfig(max_pages=10, concurrency=8, user_agent="x").settings())
    assert history.config_fingerprint(a.settings()) != history.config_fingerprint(AuditConfig().settings())
    assert history.scan_type(a.settings()) == "QUICK" and history.scan_type(AuditConfig(page_speed=True).settings()) == "FULL" and history.scan_type(AuditConfig().settings()) == "CUSTOM"
    for bad in ({"start_url": "ftp://x"}, {"max_pages": 0}, {"max_keywords": 5001}, {"max_rankings": 101}, {"max_depth": 51}, {"external_depth": 4}):
        with pytest.raises(ValueError):
            AuditConfig(**bad)


def test_priorities_and_health(spark):
    rows = [(p, 0, "thin_content", "geo", "warning", "m") for p in range(5)] + [(9, 0, "title_missing", "seo", "critical", "m"), (9, 1, "note", "seo", "info", "m")]
    f = spark.createDataFrame(rows, "page long, ordinal int, rule string, category string, severity string, message string")
    got = [(r["rule"], r["impact"], r["effort"]) for r in findings.priorities(f, 10).orderBy("rank").collect()]
    assert got == [("thin_content", "high", "high"), ("title_missing", "high", "low"), ("note", "low", "low")]
    assert findings.health(f, spark.range(10)).collect()[0]["label"] == "critical"


def test_numbers_and_images(spark):
    df = spark.createDataFrame([("1,234",), ("12.5%",), ("n/a",), (None,)], "c string")
    assert [r["x"] for r in df.select(enrich.number(F.col("c")).alias("x")).collect()] == [1234.0, 12.5, 0.0, 0.0]
    assert [r["x"] for r in df.select(enrich.rate(F.col("c")).alias("x")).collect()] == [1234.0, 0.125, 0.0, 0.0]
    empty = spark.createDataFrame([], "sessions long, engaged long, bounce double")
    assert enrich.engagement_totals(empty).collect()[0]["bounce_rate"] is None
