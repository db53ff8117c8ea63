"""A whole audit of a small site, end to end: every reason to leave a URL out, site findings, merges and the summary."""

import functools
import json

import pytest
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.operators import crawl_rules, graph, history, keywords, structure
from webgrain.session import AuditSession
from webgrain.sources import exports, fetch

HOST = "https://a.example"
BODY = "Plain words about red shoes and how they are made by hand in a small town near the sea. " * 14


def page(title, links=(), head="", body=BODY):
    anchors = "".join(f'<a href="{u}">to {u}</a>' for u in links)
    return {"status": 200, "content_type": "text/html; charset=utf-8", "body": f"<html lang=en><head><title>{title}</title>{head}</head><body><h1>{title}</h1><p>{body}</p>{anchors}</body></html>"}


SITE = {
    "/": page("Home of shoes", ["/a", "/old", "/gone", "/private/x", "/blog/one", "/tag/red", "/file.pdf", "/away", "/hidden", "/a/", "https://other.example/z", "/deep/1/2/3", "https://x.com/share", "/loop", "/r/1", "/r/2", "/r/3"]),
    "/a": page("Red shoes", ["/b", "/gone"], '<link rel="canonical" href="/b">'),
    "/a/": {"status": 301, "location": "/a"},
    "/b": page("Blue shoes", ["/c"], '<link rel="canonical" href="/c">', BODY + "Blue ones too."),
    "/c": page("Green shoes", ["/d", "/c?x=1", "/c?x=2"], '<link rel="canonical" href="/gone">', "Other text. " + BODY),
    "/c?x=1": page("Green one", (), '<link rel="canonical" href="/c">', "one " * 300),
    "/c?x=2": page("Green two", (), "", "two " * 300),
    "/d": page("Dark shoes", ["/e"], "", "dark " * 300),
    "/e": page("End", ["/"], "", "end " * 300),
    "/old": {"status": 301, "location": "/older"},
    "/older": {"status": 301, "location": "/a"},
    "/loop": {"status": 302, "location": "/loop"},
    "/blog/one": page("Blog"),
    "/tag/red": page("Tag"),
    "/file.pdf": {"status": 200, "content_type": "application/pdf", "body": "x"},
    "/away": {"status": 302, "location": "https://other.example/z"},
    "/hidden": page("Hidden", (), '<meta name="robots" content="noindex, follow">'),
    "/r/1": page("Red shoes", (), "", "r1 " * 300), "/r/2": page("R two", (), "", "r2 " * 300), "/r/3": page("R three", (), "", "r3 " * 300),
    "/lonely": page("Lonely", (), "", "alone " * 300),
}


def fetcher():
    """A closure, so that workers needn't import this file."""
    site, host, elsewhere = dict(SITE), HOST, page("Elsewhere", ["https://third.example/"])
    none = {"status": 404, "content_type": "text/html", "body": "none"}
    return lambda url: site.get(url.removeprefix(host) or "/", none) if url.startswith(host) else elsewhere if url == "https://other.example/z" else none


CONFIG = AuditConfig(start_url=f"{HOST}/", exclude_paths=("/blog",), exclude_archives=True, max_depth=3, max_urls_per_path=10, external_depth=2)
ROBOTS = {HOST: "User-agent: *\nDisallow: /private/"}
SITEMAP = [(f"{HOST}/sitemap.xml", 200, f"<urlset><url><loc>{HOST}/lonely</loc></url><url><loc>{HOST}/a</loc></url><url><loc>{HOST}/hidden</loc></url><url><loc>https://third.example/</loc></url></urlset>")]


@functools.cache
def whole_report(spark):
    sitemaps = spark.createDataFrame(SITEMAP, "url string, status int, xml string")
    listed = spark.createDataFrame([(f"{HOST}/lonely",)], "url string")
    log = fetch.crawl(spark, [f"{HOST}/"], fetcher(), config=CONFIG, robots=ROBOTS, sitemap=listed)
    search = spark.createDataFrame([("Red Shoes", f"{HOST}/a", 5.0, 100.0, 0.05, 2.0, 1), ("red shoes", f"{HOST}/b", 1.0, 300.0, 0.0, 6.0, 2), ("new query", None, 0.0, 50.0, 0.0, 9.0, 3)], "query string, page string, clicks double, impressions double, ctr double, position double, ordinal long")
    search = search.withColumn("query", F.lower("query"))
    analytics = spark.createDataFrame([("/a/", 1.0, 7.0, 1), ("/a", 9.0, 8.0, 2), ("/nowhere", 3.0, 3.0, 3)], "page string, sessions double, users double, ordinal long")
    performance = spark.createDataFrame([(f"{HOST}/a", 2.0, 0.1, None, 30.0), (f"{HOST}/b", 4.0, None, 200.0, None)], "url string, lab_lcp double, lab_cls double, field_inp double, lab_tbt double")
    rankings = spark.createDataFrame([("red shoes", 3)], "keyword string, position int")
    found = AuditSession(spark, CONFIG).run(log, robots=ROBOTS, sitemaps=sitemaps, search=search, analytics=analytics, rankings=rankings, performance=performance)
    return {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in found.items()}


@pytest.fixture
def report(spark):
    return whole_report(spark)


def test_reasons(report):
    reasons = {r["url"].removeprefix(HOST): r["reason"] for r in report["excluded"]}
    assert reasons == {
        "/blog/one": "configured", "/tag/red": "archive", "/deep/1/2/3": "too_deep", "/private/x": "robots", "/away": "off_domain",
        "/file.pdf": "not_html", "/hidden": "noindex", "/gone": "http_status", "/loop": "fetch_error",
    }
    assert {r["url"].removeprefix(HOST) for r in report["pages"]} == {"/", "/a", "/b", "/c", "/c?x=1", "/c?x=2", "/d", "/e", "/lonely", "/r/1", "/r/2", "/r/3"}
    assert all(r["indexable"] and r["status"] == 200 for r in report["pages"])


def test_site_findings(report):
    by_rule = {}
    for r in report["findings"]:
        by_rule.setdefault(r["rule"], set()).add(r["url"].removeprefix(HOST))
    assert by_rule["deep_click_depth"] == {"/d", "/c?x=1", "/c?x=2", "/e"}
    assert {r["url"].removeprefix(HOST): r["depth"] for r in report["pages"]} == {"/": 0, "/a": 1, "/r/1": 1, "/r/2": 1, "/r/3": 1, "/b": 2, "/c": 3, "/d": 4, "/c?x=1": 4, "/c?x=2": 4, "/e": 5, "/lonely": None}
    assert by_rule["canonical_chain"] == {"/a", "/b", "/c?x=1"}
    assert by_rule["canonical_non_200"] == {"/c"}
    assert by_rule["near_duplicate_content"] >= {"/a", "/r/1"}
    assert "orphan_page" not in by_rule  # the crawl had a depth ceiling
    assert next(r for r in report["priorities"] if r["rule"] == "canonical_non_200")["impact"] == "high"


def test_tables(report):
    assert [(r["url"], r["final_url"], r["sources"]) for r in report["redirects"] if r["url"].endswith("/old")] == [(f"{HOST}/old", f"{HOST}/a", [f"{HOST}/"])]
    assert not any(r["url"].endswith("/a/") for r in report["redirects"])
    assert {(r["source"], r["target"]) for r in report["broken_links"]} == {(f"{HOST}/", f"{HOST}/gone"), (f"{HOST}/a", f"{HOST}/gone")}
    assert {r["target"] for r in report["external"]} == {"https://other.example/z", "https://x.com/share"}
    assert not any("x.com" in r["target"] for r in report["link_inventory"])
    a = next(r for r in report["pages"] if r["url"] == f"{HOST}/a")
    assert (a["sessions"], a["users"], a["listed"], a["incoming"]) == (9.0, 8.0, True, 1)  # link targets have no slash at the end
    assert [(r["keyword"], r["observed"], r["impressions"], r["ranking"]) for r in sorted(report["keywords"], key=lambda r: r["rank"])][:2] == [("red shoes", True, 400.0, 3), ("new query", True, 50.0, None)]
    assert next(r for r in report["search"] if r["query"] == "red shoes")["position"] == 5.0
    red = next(r for r in report["keywords"] if r["keyword"] == "red shoes")
    assert red["pages"][: len(red["page_scores"])] == [x["url"] for x in red["page_scores"]] and {f"{HOST}/a", f"{HOST}/b"} <= set(red["pages"])
    assert all(x["score_h"] >= 200 and x["places"] for x in red["page_scores"]) and red["ctr"] == 0.015 and red["confidence_h"] <= 98
    assert [(x["page"], x["impressions"], x["position"]) for x in red["page_metrics"]] == [(f"{HOST}/b", 300.0, 6.0), (f"{HOST}/a", 100.0, 2.0)]
    new = next(r for r in report["keywords"] if r["keyword"] == "new query")
    assert (new["pages"], new["page_metrics"], new["confidence_h"]) == ([], [], 100)
    assert len(report["search_pages"]) == 2 and report["crawler_access"][0]["allowed"]
    assert report["sitemaps"] == [{"url": f"{HOST}/sitemap.xml", "status": 200, "kind": "urlset", "entries": 3, "ok": True}]
    assert report["performance_means"] == [{"lcp": 3.0, "cls": 0.1, "inp": 200.0, "tbt": 30.0}]


def test_summary(report):
    s = report["summary"][0]
    assert (s["pages"], s["excluded"], s["orphan_pages"], s["blocked"], s["extra"], s["crawl_waste"]) == (12, 9, 0, 1, 2, 3)
    assert (s["sitemap_pages"], s["listed_pages"], s["canonical_non_200"], s["mixed_content_pages"]) == (3, 2, 1, 0)
    assert abs(s["indexable_rate"] - 200 / 3) < 1e-9 and s["canonical_self_rate"] == 0.0 and s["schema_coverage"] == 0.0
    d = report["document"][0]
    assert d["missing_titles"] == 0 and d["missing_descriptions"] == 12 and d["missing_canonicals"] == 8 and d["canonical_mismatches"] == 4
    assert report["health"][0]["label"] == "critical"


def test_external_checks(spark):
    links = spark.createDataFrame([("p", "https://other.example/z", False), ("q", "https://other.example/z#f", False), ("p", f"{HOST}/a", True), ("p", "http://127.0.0.1/x", False)], "source string, target string, internal boolean")
    got = {r["url"]: r for r in fetch.external_checks(links, fetcher(), CONFIG).collect()}
    assert set(got) == {"https://other.example/z", "https://third.example/"}
    assert got["https://other.example/z"]["sources"] == ["p", "q"] and got["https://third.example/"]["depth"] == 2 and got["https://third.example/"]["status"] == 404


def test_nothing_is_cut_silently(spark, tmp_path):
    keys = spark.createDataFrame([(i,) for i in range(30)], "key long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)], "source long, target long")
    assert max(r["depth"] for r in graph.click_depths(keys, edges, keys.where("key = 0")).collect()) == 29
    with pytest.raises(RuntimeError):
        graph.click_depths(keys, edges, keys.where("key = 0"), max_levels=2)
    assert graph.click_depths(keys, edges, keys.where("key = 0"), max_levels=29).where("depth IS NULL").count() == 0
    with pytest.raises(RuntimeError):
        fetch.crawl(spark, [f"{HOST}/"], fetcher(), max_levels=1)
    lines = ["a,note", *(f"# {i}" for i in range(250)), "Queries,Pages,Clicks,Impressions", "shoe,/x,1,2"]
    (tmp_path / "late.csv").write_text("\n".join(lines))
    rows = exports.read_export(spark, str(tmp_path / "late.csv"), exports.SEARCH_DIMENSIONS, exports.SEARCH_METRICS).collect()
    assert [(r["query"], r["page"], r["clicks"]) for r in rows] == [("shoe", "/x", "1")]


def test_ceiling_of_a_bucket(spark):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(30)], "n long, bucket string")
    over = {r["n"] for r in crawl_rules.bucket_ceiling(rows, "n", 5).where("over").collect()}
    x, y = [i for i in range(30) if i % 3], [i for i in range(30) if not i % 3]
    assert over == set(x[5:]) | set(y[5:])


def test_history_of_domains(spark):
    runs = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 2), ("b", "r3", 1)], "domain string, run_id string, generated_at int")
    deltas = spark.createDataFrame([("a", "r2", "f", "OPENED"), ("a", "r2", "e", "RESOLVED")], "domain string, run_id string, fingerprint string, state string")
    trend = {r["domain"]: r["runs"] for r in history.domain_trend(runs, deltas).collect()}
    assert [x["run_id"] for x in trend["a"]] == ["r1", "r2"] and [d["fingerprint"] for d in trend["a"][1]["deltas"]] == ["e", "f"]
    merges = spark.createDataFrame([("a", "b"), ("c", "b")], "source string, target string")
    left, log = history.delete_domain({"runs": runs, "merges": merges}, "a", "DELETE a", "me")
    assert [r["domain"] for r in left["runs"].collect()] == ["b"] and [r["source"] for r in left["merges"].collect()] == ["c"]
    assert [(r["action"], r["domain"], r["actor"]) for r in log.collect()] == [("DOMAIN_DELETED", "a", "me")] and json.loads(log.collect()[0]["details"])
    with pytest.raises(ValueError):
        history.delete_domain({"runs": runs}, "a", "yes")


def test_search_merge_and_periods(spark):
    rows = lambda q: spark.createDataFrame([(q, 1)], "query string, ordinal long")
    assert [r["query"] for r in exports.merge_search([rows("both")], [rows("one")]).collect()] == ["both"]
    assert [r["query"] for r in exports.merge_search([], [rows("one"), rows("two")]).orderBy("ordinal").collect()] == ["one", "two"]
    assert exports.chosen_period(None, None, {"start": 1}, {"start": 2}) == {"start": 1} and exports.chosen_period({"start": 0}, {"start": 1}) == {"start": 0}
    metrics = spark.createDataFrame([("q", "b", 1.0, 2.0, 0.5, 3.0), ("q", "a", 0.0, 1.0, 0.0, 4.0)], "query string, page string, clicks double, impressions double, ctr double, position double")
    got = keywords.with_page_metrics(spark.createDataFrame([("q",), ("r",)], "query string"), metrics).collect()
    assert {r["query"]: list(r["page_metrics"]) if r["page_metrics"] else None for r in got} == {"q": ["a", "b"], "r": None}


def test_clamped_settings():
    c = AuditConfig.clamped(max_depth=99, max_urls_per_path=1, max_keywords=0, delay_ms=9999)
    assert (c.max_depth, c.max_urls_per_path, c.max_keywords, c.delay_ms, c.max_pages) == (50, 10, 1, 2000, 50)


def test_summary_without_pages(spark):
    empty = spark.createDataFrame([], "depth int, orphan boolean, page_type string, has_schema boolean, listed boolean, canonical string, canonical_self boolean, chain boolean, bad_status int, heading_skip string, mixed boolean, content_age_days int")
    r = structure.summary(empty).collect()[0]
    assert (r["pages"], r["average_click_depth"], r["schema_coverage"]) == (0, None, None)


def test_views_and_files(spark, tmp_path):
    from webgrain import __main__ as cli
    from webgrain.sources import sinks

    cli.main([f"{HOST}/", str(tmp_path / "out"), "--max-depth", "3", "--exclude", "/blog", "--external-depth", "1"], spark, fetcher())
    read = lambda n: spark.read.csv(str(tmp_path / "out" / f"{n}.csv"), header=True, escape='"', multiLine=True)
    pages = {r["url"].removeprefix(HOST): r for r in read("pages").collect()}
    assert pages["/a"]["title"] == "Red shoes" and pages["/a"]["internal_links"] == "2" and pages["/"]["external_links"] == "2" and len(pages["/"]) > 40
    assert {r["kind"] for r in read("technical").collect()} == {"broken_link", "redirect", "external", "excluded"}
    assert any(r["text"] == "share buttons" for r in read("links").collect()) and read("keywords").columns[0] == "keyword"
    report = {n: spark.read.json(str(tmp_path / "out" / "report" / n)) for n in ("summary", "run")}
    assert report["run"].collect()[0]["domain"] == "a.example" and report["summary"].collect()[0]["pages"] == len(pages)
    assert sinks.flat(report["summary"]).count() == 1


def test_report_views(spark):
    log = fetch.crawl(spark, [f"{HOST}/"], fetcher(), config=CONFIG)
    performance = spark.createDataFrame([(f"{HOST}/a", 2.0, 0.1, None, 30.0)], "url string, lab_lcp double, lab_cls double, field_inp double, lab_tbt double")
    search = spark.createDataFrame([("red shoes", f"{HOST}/a", 5.0, 100.0, 0.05, 2.0, 1)], "query string, page string, clicks double, impressions double, ctr double, position double, ordinal long")
    analytics = spark.createDataFrame([("/a", 9.0, 8.0, 7.0, 0.0, 0.5, 2)], "page string, sessions double, users double, engaged double, key_events double, bounce double, ordinal long")
    report = AuditSession(spark, CONFIG).run(log, search=search, analytics=analytics, performance=performance)
    from webgrain.operators import views

    shown = views.report_views(report)
    assert set(shown) == {"executive", "priorities", "pages", "content", "technical", "readiness", "keywords", "images", "findings", "search", "analytics", "performance"}
    assert all(v.count() >= 0 for v in shown.values()) and shown["executive"].collect()[0]["sessions"] == 9.0
    assert views.document_keywords(report["keywords"]).first()["keyword"] == "red shoes"


def test_services(spark):
    from webgrain.operators import enrich, findings
    from webgrain.sources import services

    rows = [{"keys": [f"q{i}", "p"], "clicks": i, "impressions": 10, "ctr": 0.1, "position": 2} for i in range(7)]
    got = services.search_console_rows(spark, lambda first, limit, rows=rows: rows[first : first + limit], most=20, page=4).orderBy("ordinal").collect()
    assert [r["query"] for r in got] == [f"q{i}" for i in range(7)] and got[3]["clicks"] == 3.0
    asked = spark.createDataFrame([(i, f"u{i}") for i in range(4)], "ordinal long, url string")
    answers = {"u0": {"status": 200, "body": "{}"}, "u1": {"status": 500}, "u2": {"status": 429, "retry_after": "1"}, "u3": {"status": 200, "body": "{}"}}
    told = services.performance_reports(asked, lambda u, a=answers: a[u], wait=lambda s: None).orderBy("ordinal").collect()
    assert [(r["error_code"], r["skipped"]) for r in told] == [(None, False), ("http_500", False), ("rate_limited", False), ("skipped_after_rate_limit", True)]
    keys = spark.createDataFrame([("a",), ("b",)], "keyword string")
    ranked = services.lookup_rankings(keys, lambda k, d: {"position": 3, "ranking_url": d} if k == "a" else 1 / 0, "a.example").collect()
    assert [(r["keyword"], r["position"]) for r in ranked] == [("a", 3)]
    images = spark.createDataFrame([("i1", "x" * 9, "f.webp", 1, 0), ("i2", "y", "g.webp", 1, 1)], "src string, suggested_alt string, suggested_filename string, page long, n int")
    seen = services.image_analysis(images, lambda src: {"alt": "a" * 200, "description": "d"} if src == "i1" else 1 / 0)
    merged = {r["src"]: r for r in enrich.with_image_analysis(images, seen).collect()}
    assert len(merged["i1"]["suggested_alt"]) == 160 and merged["i1"]["suggested_filename"] == "f.webp" and merged["i1"]["basis"] == "vision" and merged["i2"]["basis"] == "page"
    inventory = spark.createDataFrame([("i1", 2), ("i9", 1)], "src string, pages long")
    assert {r["src"]: r["suggested_alt"] for r in enrich.with_advice(inventory, images).collect()} == {"i1": "x" * 9, "i9": None}
    found = spark.createDataFrame([(2, 0, "critical"), (1, 0, "warning"), (1, 1, "info")], "page int, ordinal int, severity string")
    assert [(r["page"], r["severity"]) for r in findings.leading_findings(found).collect()] == [(2, "critical"), (1, "warning")]


def test_stored_runs(spark, tmp_path):
    from webgrain.sources import store

    root = str(tmp_path)
    rows = lambda run, **kw: spark.createDataFrame([("a", run, *kw.values())], "domain string, run_id string, " + ", ".join(f"{k} string" for k in kw))
    store.save_run({"findings": rows("r1", fingerprint="f"), "runs": rows("r1", status="x")}, root)
    store.save_run({"findings": rows("r2", fingerprint="g")}, root)  # broke off before its row in runs
    assert [r["run_id"] for r in store.saved(spark, root, "findings").collect()] == ["r1"]
    store.save_report({"summary": rows("r1", v="1")}, root, "r1")
    assert store.stored_report(spark, root, "r1", ["summary"])["summary"].collect()[0]["v"] == "1"
    for bad in ("..", "../x", "."):
        with pytest.raises(ValueError):
            store.stored_report(spark, root, bad, ["summary"])


def test_job_states(spark):
    from webgrain.jobs import Job

    job = Job()
    with pytest.raises(ValueError):
        job.to("complete")
    job.to("running")
    assert job.go_on() and job.progress(5, 5)["percent"] == 47
    job.to("cancelled")
    got = fetch.crawl(spark, [f"{HOST}/"], fetcher(), job=job)
    assert {r["level"] for r in got.select("level").collect()} == {0}  # it ends after the level that it was in


def test_page_shows_passages_and_questions(spark):
    html = "<html><head><title>T</title></head><body><h1>What is it?</h1><p>" + "This is a passage of some fifty characters, more or less. " * 9 + "</p>" + "".join(f"<h2>How {i}</h2>" for i in range(20)) + "</body></html>"
    p = AuditSession(spark).pages(spark.createDataFrame([(1, f"{HOST}/", html), (2, f"{HOST}/x", "")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert len(p[0]["answer_passages"]) == 5 and p[0]["questions"][0] == "What is it?" and len(p[0]["questions"]) == 12
    assert p[0]["needs_rendering"] and p[1]["needs_rendering"] and p[1]["answer_passages"] == []
