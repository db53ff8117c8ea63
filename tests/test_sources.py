"""The HTML pass, exports, site files, fetching, sinks and the streaming frontier on fixtures of our own."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from webgrain.session import AuditSession
from webgrain.sources import exports, fetch, html, site, sinks
from webgrain.streaming import frontier

PAGE = """<!doctype html><html lang="de"><head><title> Shoe
 guide </title><meta name="Description" content="All about shoes"><meta name="viewport" content="x">
<meta name="robots" content="noindex, nosnippet"><meta property="article:published_time" content="2020-02-03">
<link rel="canonical" href="/guide/"><link rel="stylesheet" href="http://cdn.example/a.css">
<script type="application/ld+json">{"@graph":[{"@type":"Article","headline":"H","author":""}]}</script>
<script type="application/ld+json">{"@type":"Product",}</script></head>
<body><header><a class="btn" href="/shop?utm_source=x">Shop now</a></header><main><h1>Shoes</h1><p>One<p>Two
<h3>How do they fit?</h3><a href="#x">Skip to content</a><a href="http://other.example/a"><img src="/img/IMG_0001.jpg"></a>
<a href="/b" aria-label="Labelled"></a><ul><li>a<li>b</ul><b>In 2019 42% grew, according to a study.</main><style>p{}</style></body></html>"""


def test_extraction():
    p = html.extract("https://a.example/guide", PAGE)
    assert (p["title"], p["description"], p["lang"], p["has_viewport"]) == ("Shoe guide", "All about shoes", "de", True)
    assert p["canonical"] == "https://a.example/guide" and p["robots"] == ["noindex", "nosnippet"] and p["published"] == "2020-02-03"
    assert [(h["level"], h["text"]) for h in p["headings"]] == [(1, "Shoes"), (3, "How do they fit?")] and p["heading_skip"] == "H1 to H3"
    assert [(x["text"], x["url"], x["internal"]) for x in p["links"]] == [("Shop now", "https://a.example/shop", True), ("", "http://other.example/a", False), ("Labelled", "https://a.example/b", True)]
    assert [s["valid"] for s in p["schemas"]] == [True, False] and p["schemas"][0]["issues"] == ["Article: author", "Article: datePublished"] and "line 1" in p["schemas"][1]["error"]
    assert p["action"]["url"] == "https://a.example/shop" and p["action"]["score"] == 8 and p["insecure"] == ["http://cdn.example/a.css"]
    assert p["paragraphs"] == 2 and p["list_count"] == 1 and p["cited_claims"] == 1 and p["question_headings"] == 1
    assert p["images"][0]["filename"] == "IMG_0001.jpg" and p["images"][0]["poor_name"] and p["images_without_alt"] == 1
    assert "p{}" not in p["text"] and p["text"].startswith("ShoesOne")
    assert html.extract("https://a.example/", None)["title"] == ""


def test_findings_of_a_page(spark):
    pages = spark.createDataFrame([(1, "https://a.example/guide", PAGE), (2, "https://a.example/category/x", "<p>hi"), (3, None, None)], "page_id long, url string, html string")
    got = {(r["page_id"], r["rule"]) for r in AuditSession(spark).findings(pages).collect()}
    assert {(1, "schema_invalid_json"), (1, "schema_missing_core_property"), (1, "image_alt_missing"), (1, "mixed_content"), (1, "heading_hierarchy_skipped"), (1, "thin_content"), (1, "content_stale"), (1, "aio_accessibility")} <= got
    assert (2, "indexable_archive_review") in got and (2, "thin_content") not in got and (2, "title_missing") in got
    assert AuditSession(spark).link_metrics(pages.where("page_id < 3")).count() == 2


SEARCH = '# made by a tool\n\nTop queries,Top pages,Clicks,Impressions,CTR,Position\n"red, blue shoe",https://a.example/,3,"1,000",0.3%,4.5\nsite:a.example,,1,2,50%,1\nshoe,,0,10,0%,9\n'


def test_search_export(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SEARCH)
    raw = exports.read_export(spark, str(tmp_path / "s.csv"), exports.SEARCH_DIMENSIONS, exports.SEARCH_METRICS)
    rows = [(r["query"], r["page"], r["clicks"], r["impressions"], r["ctr"]) for r in exports.search_rows(raw).orderBy("ordinal").collect()]
    assert rows == [("red, blue shoe", "https://a.example/", 3.0, 1000.0, 0.003), ("shoe", None, 0.0, 10.0, 0.0)]
    assert exports.combined(raw)
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    assert exports.read_export(spark, str(tmp_path / "none.csv"), exports.SEARCH_DIMENSIONS, exports.SEARCH_METRICS).count() == 0


def test_analytics_export_keeps_unknown_rates_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# Start date: 20240101\n# End date: 20240131\nLanding page,Sessions,Total users,Bounce rate\n/x,10,8,\n/y,5,5,40%\n")
    rows = exports.analytics_rows(exports.read_export(spark, str(tmp_path / "a.csv"), exports.ANALYTICS_DIMENSIONS, exports.ANALYTICS_METRICS)).orderBy("ordinal").collect()
    assert [(r["page"], r["sessions"], r["bounce"], r["engagement_rate"]) for r in rows] == [("/x", 10.0, None, None), ("/y", 5.0, 0.4, None)]


@pytest.mark.parametrize(
    ("text", "start", "end", "source"),
    [
        ('Filter,Value\nDate,"Jan 1, 2024 - Jan 31, 2024"\n', date(2024, 1, 1), date(2024, 1, 31), "filter"),
        ("# Start date: 20240101\n# End date: 20240131\nPage,Sessions\n/,1\n", date(2024, 1, 1), date(2024, 1, 31), "metadata"),
        ("Date,Clicks\n2024-03-02,1\n2024-03-01,4\n", date(2024, 3, 1), date(2024, 3, 2), "rows"),
        ("Filter,Value\nDate,Last three months\n", None, None, "label"),
    ],
)
def test_periods(text, start, end, source):
    got = exports.period(text, exports.SEARCH_DIMENSIONS)
    assert (got["start"], got["end"], got["source"]) == (start, end, source)


def test_site_files(spark):
    maps = [("https://a.example/m.xml", "<sitemapindex><sitemap><loc>https://a.example/n.xml</loc></sitemap></sitemapindex>"), ("https://a.example/n.xml", "<urlset xmlns='x'><url><loc> https://a.example/p?a=1&amp;b=2 </loc></url><url><loc>ftp://x</loc></url></urlset>"), ("https://a.example/z.xml", None)]
    files = spark.createDataFrame(maps, "url string, xml string")
    got = {r["url"]: (r["kind"], r["locations"]) for r in site.reachable_sitemaps(files, ["https://a.example/m.xml"]).collect()}
    assert got == {"https://a.example/m.xml": ("index", ["https://a.example/n.xml"]), "https://a.example/n.xml": ("urlset", ["https://a.example/p?a=1&b=2"])}
    rules = {"https://a.example": "User-agent: *\nDisallow: /private\nUser-agent: GPTBot\nDisallow: /"}
    assert site.allowed(rules, "https://a.example/x", "any") and not site.allowed(rules, "https://a.example/private/x", "any") and not site.allowed(rules, "https://a.example/x", "GPTBot")
    urls = spark.createDataFrame([("https://a.example/private",), ("https://b.example/private",)], "url string")
    assert [r["allowed"] for r in site.with_allowed(urls, rules, "any").orderBy("url").collect()] == [False, True]
    assert [c["allowed"] for c in site.crawler_access(rules, "https://a.example/")] == [True, False, True, True, True]
    assert [site.retry_wait(*x) for x in ((0, "90"), (1, None), (9, "x"))] == [60.0, 5.0, 30.0]


def test_performance_reports(spark):
    body = '{"lighthouseResult":{"categories":{"performance":{"score":0.855}},"audits":{"total-blocking-time":{"numericValue":12.5}}},"loadingExperience":{"metrics":{"INTERACTION_TO_NEXT_PAINT":{"percentile":210}}}}'
    r = site.performance(spark.createDataFrame([(1, body), (2, "{}")], "k long, b string"), "k", "b").orderBy("k").collect()
    assert (r[0]["performance"], r[0]["lab_tbt"], r[0]["field_inp"], r[0]["lab_lcp"]) == (86, 12.5, 210.0, None) and r[1]["performance"] is None
    q = spark.createDataFrame([(1, False), (2, True), (3, False)], "o long, l boolean")
    assert [x["skipped"] for x in site.skipped_after_limit(q, "o", "l").orderBy("o").collect()] == [False, False, True]


SITE = {
    "https://a.example/": {"status": 200, "body": '<a href="/x">x</a><a href="/old">o</a><a href="/loop">l</a>'},
    "https://a.example/x": {"status": 200, "body": '<a href="/">home</a>'},
    "https://a.example/old": {"status": 301, "location": "https://a.example/x"},
    "https://a.example/loop": {"status": 302, "location": "https://a.example/loop2"},
    "https://a.example/loop2": {"status": 302, "location": "https://a.example/loop"},
}


def test_crawl_with_a_given_fetcher(spark):
    site = dict(SITE)
    get = lambda url: site.get(url, {"status": 404, "body": ""})
    got = {r["url"]: (r["final_url"], r["status"], r["level"]) for r in fetch.crawl(spark, ["https://a.example/"], get).collect()}
    assert got["https://a.example/"] == ("https://a.example/", 200, 0) and got["https://a.example/old"] == ("https://a.example/x", 200, 1)
    assert got["https://a.example/loop"][1] is None and len(got) == 4
    assert fetch.crawl(spark, ["https://a.example/"], get, max_pages=2).count() == 2


def test_sinks(spark, tmp_path):
    links = spark.createDataFrame([("p", "a", "https://x.com/share", False), ("p", "b", "https://netflix.com/", False), ("q", "c", "https://a.example/", True)], "source string, text string, target string, internal boolean")
    out = sinks.link_rows(links, F.regexp_extract("target", "//([^/]+)", 1))
    assert sorted(r["text"] for r in out.collect()) == ["b", "c", "share buttons"]
    sinks.write_csv(spark.createDataFrame([(1, ["a", 'b"c'])], "k long, v array<string>"), str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True, escape='"').collect()[0]["v"] == 'a | b"c'


def test_stream_drops_seen_urls(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.example/x?b=1&a=2",), ("https://a.example/x?a=2&b=1#f",), ("mailto:x",), (None,)], "url string")
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: frontier.drain(frontier.new_urls(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "mark"))
    run()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
