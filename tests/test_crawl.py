"""Crawls whose fetches are dealt out by host, at a pace, and whose levels cost what is new on them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.operators import crawl_rules
from webgrain.sources import fetch


def page(*links):
    return {"status": 200, "content_type": "text/html", "body": "".join(f'<a href="{u}">x</a>' for u in links)}


def answers(sites):
    """A fetcher whose answers tell its task and the time."""

    def get(url):
        from pyspark import TaskContext

        told = {"task": str(TaskContext.get().partitionId()), "at": repr(time.monotonic())}
        return sites.get(url, {"status": 404}) | {"headers": told}

    return get


def many_hosts(n_hosts, n_pages):
    roots = [f"https://h{i}.example/" for i in range(n_hosts)]
    return {r: page(*[f"{r}p{j}" for j in range(n_pages)]) for r in roots} | {f"{r}p{j}": page() for r in roots for j in range(n_pages)}


def test_hosts_are_fetched_in_tasks_of_their_own(spark):
    sites = many_hosts(4, 6)
    roots = [u for u in sites if u.endswith(".example/")]
    config = AuditConfig(start_url=roots[0], concurrency=1, max_depth=None)
    rows = fetch.crawl(spark, roots, answers(sites), config=config, max_pages=15).collect()
    fetched = [r for r in rows if r["headers"]]
    assert len(fetched) == 15 and [r["level"] for r in fetched].count(0) == 4
    first = sorted(u for u in sites if u not in roots)[:11]
    assert sorted(r["url"] for r in fetched if r["level"] == 1) == first  # the cap takes the first by URL
    for level in (0, 1):
        tasks = {}
        for r in fetched:
            if r["level"] == level:
                tasks.setdefault(r["url"].split("/")[2], set()).add(r["headers"]["task"])
        assert all(len(t) == 1 for t in tasks.values())  # a host with one lane is in one task
        assert len(set.union(*tasks.values())) == len(tasks)  # and each host in its own


def test_lanes_bound_what_a_host_is_asked_at_once(spark):
    sites = many_hosts(1, 40)
    urls = spark.createDataFrame([(u,) for u in sites], "url string").repartition(7)
    for lanes in (1, 2, 3):
        dealt = fetch.by_host(urls, AuditConfig(concurrency=lanes), tasks=4).withColumn("task", F.spark_partition_id()).collect()
        assert len(dealt) == 41 and len({r["task"] for r in dealt}) == lanes
        assert all(len({x["task"] for x in dealt if x["lane"] == r["lane"]}) == 1 for r in dealt)


def test_lanes_beyond_the_sized_ones_are_dealt_by_hash(spark, monkeypatch):
    monkeypatch.setattr(fetch, "SIZED_LANES", 2)
    urls = spark.createDataFrame([(f"https://h{i % 30}.example/{i}",) for i in range(90)], "url string")
    dealt = fetch.by_host(urls, AuditConfig(concurrency=2), tasks=4).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["url"] for r in dealt) == sorted(r["url"] for r in urls.collect()) and {r["task"] for r in dealt} <= set(range(4))
    assert all(len({x["task"] for x in dealt if (x["origin"], x["lane"]) == (r["origin"], r["lane"])}) == 1 for r in dealt)


def test_delay_between_requests_of_a_lane(spark):
    sites = many_hosts(2, 4)
    roots = [u for u in sites if u.endswith(".example/")]
    config = AuditConfig(start_url=roots[0], concurrency=1, delay_ms=150, max_depth=None)
    rows = [r for r in fetch.crawl(spark, roots, answers(sites), config=config).collect() if r["level"] == 1]
    for host in ("h0", "h1"):
        at = sorted(float(r["headers"]["at"]) for r in rows if f"//{host}." in r["url"])
        assert len(at) == 4 and all(b - a >= 0.149 for a, b in zip(at, at[1:], strict=False))
    now = [0.0]
    pace = fetch.Pace(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for lane in ("a", "b", "a", "b", "a"):
        pace.wait((lane, 0))
    assert now[0] == 4.0  # lanes rest side by side


def chain(levels, width):
    """A site of some levels: each page links to the next, to a few on its own level, and back to all before."""
    at = lambda i, j: f"https://deep.example/s{j}/{i}"
    pages = {"https://deep.example/": page(*[at(0, j) for j in range(width)])}
    for i in range(levels):
        for j in range(width):
            ahead = [at(i + 1, j)] if i + 1 < levels else []
            pages[at(i, j)] = page(*ahead, at(i, 0), *[at(k, j) for k in range(i)], "https://deep.example/")
    return pages


def test_a_deep_site(spark):
    sites = chain(11, 1)
    rows = fetch.crawl(spark, ["https://deep.example/"], answers(sites)).select("url", "level", "reason").collect()
    assert len(rows) == 12 and {r["url"]: r["level"] for r in rows} == {
        "https://deep.example/": 0, **{f"https://deep.example/s0/{i}": i + 1 for i in range(11)}
    }


def plain_ceiling(levels, most):
    """What the ceiling says if all rows so far are ranked anew at each level."""
    held, out = {}, {}
    for rows in levels:
        for url, b in sorted(rows):
            held[b] = held.get(b, 0) + 1
            out[url] = held[b] > most
    return out


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_ceilings_by_counts_equal_those_of_all_rows(spark, most):
    rng = random.Random(most)
    urls = rng.sample([(f"u{i:03}", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)], 150)
    levels = [urls[:5], urls[5:80], urls[80:82], urls[82:], []]
    counted, got = None, {}
    for rows in levels:
        marked, counted = crawl_rules.level_ceiling(spark.createDataFrame(rows, "url string, bucket string"), counted, most)
        got |= {r["url"]: r["over"] for r in marked.collect()}
        counted = spark.createDataFrame(counted.collect(), "bucket string, held long")
    assert got == plain_ceiling(levels, most)
    assert {r["bucket"]: r["held"] for r in counted.collect()} == {b: min(most, sum(x == b for _, x in urls)) for b in {x for _, x in urls}}


def test_ceiling_of_a_crawl_over_levels(spark):
    sites = chain(6, 3)
    config = AuditConfig(start_url="https://deep.example/", max_urls_per_path=10, max_depth=None)
    sites["https://deep.example/s0/0"] = page(*[f"https://deep.example/s0/x{i:02}" for i in range(14)], "https://deep.example/s0/1")
    rows = fetch.crawl(spark, ["https://deep.example/"], answers(sites), config=config).collect()
    reasons = {r["url"].removeprefix("https://deep.example/"): r["reason"] for r in rows}
    assert [u for u in reasons if u.startswith("s0/") and reasons[u] is None].__len__() == 10
    assert {u for u, x in reasons.items() if x == "bucket_full"} == {f"s0/x{i:02}" for i in range(8, 14)} | {f"s0/{i}" for i in range(2, 6)}


def test_robots_are_asked_once_for_each_host(spark, tmp_path):
    hosts = [f"https://o{i}.example" for i in range(3)]
    links = [("p", f"{h}/{j}", False) for h in hosts for j in range(6)] + [("p", "https://o0.example/no", False)]
    log, answer = str(tmp_path), answers({f"{h}/0": page(f"{h}/more", "https://o9.example/") for h in hosts})

    def get(url):
        open(f"{log}/{time.monotonic_ns()}-{url.replace('/', '_')}", "w").close()
        if url.endswith("robots.txt"):
            return {"status": 200, "content_type": "text/plain", "body": "User-agent: *\nDisallow: /no"}
        return answer(url)

    config = AuditConfig(start_url="https://a.example/", external_depth=2, concurrency=2)
    frame = spark.createDataFrame(links, "source string, target string, internal boolean")
    got = {r["url"]: r for r in fetch.external_checks(frame, get, config).collect()}
    names = [p.name.split("-", 1)[1] for p in tmp_path.iterdir()]
    assert sorted(n for n in names if "robots" in n) == [f"https:__o{i}.example_robots.txt" for i in (0, 1, 2, 9)]
    assert got["https://o0.example/no"]["error"] == "robots" and "https:__o0.example_no" not in names
    assert got["https://o1.example/more"]["depth"] == 2 and len(names) == len(set(names))
    tasks = {r["headers"]["task"] for r in got.values() if r["headers"] and r["depth"] == 1}
    assert len(tasks) == 4  # as many as there are cores, for six lanes


def test_sitemaps_are_read_through_indexes_and_those_left_are_told(spark):
    at = "https://a.example"
    listing = lambda kind, *urls: {"status": 200, "body": f"<{kind}>" + "".join(f"<loc>{u}</loc>" for u in urls) + f"</{kind}>"}
    sites = {
        f"{at}/sitemap.xml": listing("sitemapindex", f"{at}/m1.xml", f"{at}/m2.xml", f"{at}/sitemap.xml"),
        f"{at}/m1.xml": listing("urlset", f"{at}/lonely"), f"{at}/m2.xml": listing("sitemapindex", f"{at}/m3.xml", f"{at}/m4.xml"),
        f"{at}/m3.xml": listing("urlset", f"{at}/other"),
    }
    config = AuditConfig(start_url=f"{at}/")
    read = lambda most: {r["url"].removeprefix(at): r["status"] for r in fetch.sitemap_files(spark, [f"{at}/sitemap.xml"], answers(sites), config, most=most).collect()}
    assert read(100) == {"/sitemap.xml": 200, "/m1.xml": 200, "/m2.xml": 200, "/m3.xml": 200, "/m4.xml": 404}
    assert read(4) == {"/sitemap.xml": 200, "/m1.xml": 200, "/m2.xml": 200, "/m3.xml": 200, "/m4.xml": None}
    assert fetch.listed_sitemaps("User-agent: *\nSITEMAP: https://a.example/x.xml\nSitemap:\n", f"{at}/p") == [f"{at}/x.xml"]
    assert fetch.listed_sitemaps("", f"{at}/p") == [f"{at}/sitemap.xml"]
