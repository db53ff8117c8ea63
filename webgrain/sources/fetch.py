"""A crawl as a Spark data source: frontier levels fetched by a function that the caller gives.

spark.dataSource.register(FetchSource) lets spark.read.format("webgrain_fetch") read a list of URLs with a fetcher named
by module path; crawls of more than a list are `crawl`, a loop of frontier joins over durable tables.
"""

from __future__ import annotations

import heapq
import importlib
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webgrain.config import AuditConfig
from webgrain.functions.urls import bucket, crawl_form, private_host, same_host
from webgrain.jobs import Job
from webgrain.operators.crawl_rules import before_fetching, level_ceiling
from webgrain.sources.html import extract
from webgrain.sources.site import MAX_SITEMAPS, sitemap_entries, with_allowed
from webgrain.staging import fresh_path, staged

FETCH_SCHEMA = (
    "url string, final_url string, status int, content_type string, html string, chain array<string>, error string, "
    "statuses array<int>, response_ms double, headers map<string,string>"
)
NAMES = [c.split()[0] for c in FETCH_SCHEMA.split(", ")]
HOPS, TIMEOUT_S = 10, 30


def http_get(url: str, timeout: float = TIMEOUT_S, agent: str = "webgrain") -> dict:
    """One answer over HTTP, redirects not followed: status, location, content_type, headers, body."""
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return None

    try:
        answer = urllib.request.build_opener(Stay).open(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout)
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        headers = {k.lower(): v for k, v in answer.headers.items()}
        body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        return {
            "status": answer.status,
            "location": headers.get("location"),
            "content_type": headers.get("content-type"),
            "headers": headers,
            "body": body
        }


def follow(url: str, get: Callable[[str], dict], hops: int = HOPS) -> dict:
    """One URL through its redirects; loops and too many hops are errors. get(url): status, location, content_type, headers,
    body. The row has the status of each hop and the time that all took."""
    chain, at, statuses, begun = [url], url, [], time.monotonic()
    row = {
        "url": url,
        "final_url": url,
        "status": None,
        "content_type": None,
        "html": None,
        "chain": [],
        "error": None,
        "statuses": statuses,
        "response_ms": None,
        "headers": {}
    }
    try:
        for _ in range(hops + 1):
            r = get(at)
            statuses.append(r["status"])
            if not 300 <= r["status"] < 400 or not r.get("location"):
                row |= {
                    "status": r["status"], "content_type": r.get("content_type"), "html": r.get("body"), "headers": r.get("headers") or {}
                }
                return row | {"final_url": at, "chain": chain if len(chain) > 1 else [], "response_ms": 1000 * (time.monotonic() - begun)}
            at = urljoin(at, r["location"]).split("#")[0]
            if at in chain:
                raise ValueError("redirect loop: " + " > ".join([*chain, at]))
            chain.append(at)
        raise ValueError(f"more than {hops} redirects")
    except Exception as e:  # noqa: BLE001  whatever a fetcher raises is the row's error
        return row | {"final_url": at, "chain": chain, "error": str(e)}


class FetchSource(DataSource):
    """Options: urls (line-separated), fetcher ('module:function'), partitions."""

    @classmethod
    def name(cls) -> str:
        return "webgrain_fetch"

    def schema(self) -> str:
        return FETCH_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(self.options)


class FetchReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.fetcher, self.n = options["fetcher"], int(options.get("partitions", "8"))

    def partitions(self):
        return [InputPartition(self.urls[i :: self.n]) for i in range(min(self.n, len(self.urls)))] or [InputPartition([])]

    def read(self, partition) -> Iterator[tuple]:
        module, name = self.fetcher.split(":")
        get = getattr(importlib.import_module(module), name)
        for u in partition.value:
            yield tuple(follow(u, get).values())


#: Lanes, the largest first, that are dealt out by their size; smaller ones are dealt by hash.
SIZED_LANES = 10_000
#: New URLs of a level up to which they are broadcast to those seen before, which are then read but not shuffled.
BROADCAST_URLS = 200_000
ORIGIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def first_urls(urls: DataFrame, n: int, most: int) -> DataFrame:
    """The first `most` of n distinct urls (url), by a threshold: the last of them; rows stay where they are."""
    if n <= most:
        return urls
    last = urls.select("url").orderBy("url").limit(most).agg(F.max("url")).collect()[0][0]
    return urls.where(F.col("url") <= F.lit(last))


def by_host(urls: DataFrame, config: AuditConfig, robots: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """urls (url) as (url, origin, lane, turn), dealt out to be fetched; with robots (origin, robots), these are on the first
    row of each lane.

    A host's URLs are in config.concurrency lanes, and a lane is in one task, one URL after the other, so no host is asked
    more than that many things at once. A task takes its lanes in turns: while one rests, others are asked. Lanes are dealt
    by size over `tasks` tasks (as many as there are cores), the greatest first.
    """
    spark = urls.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    lane = F.pmod(F.xxhash64("url"), F.lit(config.concurrency)).cast("int")
    rows = urls.select("url", F.regexp_extract("url", ORIGIN, 0).alias("origin"), lane.alias("lane"))
    sizes = rows.groupBy("origin", "lane").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origin", "lane").limit(SIZED_LANES)
    load, placed = [(0, t) for t in range(tasks)], []
    for r in sizes.collect():
        n, t = heapq.heappop(load)
        heapq.heappush(load, (n + r["n"], t))
        placed.append((r["origin"], r["lane"], t))
    table = spark.createDataFrame(placed, "origin string, lane int, task int")
    dealt = rows.join(F.broadcast(table), ["origin", "lane"], "left")
    task = F.coalesce("task", F.pmod(F.xxhash64("origin", "lane"), F.lit(tasks)).cast("int"))
    turn = F.row_number().over(Window.partitionBy("origin", "lane").orderBy("url"))
    numbered = dealt.select("url", "origin", "lane", turn.alias("turn"), task.alias("task"))
    if robots is not None:
        key = F.when(F.col("turn") == 1, F.col("origin")).otherwise(F.concat(F.lit("-"), "url"))  # others match nothing
        told = robots.select(F.col("origin").alias("key"), "robots")
        numbered = numbered.withColumn("key", key).join(told, "key", "left").drop("key")
    return numbered.repartitionById(tasks, F.col("task")).sortWithinPartitions("turn", "origin", "lane").drop("task")


class Pace:
    """Keeps `delay` seconds between the beginnings of two requests of a lane."""

    def __init__(self, delay: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep, self.last = delay, clock, sleep, {}

    def wait(self, lane: tuple) -> None:
        if lane in self.last and (rest := self.last[lane] + self.delay - self.clock()) > 0:
            self.sleep(rest)
        self.last[lane] = self.clock()


def _run(get: Callable[[str], dict], internal: bool, delay: float, agent: str | None = None):
    """Rows of fetched URLs with the links on each page, of its own host or all. With an agent, the robots rules that come
    with the first row of each lane hold, and no HTML is kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, rules = Pace(delay), {}
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                url, origin = r["url"], r["origin"]
                may = None
                if agent is not None:
                    if origin not in rules:
                        rules[origin] = RobotFileParser()
                        rules[origin].parse((r["robots"] or "").splitlines())
                    may = rules[origin].can_fetch(agent, url)
                if may is False:
                    got = {n: None for n in NAMES} | {"url": url, "final_url": url, "error": "robots"}
                else:
                    pace.wait((origin, r["lane"]))
                    got = follow(url, get)
                html = got["html"]
                if agent is not None and not (is_html(got["content_type"]) and got["status"] and got["status"] < 300):
                    html = None
                page = extract(got["final_url"], html) if html else None
                targets = [x["url"] for x in page["links"] if x["internal"] or not internal] if page else []
                kept = {} if agent is None else {"html": None, "robots_allowed": may}
                rows.append(got | kept | {"targets": targets})
            yield pd.DataFrame(rows, columns=[*NAMES, *([] if agent is None else ["robots_allowed"]), "targets"])

    return run


def is_html(content_type: str | None) -> bool:
    return (content_type or "").startswith(("text/html", "application/xhtml+xml"))


FETCHED = FETCH_SCHEMA + ", targets array<string>"
CRAWLED = FETCHED + ", reason string, allowed boolean, level int"


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """The found URLs (url, distinct) that seen (url) lacks. Seen ones are read, and shuffled only if too many were found."""
    found = staged(found, "crawl-found")
    if found.count() > BROADCAST_URLS:
        return found.join(seen, "url", "left_anti")
    known = seen.join(F.broadcast(found), "url", "left_semi")
    return found.join(known, "url", "left_anti")


def crawl(
    spark: SparkSession,
    start: list[str],
    get: Callable[[str], dict],
    *,
    config: AuditConfig | None = None,
    robots: dict[str, str] | None = None,
    sitemap: DataFrame | None = None,
    max_pages: int | None = None,
    max_levels: int | None = None,
    job: Job | None = None,
) -> DataFrame:
    """Fetched rows (FETCH_SCHEMA, level, ordinal, reason, allowed) from the start URLs, and those of a sitemap (url), over
    internal links, breadth first, each URL once in crawl form.

    config: its excluded paths, archives, depth and path ceilings hold before a URL is fetched; concurrency bounds what a host
    is asked at once, delay_ms the pause in each lane (see by_host); robots: rules by origin. What they leave out is a
    row with its reason and nothing fetched. max_pages bounds what is fetched, in the order of levels and URLs (of config,
    if not given). The loop ends when no new URL is found; with max_levels, URLs beyond raise.
    job: asked between levels, so that a crawl can be paused or cancelled; what was fetched until then is returned.

    A level is a folder of one table. Its ceilings come from counts by path, and earlier rows are only read for their URLs.
    """
    config = config or AuditConfig(start_url=start[0], max_depth=None, max_urls_per_path=10**9)
    left = max_pages if max_pages is not None else config.max_pages
    most = left
    first = spark.createDataFrame([(u,) for u in start], "url string")
    if sitemap is not None:
        first = first.unionByName(sitemap.select("url"))
    form = lambda df: df.select(crawl_form(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    path = fresh_path(spark, "crawl-rows")
    rows = lambda: spark.read.schema(CRAWLED).parquet(path)
    todo, counted, level, total = form(first), None, 0, 0
    while True:
        if max_levels is not None and level > max_levels:
            if todo.isEmpty():
                break
            raise RuntimeError(f"URLs lie deeper than {max_levels} levels")
        placed = todo.withColumn("bucket", bucket(F.col("url"))).withColumn("reason", before_fetching(config, F.col("url")))
        marked, counts = level_ceiling(placed.where("reason IS NULL"), counted, config.max_urls_per_path)
        counted = staged(counts, "crawl-counts")
        judged = marked.unionByName(placed.where("reason IS NOT NULL"), allowMissingColumns=True)
        judged = with_allowed(judged, robots or {}, config.user_agent)
        reason = F.coalesce("reason", F.when(F.col("over"), "bucket_full"), F.when(~F.col("allowed"), "robots"))
        here = staged(judged.select("url", reason.alias("reason"), "allowed"), "crawl-level")
        wanted = here.where("reason IS NULL").select("url")
        n, every = here.agg(F.count_if(F.col("reason").isNull()), F.count("*")).collect()[0]
        chosen = wanted if left is None else first_urls(wanted, n, left)
        shut, n = every - n, n if left is None else min(n, left)
        fetched = by_host(chosen, config).mapInPandas(_run(get, True, config.delay_ms / 1000), FETCHED)
        got = here.drop("reason").join(fetched, "url").withColumn("reason", F.lit(None).cast("string"))
        names = [f.split()[0] for f in CRAWLED.split(", ")[:-1]]
        closed = here.where("reason IS NOT NULL")
        got.unionByName(closed, allowMissingColumns=True).select(names).write.parquet(f"{path}/level={level}")
        left = None if left is None else left - n
        total += n + shut
        if job is not None:
            job.progress(total, 0, most)
        if left == 0 or (job is not None and not job.go_on()) or config.sitemap_only or not n:
            break
        targets = rows().where(F.col("level") == level).select(F.explode("targets").alias("url"))
        todo = staged(unseen(form(targets), rows().select("url")), "crawl-frontier")
        level += 1
        if todo.isEmpty():
            break
    return rows().withColumn("ordinal", F.struct("level", "url"))


def listed_sitemaps(robots: str, start_url: str) -> list[str]:
    """The sitemaps that robots rules name; if they name none, the usual place."""
    named = [line.split(":", 1)[1].strip() for line in robots.splitlines() if line.lower().startswith("sitemap:")]
    return [u for u in named if u] or ["/".join(start_url.split("/")[:3]) + "/sitemap.xml"]


def sitemap_files(
    spark: SparkSession, start: list[str], get: Callable[[str], dict], config: AuditConfig, *, most: int = MAX_SITEMAPS
) -> DataFrame:
    """(url, status, xml) of the sitemaps from start on, through indexes; each is read once, at most `most` in all. Those named
    beyond them are rows without a status."""
    shape = "url string, status int, xml string"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(config.delay_ms / 1000)
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                pace.wait((r["origin"], r["lane"]))
                got = follow(r["url"], get)
                rows.append((r["url"], got["status"], got["html"] if got["status"] == 200 else None))
            yield pd.DataFrame(rows, columns=["url", "status", "xml"])

    files, todo, seen = spark.createDataFrame([], shape), sorted(set(start)), set()
    while todo:
        now, beyond = todo[: most - len(seen)], todo[most - len(seen) :]
        seen |= set(todo)
        if beyond:
            files = files.unionByName(spark.createDataFrame([(u, None, None) for u in beyond], shape))
        if not now:
            break
        got = staged(by_host(spark.createDataFrame([(u,) for u in now], "url string"), config).mapInPandas(read, shape), "sitemaps")
        files = files.unionByName(got)
        named = sitemap_entries(got).where("kind = 'index'").select(F.explode("locations").alias("u")).distinct()
        named = named.join(spark.createDataFrame([(u,) for u in seen], "u string"), "u", "left_anti")
        todo = [] if len(seen) > most else [r["u"] for r in named.orderBy("u").limit(2 * most).collect()]
    return files


ROBOTS = "origin string, robots string"


def robots_of(urls: DataFrame, get: Callable[[str], dict], config: AuditConfig, known: DataFrame | None = None) -> DataFrame:
    """(origin, robots) for the origins of urls (url) and those known: each origin is asked once; no answer allows all."""
    origins = urls.select(F.regexp_extract("url", ORIGIN, 0).alias("origin")).distinct()
    if known is not None:
        origins = origins.join(known.select("origin"), "origin", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [follow(u, get) for u in f["url"]]
            told = [(r["html"] or "") if r["status"] == 200 else "" for r in got]
            yield pd.DataFrame({"origin": f["origin"], "robots": told})

    asked = by_host(origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url")), config).mapInPandas(ask, ROBOTS)
    return staged(asked if known is None else asked.unionByName(known), "external-robots")


def external_checks(links: DataFrame, get: Callable[[str], dict], config: AuditConfig) -> DataFrame:
    """Fetched rows of external link targets (links: source, target, internal), with depth, robots_allowed and the sorted
    sources that link to each; HTML pages found are read for more links down to config.external_depth.

    At most config.max_external_pages are fetched, in the order of depth and URL. Each URL counts once, in crawl form;
    private hosts are left out; each origin's robots rules are read through get, once. Hosts are asked in tasks of their own,
    at the pace of config (see by_host).
    """
    spark = links.sparkSession
    shape = links.where("NOT internal").select(F.col("source"), crawl_form(F.col("target")).alias("url"))
    outside = ~private_host(F.col("url")) & ~same_host(F.col("url"), F.lit(config.start_url))
    edges = staged(shape.where(F.col("url").isNotNull() & outside).distinct(), "external-edges")
    done, rules, left = None, None, config.max_external_pages
    run = _run(get, False, config.delay_ms / 1000, config.user_agent)
    checked = FETCH_SCHEMA + ", robots_allowed boolean, targets array<string>"
    every = edges
    for depth in range(1, config.external_depth + 1):
        todo = every.select("url").distinct()
        todo = staged(todo if done is None else unseen(todo, done.select("url")), "external-todo")
        n = todo.count()
        chosen = first_urls(todo, n, left)
        rules = robots_of(chosen, get, config, rules)
        got = by_host(chosen, config, rules).mapInPandas(run, checked)
        got = staged(got.withColumn("depth", F.lit(depth)), "external-level")
        n = min(n, left)
        done = got if done is None else done.unionByName(got)
        left -= n
        if not n or left <= 0:
            break
        more = got.select(
            F.col("url").alias("source"), F.explode("targets").alias("t")
        ).select("source", crawl_form(F.col("t")).alias("url"))
        every = staged(every.unionByName(more.where(F.col("url").isNotNull() & outside)).distinct(), "external-edges")
    if done is None:
        return spark.createDataFrame([], FETCH_SCHEMA + ", robots_allowed boolean, depth int, sources array<string>")
    sources = every.groupBy("url").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return done.drop("targets").join(sources, "url", "left")
