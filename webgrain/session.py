"""AuditSession: page snapshots in, report tables out. Each table is a lazy DataFrame; pages are extracted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.functions import text as tx
from webgrain.functions import urls as ur
from webgrain.operators import crawl_rules as rules
from webgrain.operators import duplicates, enrich, graph, keywords, structure, suggestions
from webgrain.operators import findings as fi
from webgrain.sources import site
from webgrain.sources.html import QUESTION, extract_pages
from webgrain.staging import staged

#: Answer passages and question headings of a page that are told.
MOST_PASSAGES, MOST_QUESTIONS = 5, 12


class AuditSession:
    def __init__(self, spark: SparkSession, config: AuditConfig | None = None):
        self.spark, self.config = spark, config or AuditConfig()

    def pages(self, snapshots: DataFrame, as_of: str = "2026-01-01") -> DataFrame:
        """Extracted pages (snapshots: page_id, url, html) with measures, dimensions of answer readiness and rule inputs."""
        p = extract_pages(snapshots.select("page_id", "url", "html", *(["headers"] if "headers" in snapshots.columns else [])))
        texts = lambda n: F.transform(F.filter("headings", lambda h: h["level"] == n), lambda h: h["text"])
        day = lambda c: F.coalesce(
            F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")), F.try_to_timestamp(c)
        )
        read = tx.readability(F.col("text"))
        p = p.withColumns(
            {
                "h1s": texts(1),
                "h2s": texts(2),
                "r": read,
                "page_type": ur.page_type(F.col("url"), F.col("has_article")),
                "content_date": F.coalesce("modified", "published")
            }
        )
        p = p.withColumns({"words": F.col("r.words"), "grade": F.col("r.grade"), "words_per_sentence": F.col("r.words_per_sentence")})
        p = p.withColumn("content_age_days", F.greatest(F.lit(0), F.datediff(F.to_date(F.lit(as_of)), day(F.col("content_date")))))
        types = F.flatten(F.transform("schemas", lambda s: s["types"]))
        external = F.size(F.array_distinct(F.transform(F.filter("links", lambda x: ~x["internal"]), lambda x: x["url"])))
        signals = {
            "blocked": F.array_contains("robots", "nosnippet") | F.array_contains("robots", "max-snippet:0"),
            "has_passage": F.exists(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.length(s).between(45, 320)),
            "h2_count": F.size("h2s"),
            "question_headings": F.col("question_headings"),
            "lists_or_tables": F.col("list_count") + F.col("table_count"),
            "external_links": external,
            "cited_claims": F.col("cited_claims"),
            "has_author": F.col("has_author"),
            "has_published": F.col("published").isNotNull(),
            "has_modified": F.col("modified").isNotNull() & ~F.col("modified").eqNullSafe(F.col("last_modified")),
            "has_last_modified": F.col("last_modified").isNotNull(),
            "has_title_h1": (F.col("title") != "") & (F.size("h1s") > 0),
            "has_schema": F.size("schemas") > 0,
            "has_description": F.col("description") != "",
            "has_core_entity": F.exists(types, lambda t: t.rlike("(?i)organization|service|product|person|localbusiness|article")),
            "words": F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")),
            "follow_up": F.col("follow_up"),
            "images": F.col("image_count"),
            "images_without_alt": F.col("images_without_alt"),
        }
        shell = {
            "body_chars": F.length("text"),
            "has_structure": F.exists("headings", lambda h: h["level"] <= 2) | F.col("has_article") | F.col("has_main"),
            "link_count": F.size("links"),
            "has_metadata": (F.col("title") != "") & (F.col("description") != ""),
        }
        passages = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s).between(45, 320))
        asked = F.filter(F.transform("headings", lambda h: h["text"]), lambda t: t.rlike(f"(?i){QUESTION.pattern}"))
        more = {
            "needs_rendering": site.needs_rendering(shell),
            "answer_passages": F.slice(passages, 1, MOST_PASSAGES),
            "questions": F.slice(asked, 1, MOST_QUESTIONS),
        }
        return p.withColumns({"external_links": external, "blocked": signals["blocked"], **fi.answer_readiness(signals), **more}).drop("r")

    def findings(self, snapshots: DataFrame, as_of: str = "2026-01-01") -> DataFrame:
        """Findings of all rules that need one page, less those of modules that are off."""
        return self._findings(self.pages(snapshots, as_of))

    def _findings(self, p: DataFrame) -> DataFrame:
        rows = fi.explode_rules(p, "page_id", fi.page_rules(p)).select("page_id", "category", "severity", "rule", "message", "evidence")
        rows = rows.unionByName(fi.schema_findings(p, "page_id")) if self.config.analyze_schema else rows.where(
            ~F.col("rule").contains("schema")
        )
        return rows if self.config.analyze_images else rows.where(~F.col("rule").rlike("^image_|^aio_multimodal"))

    def links(self, snapshots: DataFrame) -> DataFrame:
        return self._links(extract_pages(snapshots))

    def _links(self, pages: DataFrame) -> DataFrame:
        p = pages.select("page_id", "url", ur.graph_form(F.col("url")).alias("source"), F.posexplode("links").alias("ordinal", "l"))
        link = [F.col("l.text").alias("text"), F.col("l.url").alias("target"), F.col("l.internal").alias("internal")]
        return p.select("page_id", "url", "source", "ordinal", *link, ur.graph_form(F.col("l.url")).alias("target_key"))

    def link_metrics(self, snapshots: DataFrame) -> DataFrame:
        """(key, incoming, depth, orphan) of the pages' link graph from the site's root, else the start URL."""
        pages = snapshots.select(ur.graph_form(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
        return self._link_metrics(pages, staged(self.links(snapshots).where("internal"), "audit-links"))

    def _link_metrics(self, pages: DataFrame, links: DataFrame) -> DataFrame:
        root = ur.graph_form(F.concat(ur.origin(F.lit(self.config.start_url)), F.lit("/")))
        has_root = pages.where(F.col("key") == root).limit(1).count() > 0
        start = pages.where(F.col("key") == (root if has_root else ur.graph_form(F.lit(self.config.start_url))))
        depth = graph.click_depths(pages, links.select("source", F.col("target_key").alias("target")), start)
        found = graph.incoming_links(pages, links).join(depth, "key").join(start.withColumn("is_start", F.lit(True)), "key", "left")
        return graph.orphans(
            found.withColumn("is_start", F.coalesce("is_start", F.lit(False))), exhaustive=self.config.exhaustive
        ).drop("is_start")

    def keywords(self, snapshots: DataFrame) -> DataFrame:
        """Site keywords after suppression, the best max_keywords."""
        return self._keywords(self._signals(self.pages(snapshots))).limit(self.config.max_keywords)

    def _signals(self, p: DataFrame) -> DataFrame:
        places = {
            "title": F.col("title"),
            "h1": F.array_join("h1s", " "),
            "h2": F.array_join("h2s", " "),
            "description": F.col("description"),
            "body": F.col("text")
        }
        return keywords.page_signals(p, "page_id", places)

    def _keywords(self, signals: DataFrame) -> DataFrame:
        site = keywords.site_keywords(signals, "page_id")
        return keywords.suppress_parts(site).orderBy(F.desc("score_h"), F.desc(F.length("phrase")), "phrase")

    def priorities(self, snapshots: DataFrame) -> DataFrame:
        rows = self.findings(snapshots).withColumn("page", F.col("page_id")).withColumn("ordinal", F.lit(0))
        return fi.priorities(rows, snapshots.count())

    def run(
        self,
        log: DataFrame,
        *,
        robots: dict[str, str] | None = None,
        sitemaps: DataFrame | None = None,
        search: DataFrame | None = None,
        analytics: DataFrame | None = None,
        rankings: DataFrame | None = None,
        performance: DataFrame | None = None,
        external: DataFrame | None = None,
        as_of: str = "2026-01-01",
    ) -> dict[str, DataFrame]:
        """A whole audit of fetched rows: the report's tables by name.

        log: ordinal, url, final_url, status, content_type, html, chain, error; headers, response_ms, render_error and allowed
        if known, rows of sources.fetch.crawl for one. robots: rules by origin; sitemaps: (url, status, xml); search,
        analytics: typed rows of exports; rankings: (keyword, position); performance: (url, lab_..., field_...); external:
        rows of external_checks. What isn't given is left out of the report.
        """
        spark, c = self.spark, self.config
        for name, kind in (("headers", "map<string,string>"), ("response_ms", "double"), ("render_error", "string")):
            log = log if name in log.columns else log.withColumn(name, F.lit(None).cast(kind))
        if "allowed" not in log.columns:
            log = site.with_allowed(log, robots or {}, c.user_agent)
        if "reason" in log.columns:  # rows that the crawl itself left out
            shut = log.where("reason IS NOT NULL").select("url", "status", "reason")
            log = log.where("reason IS NULL").drop("reason")
        else:
            shut = spark.createDataFrame([], "url string, status int, reason string")
        ordered = rules.with_reasons(log, c).orderBy("ordinal")  # ids follow the order of the crawl
        judged = staged(ordered.withColumn("page_id", F.monotonically_increasing_id()), "audit-log")
        dropped = shut.unionByName(
            judged.where("reason IS NOT NULL").select(
                F.coalesce(F.when(F.col("reason") == "not_html", F.col("final_url")), F.col("url")).alias("url"), "status", "reason"
            )
        )

        html = judged.where("reason IS NULL").select("page_id", F.col("final_url").alias("url"), "html", "headers")
        facts = judged.where("reason IS NULL").select(
            "page_id", "status", "response_ms", "render_error", F.col("chain").alias("redirect_chain")
        )
        every = staged(self.pages(html, as_of).join(facts, "page_id"), "audit-extracted")
        every = every.withColumn(
            "reason", rules.unindexable(F.col("status"), F.col("robots"))
        ).withColumn("indexable", F.col("reason").isNull())
        dropped = dropped.unionByName(every.where("NOT indexable").select("url", "status", "reason"))
        dropped = staged(dropped.withColumn("key", ur.graph_form(F.col("url"))), "audit-excluded")
        first = every.where("indexable").groupBy("url").agg(F.min("page_id").alias("page_id"))
        pages = staged(every.join(first.select("page_id"), "page_id", "left_semi").drop("reason"), "audit-pages")

        links = staged(self._links(pages), "audit-links")
        keyed = pages.withColumn("key", ur.graph_form(F.col("url"))).withColumn("canonical_key", ur.graph_form(F.col("canonical")))
        graph_rows = self._link_metrics(keyed.select("key").distinct(), links.where("internal"))
        heads = keyed.select("page_id", "key", "url", "canonical_key", F.col("render_error"))
        targets = keyed.groupBy(F.col("key").alias("canonical_key")).agg(F.min("canonical").alias("target_canonical"))
        problems = graph.canonical_problems(
            heads.select("page_id", "key", "canonical_key"), dropped.select("key", "status").where("status IS NOT NULL").distinct()
        )
        linked = heads.join(graph_rows, "key", "left").join(
            problems.select("page_id", "chain", "bad_status"), "page_id"
        ).join(targets, "canonical_key", "left")
        linked = staged(linked.dropDuplicates(["page_id"]).withColumnRenamed("page_id", "page"), "audit-linked")
        prints = pages.select(F.col("page_id").alias("page"), "page_type", "title", "description", "words")
        prints = prints.join(tx.simhash(pages.select(F.col("page_id").alias("page"), "text"), "page", "text"), "page")
        groups = staged(duplicates.duplicate_groups(prints), "audit-groups")

        site_rows = structure.site_findings(linked, groups).withColumnRenamed("page", "page_id").withColumn("ordinal", F.lit(1000))
        own = self._findings(pages).withColumn("ordinal", F.lit(0)).unionByName(site_rows)
        found = staged(own.join(pages.select("page_id", "url"), "page_id"), "audit-findings")

        listed = None if sitemaps is None else staged(
            site.sitemap_pages(sitemaps, c.start_url).select(ur.graph_form(F.col("url")).alias("k")).distinct(), "audit-sitemap"
        )
        shape = linked.select("page", "key", "depth", "orphan", "incoming", "chain", "bad_status")
        full = pages.join(shape, pages["page_id"] == shape["page"]).drop("page")
        full = full.join(
            listed.withColumn("listed", F.lit(True)), F.col("key") == F.col("k"), "left"
        ).drop("k") if listed is not None else full.withColumn("listed", F.lit(None).cast("boolean"))
        full = full.withColumns(
            {
                "listed": F.coalesce("listed", F.lit(False)),
                "has_schema": structure.own_schema(F.col("schemas")),
                "canonical_self": F.col("canonical") == F.col("url"),
                "mixed": F.size("insecure") > 0,
                "h1": F.get("h1s", 0),
            }
        )
        if analytics is not None:
            rows = enrich.last_by_path(
                analytics.withColumn("path", ur.path(F.concat(ur.origin(F.lit(c.start_url)), F.col("page")))).drop("page"),
                "path",
                "ordinal"
            )
            full = enrich.with_analytics(
                full.withColumn("path_key", ur.bare_path(F.col("url"))), rows.drop("ordinal", "path")
            ).drop("path_key")
        full = staged(full, "audit-full")

        blocked = dropped.where("reason = 'robots'").select("key").distinct()
        waste = structure.crawl_waste(
            graph.blocked_targets(links, blocked),
            enrich.parameter_duplicates(judged.select(F.concat(ur.origin(F.col("url")), ur.path(F.col("url"))).alias("k")), "k")
        )
        summary = structure.summary(full).crossJoin(F.broadcast(waste))  # one row each
        counts = [
            ("near_duplicate_groups", groups.agg(F.countDistinct("component"))),
            ("excluded", dropped.agg(F.count("*"))),
            ("fetched", judged.agg(F.count("*")))
        ]
        if listed is not None:
            counts.append(("sitemap_pages", listed.agg(F.count("*"))))
        for name, one in counts:
            summary = summary.withColumn(name, one.toDF(name).scalar())
        if listed is not None:
            summary = summary.withColumn("indexable_rate", F.try_divide(100.0 * F.col("listed_pages"), F.col("sitemap_pages")))

        signals = staged(self._signals(pages), "audit-signals")
        merged = self._keywords(signals)
        if search is not None:
            merged = keywords.merge_observed(merged, keywords.observed_queries(search))
        else:
            merged = merged.select(
                F.col("phrase").alias("keyword"),
                F.lit(False).alias("observed"),
                "score_h",
                F.lit(0.0).alias("impressions"),
                F.lit(0.0).alias("clicks"),
                F.lit(None).cast("double").alias("position"),
                "confidence_h",
                F.lit(None).cast("double").alias("ctr"),
            )
        final = staged(keywords.final_keywords(merged, c.max_keywords), "audit-keywords")
        wanted = F.broadcast(final.select(F.lower("keyword").alias("wanted")).distinct())  # max_keywords of them at most
        best = keywords.keyword_pages(signals.join(wanted, F.lower("phrase") == F.col("wanted"), "left_semi"), "page_id")
        shown = None
        if search is not None:
            asked = search.join(wanted, F.lower("query") == F.col("wanted"), "left_semi")
            shown = keywords.query_pages(keywords.observed_page_metrics(asked))
        final = keywords.with_page_lists(final, best.join(pages.select("page_id", "url"), "page_id"), shown)
        final = final if rankings is None else keywords.with_rankings(final, rankings)

        advice = suggestions.image_suggestions(pages, "page_id", F.coalesce(F.get("h1s", 0), F.col("title"))) if c.analyze_images else None
        images = pages.select(
            F.col("page_id").alias("page"), F.posexplode("images").alias("ordinal", "i")
        ).select("page", "ordinal", "i.src", "i.alt", "i.filename")
        inventory = enrich.image_inventory(images)
        moved = rules.redirects(judged.where("reason IS NULL OR reason IN ('off_domain', 'not_html')"))
        ranked = found.select(F.col("page_id").alias("page"), "ordinal", "rule", "category", "severity", "message")
        out = {
            "pages": full,
            "findings": found,
            "priorities": fi.priorities(ranked, pages.count()),
            "links": links,
            "link_inventory": graph.link_inventory(links),
            "excluded": dropped.drop("key"),
            "redirects": moved.join(graph.redirect_sources(moved.select("url"), links), "url", "left"),
            "broken_links": graph.broken_links(
                links, dropped.where("status >= 400").select("url", "status").distinct()
            ) if c.report_broken_links else None,
            "external": external if external is not None else graph.external_sources(links),
            "keywords": final,
            "competing_pages": keywords.observed_competition(search) if search is not None else keywords.competing_pages(signals, "page_id"),
            "primary_keywords": keywords.primary_keywords(pages, signals, "page_id"),
            "schema_suggestions": pages.select(
                "page_id",
                "url",
                suggestions.schema_suggestions(
                    F.col("url"),
                    F.col("title"),
                    F.col("h1s"),
                    F.col("h2s"),
                    F.col("text"),
                    F.flatten(F.transform("schemas", lambda s: s["types"]))
                ).alias("types")
            ) if c.analyze_schema else None,
            "images": inventory if advice is None else enrich.with_advice(inventory, advice.withColumnRenamed("page_id", "page")),
            "image_suggestions": advice,
            "document": structure.document_counts(full),
            "summary": summary,
            "health": fi.health(found, pages),
            "crawler_access": spark.createDataFrame(site.crawler_access(robots or {}, c.start_url), "crawler string, allowed boolean"),
            "sitemaps": site.sitemap_report(sitemaps, c.start_url) if sitemaps is not None else None,
            "search": keywords.observed_queries(search) if search is not None else None,
            "search_pages": keywords.observed_page_metrics(search) if search is not None else None,
            "performance": performance,
            "performance_means": structure.performance_means(performance) if performance is not None else None,
        }
        return {k: v for k, v in out.items() if v is not None}
