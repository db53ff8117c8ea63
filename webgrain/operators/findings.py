"""Rules over extracted pages, answer readiness, priorities and site health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions.urls import ARCHIVE_TYPES

IMPACT = {"high": 3, "medium": 2, "low": 1}

# Effort of known fixes; others are medium where the impact is high, else low.
EFFORT = {
    "title_missing": "low",
    "meta_description_missing": "low",
    "meta_description_length": "low",
    "h1_missing": "low",
    "broken_link": "low",
    "thin_content": "high",
    "schema_missing": "medium",
    "schema_invalid_json": "low",
    "image_alt_missing": "medium",
    "canonical_missing": "low",
    "canonical_differs": "medium",
    "viewport_missing": "low",
    "heading_hierarchy_skipped": "low",
    "mixed_content": "medium",
    "orphan_page": "medium",
}

#: Answer-readiness dimensions: most points, and points from which they pass.
DIMENSIONS = {
    "accessibility": (20, 20),
    "extractability": (20, 14),
    "evidence": (20, 15),
    "entity_clarity": (15, 11),
    "intent_coverage": (15, 11),
    "freshness": (5, 3),
    "multimodal": (5, 4)
}


def points(*pairs: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in pairs])


def answer_readiness(p) -> dict[str, Column]:
    """Columns of the seven dimensions, score and label, from columns p[...] of a page: blocked, has_passage, h2_count,
    question_headings, lists_or_tables, external_links, cited_claims, has_author, has_published, has_modified,
    has_last_modified, has_title_h1, has_schema, has_description, has_core_entity, words, follow_up, images, images_without_alt."""
    dated = p["has_published"] | p["has_modified"]
    d = {
        "accessibility": F.when(p["blocked"], 4).otherwise(20),
        "extractability": points(
            (p["has_passage"], 6), (p["h2_count"] >= 2, 5), (p["question_headings"] > 0, 4), (p["lists_or_tables"] > 0, 5)
        ),
        "evidence": points((p["external_links"] > 0, 5), (p["cited_claims"] > 0, 5), (p["has_author"], 5), (dated, 5)),
        "entity_clarity": points((p["has_title_h1"], 6), (p["has_schema"], 5), (p["has_description"], 2), (p["has_core_entity"], 2)),
        "intent_coverage": F.least(
            F.lit(15),
            points(
                (p["words"] >= 500, 5),
                (p["h2_count"] >= 3, 4),
                (p["question_headings"] >= 2, 3),
                (p["follow_up"], 3),
                (p["h2_count"] >= 8, 2)
            )
        ),
        "freshness": points((p["has_published"], 2), (p["has_modified"], 2), (p["has_last_modified"], 1)),
        "multimodal": F.when(
            p["images"] > 0, F.floor(5 * (p["images"] - p["images_without_alt"]) / p["images"] + 0.5)
        ).otherwise(5).cast("int"),
    }
    score = reduce(lambda a, b: a + b, d.values())
    label = F.when(score >= 85, "strong").when(
        score >= 70, "generally_ready"
    ).when(score >= 50, "partial").otherwise("significant_barriers")
    return d | {"score": score, "label": label}


def rule(name: str, category: str, severity: str | Column, when: Column, message: Column, evidence: Column | None = None) -> Column:
    """A finding where the condition holds, else null."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    body = F.struct(
        F.lit(category).alias("category"),
        sev.alias("severity"),
        F.lit(name).alias("rule"),
        message.alias("message"),
        (evidence if evidence is not None else F.lit(None).cast("string")).alias("evidence")
    )
    return F.when(F.coalesce(when, F.lit(False)), body)


def page_rules(p) -> list[Column]:
    """The rules that need one page only, in the order in which they are reported."""
    live = ~p["page_type"].isin(*ARCHIVE_TYPES)
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    skip = p["heading_skip"]
    age = p["content_age_days"]
    return [
        rule("title_missing", "seo", "critical", p["title"] == "", F.lit("The page has no title.")),
        rule("meta_description_missing", "seo", "warning", live & (p["description"] == ""), F.lit("The page has no meta description.")),
        rule(
            "meta_description_length",
            "seo",
            "warning",
            live & (p["description"] != "") & ~F.length(p["description"]).between(70, 170),
            text("The meta description is ", F.length(p["description"]), " characters long."),
            p["description"]
        ),
        rule("h1_missing", "seo", "warning", F.size(p["h1s"]) == 0, F.lit("The page has no main heading.")),
        rule("multiple_h1", "seo", "info", F.size(p["h1s"]) > 1, text("The page has ", F.size(p["h1s"]), " main headings.")),
        rule("canonical_missing", "seo", "info", p["canonical"].isNull(), F.lit("The page declares no canonical URL.")),
        rule("thin_content", "geo", "warning", live & (p["words"] < 150), text("The page shows ", p["words"], " words.")),
        rule("answer_structure", "aio", "info", live & (F.size(p["h2s"]) == 0), F.lit("The page has no second-level sections.")),
        rule("schema_missing", "geo", "info", live & (F.size(p["schemas"]) == 0), F.lit("The page has no structured data.")),
        rule(
            "indexable_archive_review",
            "seo",
            F.when(p["page_type"] == "search_archive", "warning").otherwise("info"),
            ~live,
            text("Listing page of kind ", p["page_type"], " may be indexed.")
        ),
        rule("viewport_missing", "seo", "warning", ~p["has_viewport"], F.lit("The page sets no viewport.")),
        rule("html_lang_missing", "seo", "info", p["lang"].isNull(), F.lit("The page declares no language.")),
        rule(
            "image_alt_missing",
            "seo",
            "warning",
            p["images_without_alt"] > 0,
            text(p["images_without_alt"], " of ", p["image_count"], " images have no alternative text.")
        ),
        rule("canonical_differs", "seo", "info", p["canonical"] != p["url"], text("The canonical URL is ", p["canonical"])),
        rule("heading_hierarchy_skipped", "seo", "warning", skip.isNotNull(), text("A heading level is left out: ", skip), skip),
        rule(
            "mixed_content",
            "seo",
            "warning",
            F.size(p["insecure"]) > 0,
            text(F.size(p["insecure"]), " resources load without encryption."),
            F.array_join(F.slice(p["insecure"], 1, 10), " | ")
        ),
        rule("content_stale", "geo", "warning", age > 730, text("The content is ", age, " days old."), p["content_date"]),
        rule("content_aging", "geo", "info", (age > 365) & (age <= 730), text("The content is ", age, " days old."), p["content_date"]),
        rule(
            "readability_difficult",
            "geo",
            "info",
            live & (p["grade"] > 12),
            text("The text asks for school grade ", F.round(p["grade"], 1))
        ),
        rule(
            "long_sentences",
            "geo",
            "info",
            live & (p["words_per_sentence"] > 25),
            text("Sentences have ", F.round(p["words_per_sentence"], 1), " words on average.")
        ),
        *[
            rule(
                f"aio_{name}",
                "aio",
                F.when(F.lit(name == "accessibility") & p["blocked"], "critical").otherwise("info"),
                live & (p[name] < least),
                text(name.replace("_", " "), " scores ", p[name], f" of {most}."),
                p[name].cast("string")
            )
            for name, (most, least) in DIMENSIONS.items()
        ],
    ]


def explode_rules(pages: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    """(key, ordinal, category, severity, rule, message, evidence) of all rules that hold."""
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return pages.select(key, F.posexplode(found).alias("ordinal", "f")).select(key, "ordinal", "f.*")


def schema_findings(pages: DataFrame, key: str) -> DataFrame:
    """Findings of structured-data blocks: invalid JSON, and each missing core property."""
    blocks = pages.select(key, F.posexplode("schemas").alias("n", "s"))
    which = F.concat(F.lit("Structured-data block "), (F.col("n") + 1).cast("string"))
    bad = blocks.where("NOT s.valid").select(
        key,
        F.lit("seo").alias("category"),
        F.lit("warning").alias("severity"),
        F.lit("schema_invalid_json").alias("rule"),
        F.concat(which, F.lit(" isn't valid JSON: "), F.coalesce("s.error", F.lit(""))).alias("message"),
        F.substring("s.raw", 1, 500).alias("evidence")
    )
    issues = blocks.select(key, "n", "s", F.explode("s.issues").alias("issue"))
    missing = issues.select(
        key,
        F.lit("seo").alias("category"),
        F.lit("warning").alias("severity"),
        F.lit("schema_missing_core_property").alias("rule"),
        F.concat(which, F.lit(" lacks "), "issue").alias("message"),
        F.array_join("s.types", ", ").alias("evidence")
    )
    return bad.unionByName(missing)


def priorities(findings: DataFrame, total_pages: int | Column, *, limit: int = 25) -> DataFrame:
    """The first `limit` rules by impact and affected pages: findings (page, ordinal, rule, category, severity, message).

    Impact is high for critical rules and for those on at least 3 pages and 30 % of all, medium for warnings, else low;
    a rule's severity, category and message are those of its first finding.
    """
    total = F.lit(total_pages) if isinstance(total_pages, int) else total_pages
    first = F.min_by(F.struct("category", "severity", "message"), F.struct("page", "ordinal"))
    g = findings.groupBy("rule").agg(
        first.alias("f"), F.countDistinct("page").alias("affected"), F.min(F.struct("page", "ordinal")).alias("seen")
    )
    high = (F.col("f.severity") == "critical") | ((F.col("affected") >= 3) & (10 * F.col("affected") >= 3 * total))
    impact = F.when(high, "high").when(F.col("f.severity") == "warning", "medium").otherwise("low")
    effort = reduce(
        lambda e, kv: e.when(F.col("rule") == kv[0], kv[1]), EFFORT.items(), F.when(F.lit(False), "")
    ).otherwise(F.when(impact == "high", "medium").otherwise("low"))
    rank = F.row_number().over(
        Window.orderBy(F.when(impact == "high", 3).when(impact == "medium", 2).otherwise(1).desc(), F.desc("affected"), "seen")
    )  # a row for each rule
    out = g.select(
        "rule",
        F.col("f.category").alias("area"),
        F.col("f.message").alias("issue"),
        impact.alias("impact"),
        effort.alias("effort"),
        "affected",
        rank.alias("rank")
    )
    return out.where(F.col("rank") <= limit)


def leading_findings(findings: DataFrame, *, limit: int = 30) -> DataFrame:
    """The first findings that aren't mere notes, critical ones first, then in the order of pages and rules."""
    return findings.where("severity <> 'info'").orderBy(F.col("severity") != "critical", "page", "ordinal").limit(limit)


def health(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: counts by severity and the label."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    n = pages.agg(F.count("*").alias("pages"))
    label = F.when(F.col("critical") > 0, "critical").when(
        F.try_divide("warning", "pages") > 0.75, "needs_attention"
    ).when(F.col("warning") > 0, "fair").otherwise("good")
    return counts.crossJoin(n).withColumn("label", label)  # one row each
