"""Report tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hosts of share buttons, matched at a domain boundary.
SOCIAL = r"(?i)(^|\.)(facebook|twitter|x|linkedin|pinterest|reddit|whatsapp|telegram|tumblr|threads)\.(com|net|org|me)$"


def joined(c: str) -> Column:
    return F.array_join(F.col(c), " | ")


def flat(df: DataFrame) -> DataFrame:
    """Every column as text: arrays joined, nested values as JSON."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append(
            (
                F.array_join(c, " | ") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
            ).alias(name)
        )
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def page_rows(pages: DataFrame) -> DataFrame:
    """The columns of a pages file, in its order; lists are joined when it is written. What a report lacks is null."""
    has = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    internal = lambda inside: F.size(
        F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"] if inside else ~x["internal"]), lambda x: x["url"]))
    )
    h2s = F.transform(F.filter("headings", lambda h: h["level"] == 2), lambda h: h["text"])
    chosen = {
        "url": F.col("url"), "page_type": F.col("page_type"), "status": has("status"), "response_ms": has("response_ms"),
        "redirect_chain": F.array_join(
            F.coalesce(has("redirect_chain"), F.array().cast("array<string>")), " > "
        ) if "redirect_chain" in pages.columns else has("redirect_chain"),
        "internal_links": internal(True), "external_links": internal(False), "incoming": has("incoming"), "depth": has("depth"), "orphan": has("orphan"),
        **{c: has(c) for c in ("sessions", "users", "engaged", "engagement_rate", "bounce", "key_events")},
        "image_count": F.col("image_count"), "images_without_alt": F.col("images_without_alt"),
        **{c: has(c) for c in ("score", "label", "extractability", "evidence", "entity_clarity", "intent_coverage", "freshness", "multimodal")},
        "lang": F.col("lang"), "has_viewport": F.col("has_viewport"), "canonical": F.col("canonical"), "canonical_self": has("canonical_self"),
        "title": F.col("title"), "title_chars": F.length("title"), "description": F.col("description"), "description_chars": F.length("description"),
        "h1": F.array_join(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), " | "), "h2s": h2s,
        "action": F.col("action.text"), "action_url": F.col("action.url"),
        "schema_types": F.array_distinct(F.flatten(F.transform("schemas", lambda s: s["types"]))),
        "words": has("words"), "paragraphs": F.col("paragraphs"), "words_per_sentence": has("words_per_sentence"), "grade": has("grade"),
        "text_share": F.round(100.0 * F.length("text") / F.nullif(F.col("html_chars"), F.lit(0)), 1),
    }
    return pages.select(*[c.alias(n) for n, c in chosen.items()])


def keyword_rows(keywords: DataFrame) -> DataFrame:
    """The columns of a keywords file: phrase, whether it was observed, score, figures and ranking."""
    has = lambda c: F.col(c) if c in keywords.columns else F.lit(None).cast("double")
    score = F.round(F.col("score_h") / 100, 2).alias("score")
    return keywords.select(
        "rank", "keyword", "observed", score, "clicks", "impressions", "position", has("ranking").alias("ranking")
    ).orderBy("rank").drop("rank")


def link_rows(links: DataFrame, host: Column) -> DataFrame:
    """Links (source, text, target, internal) with those to share buttons summed up as one row."""
    social = F.coalesce(host.rlike(SOCIAL), F.lit(False))
    plain = links.where(~social).select("source", "text", "target", "internal")
    marked = links.where(social).select("source", host.alias("h"))
    summary = marked.agg(F.countDistinct("h").alias("n"), F.countDistinct("source").alias("p")).where("p > 0")
    row = summary.select(
        F.concat(F.col("p").cast("string"), F.lit(" pages")).alias("source"),
        F.lit("share buttons").alias("text"),
        F.concat(F.col("n").cast("string"), F.lit(" platforms")).alias("target"),
        F.lit(False).alias("internal")
    )
    return plain.unionByName(row)


def technical_rows(broken: DataFrame, redirects: DataFrame, external: DataFrame, dropped: DataFrame) -> DataFrame:
    """Broken links, redirects, external pages and excluded URLs in one table: kind, source, target, status, detail."""
    shape = lambda df, kind, source, target, status, detail: df.select(
        F.lit(kind).alias("kind"),
        source.cast("string").alias("source"),
        target.cast("string").alias("target"),
        status.cast("int").alias("status"),
        detail.cast("string").alias("detail")
    )
    none = F.lit(None)
    return (
        shape(broken, "broken_link", F.col("source"), F.col("target"), F.col("status"), F.col("text"))
        .unionByName(shape(redirects, "redirect", F.col("url"), F.col("final_url"), F.col("status"), F.col("classification")))
        .unionByName(shape(external, "external", F.col("first_source"), F.col("target"), none, F.col("pages")))
        .unionByName(shape(dropped, "excluded", none, F.col("url"), F.col("status"), F.col("reason")))
    )
