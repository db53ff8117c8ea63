"""Joins of imported measurements: analytics by landing page, parameter duplicates, images, site summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(cell: Column) -> Column:
    """A number from an export's cell without %, comma, dollar sign or blanks; 0 where it isn't one."""
    return F.coalesce(F.regexp_replace(cell, r"[%,$\s]", "").try_cast("double"), F.lit(0.0))


def rate(cell: Column) -> Column:
    """A share: hundredths where the cell has a percent sign."""
    return F.when(cell.contains("%"), number(cell) / 100).otherwise(number(cell))


def last_by_path(rows: DataFrame, path: str, ordinal: str) -> DataFrame:
    """The last row of each path (one trailing slash aside); rows overwrite, they don't add up."""
    key = F.regexp_replace(F.col(path), "(?<=.)/$", "")
    keyed = rows.withColumn("path_key", key)
    return keyed.groupBy("path_key").agg(F.max_by(F.struct(*keyed.drop("path_key").columns), ordinal).alias("r")).select("path_key", "r.*")


def with_analytics(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """pages (path_key) with the last analytics row of their path, null where there is none."""
    return pages.join(rows, "path_key", "left")


def engagement_totals(rows: DataFrame) -> DataFrame:
    """One row: sums, engaged per session, and the bounce rate weighted by the sessions of rows that have one."""
    known = F.when(F.col("bounce").isNotNull(), F.col("sessions"))
    return rows.agg(
        F.sum("sessions").alias("sessions"),
        F.sum("engaged").alias("engaged"),
        F.try_divide(F.sum("engaged"), F.sum("sessions")).alias("engagement_rate"),
        F.try_divide(F.sum(F.col("bounce") * known), F.sum(known)).alias("bounce_rate"),
    )


def parameter_duplicates(urls: DataFrame, key: str) -> DataFrame:
    """One row: fetched URLs beyond the first of each origin and path."""
    return urls.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("extra")
    )


def image_inventory(images: DataFrame) -> DataFrame:
    """images (page, ordinal, src, alt, filename) by source: pages, occurrences, first alt text and file name."""
    at = F.struct("page", "ordinal")
    return images.groupBy("src").agg(
        F.countDistinct("page").alias("pages"),
        F.count("*").alias("occurrences"),
        F.min_by("alt", at).alias("alt"),
        F.min_by("filename", at).alias("filename")
    )


def advice_by_image(suggestions: DataFrame) -> DataFrame:
    """The first suggestion for each image source over all pages: (src, suggested_alt, suggested_filename)."""
    at = F.struct("page", "n")
    known = suggestions.where("suggested_alt IS NOT NULL")
    return known.groupBy("src").agg(
        F.min_by("suggested_alt", at).alias("suggested_alt"), F.min_by("suggested_filename", at).alias("suggested_filename")
    )


def with_advice(inventory: DataFrame, suggestions: DataFrame) -> DataFrame:
    """The image inventory with the first suggestion for each source, null where there is none."""
    return inventory.join(advice_by_image(suggestions), "src", "left")


def with_image_analysis(suggestions: DataFrame, analysis: DataFrame) -> DataFrame:
    """suggestions with what an image service (src, alt, filename, description) found in their place: texts up to 160
    characters; `basis` tells page context from vision."""
    found = analysis.groupBy(F.col("src").alias("seen_src")).agg(*[F.max(c).alias(f"seen_{c}") for c in ("alt", "filename", "description")])
    both = suggestions.join(found, F.col("src") == F.col("seen_src"), "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return both.withColumns(
        {
            "suggested_alt": F.coalesce(F.substring(given("seen_alt"), 1, 160), "suggested_alt"),
            "suggested_filename": F.coalesce(given("seen_filename"), "suggested_filename"),
            "description": given("seen_description"),
            "basis": F.when(F.col("seen_src").isNotNull(), "vision").otherwise("page"),
        }
    ).drop("seen_src", "seen_alt", "seen_filename", "seen_description")


def duplicate_texts(pages: DataFrame, column: str) -> DataFrame:
    """Non-empty texts, lower-cased, that several pages have."""
    t = F.lower(F.col(column))
    return pages.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(t.alias("text")).agg(
        F.count("*").alias("pages"), F.min("page").alias("first_page")
    ).where("pages > 1")


def percent(hits: Column, of: Column | None = None) -> Column:
    """Rows where hits holds among those where `of` holds, as a percentage; null without any."""
    base = F.count_if(of) if of is not None else F.count(F.lit(1))
    both = hits & of if of is not None else hits
    return F.try_divide(F.count_if(both) * 100.0, base)
