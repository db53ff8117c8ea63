"""Near-duplicate pages of a site: shared titles or descriptions, and close fingerprints within a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.functions.text import hamming
from webgrain.operators.components import connected_components
from webgrain.staging import staged

NEAR_BITS = 6
WORDS_STEP = 250
#: Bits of a fingerprint below those that name its bucket.
TAIL_BITS = 52


def bucketed(pages: DataFrame) -> DataFrame:
    """pages (page, page_type, fingerprint, words) with the bucket that pairs are looked for in."""
    top = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return pages.withColumn(
        "bucket", F.concat_ws(":", "page_type", F.substring(top, 1, 3), F.floor(F.col("words") / WORDS_STEP + 0.5).cast("string"))
    )


def fingerprint_pairs(pages: DataFrame, *, bits: int = NEAR_BITS) -> DataFrame:
    """(bucket, a, b, distance): distinct fingerprints of a bucket at most `bits` apart, a < b. Pages with equal
    fingerprints are one, so a common text (an empty one, say) costs a row, not a square.

    Fingerprints of a bucket share their first bits. The others are cut into bits + 1 bands, one of which at least is equal
    in any such pair: pairs meet in bands of a bucket, and each is taken from its first equal band.
    """
    cuts = [TAIL_BITS * i // (bits + 1) for i in range(bits + 2)]
    band = lambda c, i: F.shiftright(c, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    kinds = bucketed(pages).select("bucket", "fingerprint").distinct()
    keys = F.posexplode(F.array(*[band(F.col("fingerprint"), i) for i in range(bits + 1)])).alias("i", "v")
    side = lambda n: kinds.select("bucket", F.col("fingerprint").alias(n), keys)
    close = (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= bits)
    first = F.lit(True)
    for i in range(bits):
        first = first & ((F.col("i") <= i) | (band(F.col("a"), i) != band(F.col("b"), i)))
    near = side("a").join(side("b"), ["bucket", "i", "v"]).where(close & first)
    return near.select("bucket", "a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """(page, component) for pages (page, page_type, title, description, fingerprint, words) that share a group with
    another page; the component is its least page.

    A title and a description of one page type share a key space, as do those of different pages. Each key and each
    fingerprint of a bucket is a star around its least page.
    """
    pages = staged(pages.select("page", "page_type", "title", "description", "fingerprint", "words"), "duplicate-pages")
    texts = pages.select(
        "page",
        F.explode(
            F.array_distinct(F.filter(F.array(F.lower("title"), F.lower("description")), lambda t: F.coalesce(t, F.lit("")) != ""))
        ).alias("t"),
        "page_type"
    )
    named = texts.groupBy("page_type", "t").agg(F.min("page").alias("least"))
    shared = texts.join(named, ["page_type", "t"]).where("page <> least").select(F.col("least").alias("a"), F.col("page").alias("b"))
    rows = bucketed(pages)
    heads = rows.groupBy("bucket", "fingerprint").agg(F.min("page").alias("least"))
    same = rows.join(heads, ["bucket", "fingerprint"]).where("page <> least").select(F.col("least").alias("a"), F.col("page").alias("b"))
    ha = heads.select("bucket", F.col("fingerprint").alias("a"), F.col("least").alias("pa"))
    hb = heads.select("bucket", F.col("fingerprint").alias("b"), F.col("least").alias("pb"))
    near = fingerprint_pairs(pages).join(ha, ["bucket", "a"]).join(hb, ["bucket", "b"]).select(
        F.col("pa").alias("a"), F.col("pb").alias("b")
    )
    found = connected_components(shared.unionByName(same).unionByName(near))
    return found.select(F.col("node").alias("page"), "component")
