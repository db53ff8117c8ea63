"""URL forms, classes and text measures on small cases."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webgrain.functions import text as tx
from webgrain.functions import urls as ur


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("form", "url", "want"),
    [
        (ur.link_form, "HTTP://A.Example:80/x/?utm_source=q&b=2&a=1#f", "http://a.example/x?b=2&a=1"),
        (ur.crawl_form, "https://a.example/x/?b=2&a=1&share=y", "https://a.example/x/?a=1&b=2"),
        (ur.graph_form, "https://a.example:8443/x//?utm_id=1", "https://a.example:8443/x?utm_id=1"),
        (ur.history_form, "https://www.a.example/x/?gclid=1&z=2", "a.example/x?z=2"),
        (ur.link_form, "mailto:a@b.example", None),
        (ur.domain_form, "WWW.A.example.:8080/x", "a.example:8080"),
        (ur.domain_form, "https://www.a.example.", "a.example"),
    ],
)
def test_forms(spark, form, url, want):
    assert one(spark, form(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("url", "kind"),
    [("https://a.example/", "home"), ("https://a.example/x/feed/", "feed"), ("https://a.example/?s=q", "search_archive"), ("https://a.example/category/x", "category_archive"), ("https://a.example/2024/05/x", "article"), ("https://a.example/page/3", "pagination_archive"), ("https://a.example/about", "landing")],
)
def test_page_types(spark, url, kind):
    assert one(spark, ur.page_type(F.col("u"), F.lit(False)), u=url) == kind


def test_exclusion_is_by_path_segment(spark):
    for path, want in (("/blog", True), ("/blog/x", True), ("/blogger", False), ("/", False)):
        assert one(spark, ur.excluded(F.col("u"), ["/blog/*", " "]), u=f"https://a.example{path}") is want


def test_redirects(spark):
    s, f = F.col("s"), F.col("f")
    assert one(spark, ur.slash_redirect(s, f), s="https://a.example/x", f="https://a.example/x/")
    assert not one(spark, ur.slash_redirect(s, f), s="https://a.example/x", f="https://a.example/y/")
    assert one(spark, ur.redirect_class(s, f, F.col("c")), s="https://a.example/x", f="https://a.example/y", c=[]) == "deliberate"
    assert one(spark, ur.redirect_class(s, f, F.col("c")), s="https://a.example/x?attachment_id=4", f="https://a.example/y", c=[]) == "automatic"
    assert one(spark, ur.redirect_class(s, f, F.col("c")), s="https://a.example/x", f="https://b.example/y", c=[]) == "unknown"
    assert one(spark, ur.gated_flow(s, f, F.col("c")), s="https://a.example/members/x", f="https://id.example/login", c=[])
    assert not one(spark, ur.gated_flow(s, f, F.col("c")), s="https://a.example/x", f="https://a.example/login", c=[])
    assert one(spark, ur.private_host(F.col("s")), s="http://172.20.1.1/x") and not one(spark, ur.private_host(F.col("s")), s="http://172.40.1.1/x")


@given(st.lists(st.sampled_from(["a", "..", ".", "b c", "é", "x"]), max_size=5), st.sampled_from(["", "?q=1", "?utm_x=1&k=v"]))
def test_resolving_is_idempotent(parts, query):
    got = ur.resolve("/".join(parts) + query, "https://A.example/dir/page")
    assert got is not None and ur.resolve(got, "https://other.example/") == got


def test_readability_and_tokens(spark):
    r = one(spark, tx.readability(F.col("t")), t="The cat sat on the mat. It purred loudly, didn't it?")
    assert (r["words"], r["sentences"]) == (11, 2)
    assert one(spark, tx.readability(F.col("t")), t="")["grade"] is None
    assert [one(spark, tx.syllables(F.col("w")), w=w) for w in ("the", "table", "houses", "yes", "walked", "12")] == [1, 2, 1, 1, 1, 0]
    assert one(spark, tx.keyword_tokens(F.col("t")), t="The -Blue- widget's 2024 price, of naïve") == ["blue", "widget", "price", "naïve"]
    assert one(spark, tx.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2, 3), t="") == ["a b", "b c", "a b c"]


def test_empty_texts_share_a_fingerprint(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "some words here")], "k long, t string")
    got = {r["k"]: r["fingerprint"] for r in tx.simhash(df, "k", "t").collect()}
    assert got[1] == got[2] == -1 and got[3] != -1


def test_syllables_of_joined_words(spark):
    rng = random.Random(3)
    rows = [(i, ["".join(rng.choices("aeyldshx'9\u00e9Y", k=rng.randint(1, 7))) for _ in range(rng.randint(0, 9))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, w array<string>")
    each = F.aggregate(F.transform("w", tx.syllables), F.lit(0), lambda a, b: a + b)
    assert df.where(tx.syllable_total(F.col("w")) != each).count() == 0
