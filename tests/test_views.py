"""Views and suggestions on small tables."""

from pyspark.sql import functions as F

from webgrain.operators import suggestions, views


def test_views(spark):
    k = spark.createDataFrame([("red shoe", ["/a"], 3.0, 10, 5), ("blue shoe", ["/b"], None, None, 9), ("hat", ["/a"], 12.0, 20, 1)], "keyword string, pages array<string>, position double, impressions int, score_h int")
    names = lambda df: [r["keyword"] for r in df.collect()]
    assert names(views.keyword_view(k)) == ["hat", "red shoe", "blue shoe"]
    assert names(views.keyword_view(k, text="SHOE", position=5)) == ["red shoe"]
    assert names(views.keyword_view(k, unavailable=True)) == ["blue shoe"] and names(views.keyword_view(k, page="/A")) == ["hat", "red shoe"]
    assert names(views.sorted_rows(k, "position", descending=True)) == ["hat", "red shoe", "blue shoe"] and names(views.sorted_rows(k, "position"))[-1] == "blue shoe"
    assert names(views.search_rows(k, "/b")) == ["blue shoe"]
    f = spark.createDataFrame([("info", "a", "u"), ("critical", "b", "v"), ("warning", "a", "w")], "severity string, category string, url string")
    assert [r["url"] for r in views.finding_view(f).collect()] == ["v", "w", "u"] and views.finding_view(f, severity="info").count() == 1
    a = spark.createDataFrame([("u", 5.0, 1.0, 1.0, 1.0, 0.5, 70), ("v", 9.0, 0.0, 2.0, 3.0, None, 75), ("w", None, None, None, None, None, 80)], "url string, sessions double, key_events double, users double, engaged double, bounce double, score int")
    assert [r["url"] for r in views.analytics_view(a).collect()] == ["v", "u"] and [r["url"] for r in views.analytics_view(a, key_events=True, min_sessions=1).collect()] == ["u"]
    t = views.dashboard_totals(a).collect()[0]
    assert (t["score"], t["sessions"], t["bounce_rate"]) == (75, 14.0, 0.5)


def test_schema_suggestions(spark):
    rows = [("https://a.example/", "Us", ["FAQ"], [], "our service", []), ("https://a.example/blog/x", "Guide", [], [], None, ["article", "WebPage"])]
    df = spark.createDataFrame(rows, "url string, title string, h1s array<string>, h2s array<string>, text string, types array<string>")
    got = [[x["type"] for x in r["s"]] for r in df.select(suggestions.schema_suggestions(*(F.col(c) for c in df.columns)).alias("s")).collect()]
    assert got == [["FAQPage", "Service", "Organization", "WebPage"], ["BreadcrumbList"]]


def test_image_suggestions(spark):
    image = lambda alt, name, poor, context, opaque=False: (f"https://a.example/{name}", alt, name, opaque, poor, context)
    rows = [(1, "T", ["Head"], [image("", "red-shoe.JPG", False, ""), image("ok", "fine.png", False, ""), image("", "red_shoe.png", True, ""), image("x", "IMG_1.png", True, "A shop"), image("", "0" * 24, False, "", True)])]
    df = spark.createDataFrame(rows, "page long, title string, h1s array<string>, images array<struct<src:string,alt:string,filename:string,opaque:boolean,poor_name:boolean,context:string>>")
    got = [(r["n"], r["issue"], r["suggested_alt"], r["suggested_filename"]) for r in suggestions.image_suggestions(df, "page", F.lit("shoe")).orderBy("n").collect()]
    assert got == [
        (0, "missing_alt", "red shoe", "shoe-red-shoe.jpg"),
        (2, "both", "Review by hand: image 3 of Head", "shoe-red-shoe.png"),
        (3, "poor_filename", "A shop - shoe", "shoe-a-shop.png"),
        (4, "missing_alt", "Review by hand: image 5 of Head", None),
    ]
