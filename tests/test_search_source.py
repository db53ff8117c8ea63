"""The search service as a table: what is pushed to it, and that rows are those of the plain function."""

from datetime import date

import pytest
from webgrain.sources import services


def search(**request):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    import asked

    return asked.search(**request)


@pytest.fixture
def table(spark):
    spark.dataSource.register(services.SearchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda **o: spark.read.format("webgrain_search").options(asker="tests.asked:search", **{"most": 200, "page": 25} | o).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def plain(most=200, **request):
    rows = search(first=0, limit=most, start=None, end=None, filters=[])
    return [(date.fromisoformat(r["keys"][0]), *r["keys"][1:], float(r["clicks"]), float(r["impressions"]), r["ctr"], float(r["position"])) for r in rows]


def rows(df):
    return [tuple(r)[:-1] for r in df.orderBy("ordinal").collect()]


def test_rows_are_those_of_the_plain_function(spark, table):
    assert rows(table()) == plain()
    assert rows(table(most=40)) == plain(most=40)
    assert table().rdd.getNumPartitions() == 8  # a request each
    from tests import asked

    by_function = services.search_console_rows(spark, lambda first, limit, r=asked.ROWS: [x | {"keys": x["keys"][1:]} for x in r[first : first + limit]], most=200, page=25)
    assert rows(table().drop("date")) == rows(by_function)
    with pytest.raises(Exception, match="most"):
        table(most=10**9).collect()


CONDITIONS = {
    "date": "date >= DATE'2024-01-03' AND date < DATE'2024-01-05'",
    "one day": "date = DATE'2024-01-09'",
    "no day": "date > DATE'2024-01-09' AND date < DATE'2024-01-02'",
    "page": "page = 'https://a.example/shop/1' AND date <= DATE'2024-01-06'",
    "part": "page LIKE '%blog%' AND clicks > 1",
    "case": "page LIKE '%Blog%'",
    "other": "query = 'q1' OR date = DATE'2024-01-02'",
}


@pytest.mark.parametrize("name", CONDITIONS)
def test_conditions_narrow_the_request_and_change_no_row(spark, table, name):
    everything = spark.createDataFrame([(*r, i) for i, r in enumerate(plain())], services.SEARCH_FIELDS)
    assert rows(table().where(CONDITIONS[name])) == rows(everything.where(CONDITIONS[name]))


def test_pushed_conditions_are_seen_in_the_plan(spark, table):
    reader = services.SearchReader({"asker": "tests.asked:search"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([GreaterThan(("date",), date(2024, 1, 3)), EqualTo(("page",), "x"), StringContains(("page",), "b"), EqualTo(("query",), "q")]))
    assert (reader.start, reader.end) == (date(2024, 1, 4), None) and reader.filters == [("page", "equals", "x"), ("page", "contains", "b")]
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    plan = table().where(CONDITIONS["page"])._jdf.queryExecution()
    told = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [EqualTo(page,https://a.example/shop/1), LessThanOrEqual(date,2024-01-06)]" in told
    assert "shop" not in told.split("Condition :")[1]  # what was pushed isn't looked at again
