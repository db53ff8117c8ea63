"""The streaming frontier against the batch rules, level by level, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from webgrain.config import AuditConfig
from webgrain.functions.urls import bucket, crawl_form
from webgrain.operators import crawl_rules
from webgrain.streaming import frontier


def levels():
    rng = random.Random(4)
    known = [f"https://a.example/{rng.choice(['s', 's', 's', 't', 'blog', 'tag/x'])}/{i}" for i in range(90)] + ["https://a.example/d/1/2/3/4"]
    again = lambda u: rng.choice([u, u + "#top", u + "?b=2&a=1", u + "?a=1&b=2"])
    return [[again(u) for u in rng.sample(known, 70)] + ["mailto:x", None] for _ in range(3)] + [["https://a.example/"]]


def batch(spark, config, given):
    """The same URLs by the batch rules: each level's new ones, judged with counts of the levels before."""
    seen, counted, out = set(), None, {}
    for rows in given:
        df = spark.createDataFrame([(u,) for u in rows], "url string").select(crawl_form(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
        new = spark.createDataFrame([(r["url"],) for r in df.collect() if r["url"] not in seen], "url string")
        judged = new.select("url", F.coalesce(bucket(F.col("url")), F.lit("")).alias("bucket"), crawl_rules.before_fetching(config, F.col("url")).alias("reason"))
        out |= {r["url"]: r["reason"] for r in judged.where("reason IS NOT NULL").collect()}
        marked, counts = crawl_rules.level_ceiling(judged.where("reason IS NULL"), counted, config.max_urls_per_path)
        out |= {r["url"]: "bucket_full" if r["over"] else None for r in marked.collect()}
        counted = spark.createDataFrame(counts.collect(), "bucket string, held long")
        seen |= {r["url"] for r in new.collect()}
    return out


@pytest.fixture
def rocks(spark):
    for k, v in frontier.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in frontier.STORE:
        spark.conf.unset(k)


def test_frontier_equals_the_batch_rules_over_restarts(spark, rocks, tmp_path):
    config = AuditConfig(start_url="https://a.example/", max_depth=3, max_urls_per_path=12, exclude_paths=("/blog",), exclude_archives=True)
    given, (source, out, mark) = levels(), (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in given:  # a query that starts anew from its checkpoint for each level
        spark.createDataFrame([(u,) for u in rows], "url string").coalesce(1).write.mode("append").parquet(source)
        frontier.drain(frontier.judged_urls(spark.readStream.schema("url string").parquet(source), config), out, mark)
    got = spark.read.parquet(out).collect()
    want = batch(spark, config, given)
    assert len(got) == len(want) and {r["url"]: r["reason"] for r in got} == want
    assert set(want.values()) == {None, "configured", "archive", "too_deep", "bucket_full"}


def test_a_batch_that_failed_is_taken_again_from_the_checkpoint(spark, rocks, tmp_path):
    config = AuditConfig(start_url="https://a.example/", max_urls_per_path=10)
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    urls = [f"https://a.example/s/{i:02}" for i in range(15)]
    spark.createDataFrame([(u,) for u in urls[:6]], "url string").coalesce(1).write.parquet(source)
    got, broken = [], [False]

    def sink(frame, batch_id):
        if broken[0]:
            raise RuntimeError("broke off")
        got.extend((r["url"], r["reason"]) for r in frame.collect())

    def run():
        stream = frontier.judged_urls(spark.readStream.schema("url string").parquet(source), config)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(source)
    broken[0] = True
    with pytest.raises(Exception, match="broke off"):
        run()
    broken[0] = False
    run()
    assert sorted(got) == [(u, None if i < 10 else "bucket_full") for i, u in enumerate(urls)]
