"""Each stage of the pipeline on null, empty, repeated and clashing input; columns that look like an operator's own."""

import atexit
import functools
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webgrain.llm import mixing, quality

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha"
B = A.replace("t", "w").replace("e", "o")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["kept", "copy", "__u", "row", "d", "h", "text_hash", "stays", "N_COPIES", "__source", "__whole", "__w", "a.b", "llr", "gone", "n_lines"]
ROWS = [(3, A), (5, A), (5, B), (None, A), (7, None), (8, ""), (9, " \n\t "), (9, " \n\t "), (None, None), (11, B + " own"), (11, B + " own"), (12, "x" * 50_000), (13, "own words " * 9_000)]


@pytest.fixture
def given(spark):
    df = spark.createDataFrame([(i, t, "en" if t else None, "web" if i != 9 else None, len(t or "") or None) for i, t in ROWS], SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in EXTRA})


@functools.cache
def labels_folder(spark):
    path = tempfile.mkdtemp(prefix="webgrain-labels-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.createDataFrame([(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture
def sf_dir(spark):
    return labels_folder(spark)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_and_take_any_rows(spark, given, sf_dir, name, stage):
    out = stage(spark, given, sf_dir)
    assert out.columns == given.columns
    assert all(r[c] == f"own {c}" for r in out.collect() for c in EXTRA)
    empty = stage(spark, given.limit(0), sf_dir)
    assert empty.columns == given.columns and empty.count() == 0
    plain = stage(spark, given.select("doc_id", "text", "source"), sf_dir)
    assert plain.columns == ["doc_id", "text", "source"] and plain.count() == out.count()


def texts(frame):
    return sorted(((r["doc_id"], (r["text"] or "")[:60], r["text"] is None) for r in frame.collect()), key=str)


def test_quality_stage(spark, given, sf_dir):
    got = texts(corpus_pipeline.quality_stage(spark, given, sf_dir))
    assert {3, 5, None} <= {i for i, _, _ in got} and not {7, 8, 9, 12} & {i for i, _, _ in got}


def test_line_stage(spark, given, sf_dir):
    got = {(r["doc_id"], r["text"]): r["n_chars"] for r in corpus_pipeline.line_stage(spark, given, sf_dir).collect()}
    assert (3, A) in got and (5, A) not in got and (None, A) not in got and (5, B) in got
    assert (7, None) in got and (8, "") in got and (9, " \n\t ") in got and got[12, "x" * 50_000] == 50_000


def test_near_duplicates_are_told_apart_by_id_and_text(spark, given, sf_dir):
    got = texts(corpus_pipeline.near_duplicate_stage(spark, given, sf_dir))
    want = [(3, A), (5, B), (7, None), (8, ""), (9, " \n\t "), (None, None), (12, "x" * 50_000), (13, "own words " * 9_000)]
    assert got == sorted(((i, (t or "")[:60], t is None) for i, t in want), key=str)


def test_near_duplicates_beyond_the_broadcast_bound(spark, given, sf_dir, monkeypatch):
    want = texts(corpus_pipeline.near_duplicate_stage(spark, given, sf_dir))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", -1)
    assert texts(corpus_pipeline.near_duplicate_stage(spark, given, sf_dir)) == want


def test_packing_stage(spark, given, sf_dir):
    got = corpus_pipeline.packing_stage(spark, given, sf_dir)
    assert got.where("start = 0").count() == len(ROWS) and got.agg(F.min("length")).collect()[0][0] > 0
    assert corpus_pipeline.packing_stage(spark, given.limit(0), sf_dir).count() == 0


def test_operators_replace_their_own_names_in_either_case(spark, given):
    out = mixing.mixed(given)
    assert [c.lower() for c in out.columns].count("n_copies") == 1 and all(r["__u"] == "own __u" and r["a.b"] == "own a.b" for r in out.collect())
    judged = quality.quality_rules(given.withColumn("KEPT", F.lit("x")), given.select("doc_id").limit(0))
    assert [c.lower() for c in judged.columns].count("kept") == 1 and all(r["__w"] == "own __w" for r in judged.collect())


def test_rows_of_equal_id_and_text_leave_the_same_one(spark, sf_dir):
    rows = [(1, A, "en", s, 5) for s in ("web", "books", "news")] + [(2, B, "en", "web", 5)]
    kept = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, SCHEMA).repartition(3)
        kept.append(sorted(tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()))
    assert kept[0] == kept[1] == [(1, A, "en", "books", 5), (2, B, "en", "web", 5)]


def test_null_and_equal_ids_are_dealt_out(spark):
    """The mixture's rows of one id, or of none, lie in many partitions."""
    rows = [(None if i % 2 else 7, f"text {i}", "en", "web", 5) for i in range(4000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = mixing.mixed(spark.createDataFrame(rows, SCHEMA), size=40_000).groupBy("doc_id", F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in {r["doc_id"] for r in found}:
        sizes = [r["count"] for r in found if r["doc_id"] == i]
        assert len(sizes) == parts and max(sizes) < 2 * sum(sizes) / parts
