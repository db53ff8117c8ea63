"""Stored runs, deletions and reports: what readers see when a step broke off, was repeated, or runs beside them."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from webgrain.sources import store

FINDINGS = "domain string, run_id string, fingerprint string"
RUNS = "domain string, run_id string, status string"


def run(spark, domain, run_id, *prints):
    return {
        "findings": spark.createDataFrame([(domain, run_id, p) for p in prints], FINDINGS),
        "deltas": spark.createDataFrame([(domain, run_id, p) for p in prints], FINDINGS),
        "runs": spark.createDataFrame([(domain, run_id, "x")], RUNS),
    }


def seen(spark, root, name="findings"):
    return sorted((r["domain"], r["run_id"], r[2]) for r in store.saved(spark, root, name).collect())


class Broken(RuntimeError):
    pass


def broken(*args, **kwargs):
    raise Broken


def test_a_save_that_broke_off_and_is_repeated_leaves_each_row_once(spark, tmp_path):
    root = str(tmp_path)
    store.save_run(run(spark, "a", "r1", "f"), root)
    second = run(spark, "a", "r2", "f", "g")
    half = spark.createDataFrame([("a", "r2", 1)], "domain string, run_id string, fingerprint int")
    with pytest.raises(Exception):  # noqa: B017  findings are written, deltas break off, runs are never reached
        store.save_run({**second, "deltas": half.withColumn("fingerprint", F.raise_error(F.lit("broke off")))}, root)
    assert seen(spark, root) == [("a", "r1", "f")]
    store.save_run(second, root)
    assert seen(spark, root) == [("a", "r1", "f"), ("a", "r2", "f"), ("a", "r2", "g")] == seen(spark, root, "deltas")
    store.save_run(run(spark, "a", "r2", "h"), root)  # saved whole again: the later one stands
    assert seen(spark, root) == [("a", "r1", "f"), ("a", "r2", "h")] and len(seen(spark, root, "runs")) == 2


def test_readers_beside_a_writer(spark, tmp_path):
    root = str(tmp_path)
    store.save_run(run(spark, "a", "r1", "f"), root)
    before = store.saved(spark, root, "findings")
    tables = run(spark, "a", "r2", "g")
    row = tables.pop("runs")
    store.save_run(tables, root)  # all but its row in runs: not there yet for those who read now
    assert before.count() == 1 and seen(spark, root) == [("a", "r1", "f")]
    store.save_run({**tables, "runs": row}, root)
    assert before.count() == 1  # who began before keeps what was there
    assert seen(spark, root) == [("a", "r1", "f"), ("a", "r2", "g")]


def test_tables_may_gain_columns_and_runs_may_lack_tables(spark, tmp_path):
    root = str(tmp_path)
    store.save_run(run(spark, "a", "r1", "f"), root)
    wider = run(spark, "a", "007", "g")
    wider["findings"] = wider["findings"].withColumn("severity", F.lit("info"))
    del wider["deltas"]
    store.save_run(wider, root)
    got = {r["run_id"]: r["severity"] for r in store.saved(spark, root, "findings").collect()}
    assert got == {"r1": None, "007": "info"} and seen(spark, root, "deltas") == [("a", "r1", "f")]
    with pytest.raises(ValueError):
        store.save_run({"runs": spark.createDataFrame([("a", "x", ""), ("a", "y", "")], RUNS)}, root)
    with pytest.raises(FileNotFoundError):
        store.saved(spark, str(tmp_path / "none"), "findings")


def filled(spark, root):
    for domain, run_id in (("a", "r1"), ("a", "r2"), ("b", "r3")):
        store.save_run(run(spark, domain, run_id, "f"), root)
    store.save_merge(spark, root, "c", "a")
    store.save_merge(spark, root, "d", "b")


OLD, NEW = [("a", "r1", "f"), ("a", "r2", "f"), ("b", "r3", "f")], [("b", "r3", "f")]


def test_deleting_a_domain_that_breaks_off_at_any_step(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    filled(spark, root)
    with pytest.raises(ValueError):
        store.delete_domain(spark, root, "a", "yes")
    with monkeypatch.context() as m:  # before the log: all is as it was
        m.setattr(store.history, "event", broken)
        with pytest.raises(Broken):
            store.delete_domain(spark, root, "a", "DELETE a")
    assert seen(spark, root) == OLD and store.merges(spark, root).count() == 2 and store.events(spark, root).count() == 0
    store.delete_domain(spark, root, "a", "DELETE a", "me")
    whole = lambda: (seen(spark, root), [r["source"] for r in store.merges(spark, root).collect()])
    assert whole() == (NEW, ["d"])  # from here on the domain is gone, whatever becomes of its files
    real = store._fs

    def fails_after(n):
        def fs(spark, root):
            inner, path = real(spark, root)

            class Fs:
                renames = 0

                def __getattr__(self, name):
                    return getattr(inner, name)

                def rename(self, a, b):
                    Fs.renames += 1
                    if Fs.renames > n:
                        raise Broken
                    return inner.rename(a, b)

                def delete(self, *args):
                    raise Broken

            return Fs(), path

        return fs

    for n in (0, 1, 3, 99):  # in the first rename, between renames, before the files are freed
        with monkeypatch.context() as m:
            m.setattr(store, "_fs", fails_after(n))
            with pytest.raises(Broken):
                store.purge(spark, root)
        assert whole() == (NEW, ["d"])
    assert list((tmp_path / "s" / "_quarantine").rglob("*.parquet"))
    assert store.purge(spark, root) == 0 and not (tmp_path / "s" / "_quarantine").exists()
    assert whole() == (NEW, ["d"]) and len(list((tmp_path / "s" / "findings").glob("attempt=*"))) == 1
    log = store.events(spark, root).collect()
    assert [(r["action"], r["domain"], r["actor"], r["attempts"]) for r in log] == [("DOMAIN_DELETED", "a", "me", 3)]
    store.save_run(run(spark, "a", "r9", "new"), root)  # the name may be used again
    assert seen(spark, root) == [("a", "r9", "new"), *NEW]


def test_deleting_a_run_with_all_its_attempts(spark, tmp_path):
    root = str(tmp_path)
    store.save_run(run(spark, "a", "r2", "older"), root)
    filled(spark, root)
    store.delete_run(spark, root, "r2", "DELETE r2")
    assert seen(spark, root) == [("a", "r1", "f"), ("b", "r3", "f")]  # the older attempt doesn't come up again
    assert store.purge(spark, root) == 6 and seen(spark, root) == [("a", "r1", "f"), ("b", "r3", "f")]
    with pytest.raises(KeyError):
        store.delete_run(spark, root, "nowhere", "DELETE nowhere")
    event = store.events(spark, root).collect()[0]
    assert (event["action"], event["run_id"], event["attempts"]) == ("RUN_DELETED", "r2", 2) and json.loads(event["details"]) == {}


def test_reports_keep_their_schemas(spark, tmp_path):
    shape = "k string, n long, x double, t timestamp, d date, a array<struct<u:string,n:int>>, m map<string,double>, none string, big decimal(20,4)"
    at = datetime.datetime(2026, 1, 2, 3, 4, 5, 678901)
    rows = [("é\n\"q\"", 1, float("nan"), at, at.date(), [("u", 1), (None, 2)], {"p": 0.5}, None, None), (None,) * 9]
    tables = {"full": spark.createDataFrame(rows, shape), "none": spark.createDataFrame([], shape), "nulls": spark.createDataFrame([(None,) * 9] * 3, shape)}
    tables["void"] = spark.range(1).select(F.lit(None).alias("v"), "id")
    store.save_report(tables, str(tmp_path), "r1")
    got = store.stored_report(spark, str(tmp_path), "r1", list(tables))
    plain = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema]
    for name in ("full", "none", "nulls"):
        assert plain(got[name]) == plain(tables[name])
        assert sorted(map(str, got[name].collect())) == sorted(map(str, tables[name].collect()))
    assert plain(got["void"]) == [("v", "string"), ("id", "bigint")] and got["void"].collect()[0]["id"] == 0
