import atexit
import functools
import os
import shutil
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@functools.cache
def session():
    """The one session of a test run, with a shared folder of its own; both end with the run."""
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="webgrain-tests-")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{shared}",
    }
    made = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    atexit.register(made.stop)  # before the folder goes
    return made


@pytest.fixture
def spark():
    return session()


def rows_of(frame) -> list[tuple]:
    import pandas as pd

    null = lambda x: x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x)
    cols = sorted(frame.columns)
    return sorted((tuple(None if null(x) else x for x in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=str)


@functools.cache
def tables():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture
def same_as_sql(spark):
    """Compares a query with its SQL over the smallest tables."""
    con = tables()

    def check(query, sql):
        ours, theirs = query(spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        a, b = rows_of(ours), rows_of(theirs)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert all(p == q or (isinstance(p, float) and abs(p - q) < 1e-6) for p, q in zip(x, y, strict=True)), (x, y)

    return check
