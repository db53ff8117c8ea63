"""Stored runs: tables appended attempt by attempt, read back as reports; deletions; reports as folders of JSON."""

from __future__ import annotations

import json
import time
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webgrain.operators import history

RUN_TABLES = ("findings", "page_metrics", "deltas")


def inside(root: str, path: str) -> str:
    """path, if it lies below root; else an error. Both are plain or shared-store paths."""

    def parts(p: str) -> tuple[str, ...]:
        scheme, _, rest = p.partition("://") if "://" in p else ("file", "", p)
        out: list[str] = [scheme]
        for x in PurePosixPath("/" + rest.lstrip("/")).parts[1:]:
            if x == "..":
                if len(out) < 2:
                    raise ValueError(f"{p} leads out of its store")
                out.pop()
            elif x != ".":
                out.append(x)
        return tuple(out)

    top, own = parts(root), parts(path)
    if own[: len(top)] != top or own == top:
        raise ValueError(f"{path} isn't below {root}")
    return path


def _attempt() -> str:
    """A name for one attempt to write something; later ones are greater."""
    return f"a{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _read(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame | None:
    path = f"{root}/{name}"
    if not _exists(spark, path):
        return None if schema is None else spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("mergeSchema", schema is None).parquet(path)


def save_run(tables: dict[str, DataFrame], root: str) -> str:
    """Saves a run (one domain, one run_id) and returns the name of this attempt.

    Each table's rows go to a folder of the attempt; the row in `runs`, one file that appears at once, comes last and names the
    attempt. Readers take from all tables what a row in `runs` names, and of two attempts at one run the later, so a save
    that broke off leaves nothing behind for them, and one that is repeated leaves each row once.
    """
    attempt = _attempt()
    for name in (n for n in tables if n != "runs"):
        tables[name].withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{root}/{name}")
    if "runs" in tables:
        row = tables["runs"].withColumn("saved_tables", F.array(*[F.lit(n) for n in sorted(tables)]).cast("array<string>"))
        if len(row.select("domain", "run_id").limit(2).collect()) != 1:
            raise ValueError("a run has one row in runs")
        row.coalesce(1).withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{root}/runs")
    return attempt


def live_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of `runs` that stand, with their attempts: the latest of each run, less deleted ones; None if none was saved."""
    runs = _read(spark, root, "runs")
    if runs is None:
        return None
    gone = _read(spark, root, "events", EVENT_ROWS).select("attempt").where("attempt IS NOT NULL")
    latest = Window.partitionBy("domain", "run_id").orderBy(F.desc("attempt"))
    standing = runs.join(gone, "attempt", "left_anti")
    return standing.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def saved(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows of the runs that stand. Of other attempts not even files are opened (partitions by attempt)."""
    runs = live_runs(spark, root)
    if runs is None:
        raise FileNotFoundError(f"no run was saved in {root}")
    if name == "runs":
        return runs.drop("attempt", "saved_tables")
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").join(runs.select("attempt"), "attempt", "left_semi").drop("attempt")


def save_merge(spark: SparkSession, root: str, source: str, target: str) -> None:
    """Files a merge of domains: runs of source count as target's."""
    if source == target:
        raise ValueError("a domain can't be merged into itself")
    row = spark.createDataFrame([(source, target, _attempt())], "source string, target string, attempt string")
    row.coalesce(1).write.mode("append").parquet(f"{root}/merges")


def merges(spark: SparkSession, root: str) -> DataFrame:
    """The merges (source, target) that stand."""
    every = _read(spark, root, "merges", "source string, target string, attempt string")
    gone = _read(spark, root, "events", EVENT_ROWS).select("attempt").where("attempt IS NOT NULL")
    return every.join(gone, "attempt", "left_anti").drop("attempt")


#: The log of deletions: a row for each attempt that is deleted, or one without, all rows of an event in one file.
EVENT_ROWS = "event_id string, action string, domain string, run_id string, actor string, details string, at timestamp, attempt string"


def events(spark: SparkSession, root: str) -> DataFrame:
    """What was deleted, when and by whom: a row for each event."""
    rows = _read(spark, root, "events", EVENT_ROWS)
    return rows.groupBy(*[c.split()[0] for c in EVENT_ROWS.split(", ")[:-1]]).agg(F.count("attempt").alias("attempts"))


def _delete(spark: SparkSession, root: str, action: str, doomed: DataFrame, domain: str | None, run_id: str | None, actor: str) -> str:
    """Logs the deletion of attempts (attempt): from the moment that this file appears, they are gone for readers."""
    event_id = _attempt()
    log = history.event(spark, action, domain, run_id, actor).select(F.lit(event_id).alias("event_id"), "*")
    log.join(doomed.distinct(), F.lit(True), "left").coalesce(1).write.mode("append").parquet(f"{root}/events")  # one row by many
    return event_id


def delete_run(spark: SparkSession, root: str, run_id: str, confirmation: str, actor: str = "local") -> str:
    """Deletes a run for good, if the caller typed what it asks for; returns the event's id. See purge for its files."""
    history.confirmed(run_id, confirmation)
    runs = _read(spark, root, "runs")
    if runs is None or runs.where(F.col("run_id") == run_id).isEmpty():
        raise KeyError(run_id)
    return _delete(spark, root, "RUN_DELETED", runs.where(F.col("run_id") == run_id).select("attempt"), None, run_id, actor)


def delete_domain(spark: SparkSession, root: str, domain: str, confirmation: str, actor: str = "local") -> str:
    """Deletes a domain's runs, and the merges from and to it; else like delete_run. The log itself stays."""
    history.confirmed(domain, confirmation)
    runs = _read(spark, root, "runs", "domain string, attempt string")
    both = _read(spark, root, "merges", "source string, target string, attempt string")
    doomed = runs.where(F.col("domain") == domain).select("attempt").unionByName(
        both.where((F.col("source") == domain) | (F.col("target") == domain)).select("attempt")
    )
    return _delete(spark, root, "DOMAIN_DELETED", doomed, domain, None, actor)


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def quarantine(spark: SparkSession, root: str) -> int:
    """Moves the folders of deleted attempts out of the tables, one rename each; returns how many it moved."""
    fs, path = _fs(spark, root)
    tables = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory() and not s.getPath().getName().startswith("_")]
    moved = 0
    rows = _read(spark, root, "events", EVENT_ROWS).where("attempt IS NOT NULL").select("attempt").distinct()
    for r in rows.toLocalIterator():
        for t in tables:
            own = path(f"{root}/{t}/attempt={r['attempt']}")
            if fs.exists(own):
                away = path(f"{root}/_quarantine/{t}")
                fs.mkdirs(away)
                if not fs.rename(own, path(f"{root}/_quarantine/{t}/attempt={r['attempt']}")):
                    raise OSError(f"{own} can't be moved")
                moved += 1
    return moved


def purge(spark: SparkSession, root: str) -> int:
    """Frees the space of what was deleted: files leave the tables first, then the store. It may break off anywhere and be
    called again; readers see neither, as the log already hides those attempts. To be called when no reader that began
    before the deletion is still at work. Returns how many folders it moved."""
    fs, path = _fs(spark, root)
    moved = quarantine(spark, root)
    fs.delete(path(f"{root}/_quarantine"), True)
    return moved


TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def save_report(tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """A report's tables as JSON, a folder each, below root/run_id, with their schemas beside them."""
    path = inside(root, f"{root}/{run_id}")
    for name, df in tables.items():
        void = [f.name for f in df.schema if f.dataType.typeName() == "void"]
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in void})
        df.write.mode("overwrite").options(**TIMES).json(f"{path}/{name}")
        schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
        schema.coalesce(1).write.mode("overwrite").text(f"{path}/_schemas/{name}")
    return path


def stored_report(spark: SparkSession, root: str, run_id: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a stored report again, with the schemas that they were saved with: empty tables and columns without any
    value too. A report without schemas is read by looking at its values."""
    path = inside(root, f"{root}/{run_id}")
    found = {}
    for name in names:
        reader = spark.read.options(**TIMES)
        if _exists(spark, f"{path}/_schemas/{name}"):
            schema = spark.read.text(f"{path}/_schemas/{name}").collect()[0][0]
            reader = reader.schema(StructType.fromJson(json.loads(schema))).option("mode", "FAILFAST")
        found[name] = reader.json(f"{path}/{name}")
    return found


def page_metrics(pages: DataFrame, domain: str, run_id: str) -> DataFrame:
    """What is kept of each page of a run; eligible tells pages that structured data is asked of."""
    return pages.select(
        F.lit(domain).alias("domain"),
        F.lit(run_id).alias("run_id"),
        *["url", "page_type", "status", "indexable", "incoming", "depth", "orphan", "content_age_days"],
        F.lit(True).alias("schema_eligible"),
        F.col("has_schema").alias("schema_appropriate"),
    )


def run_row(report: dict[str, DataFrame], domain: str, run_id: str, generated_at: str, config_fp: str, ruleset: str) -> DataFrame:
    """A run's row: the summary's figures with severity counts, and what tells runs apart."""
    head = [
        F.lit(domain).alias("domain"),
        F.lit(run_id).alias("run_id"),
        F.to_timestamp(F.lit(generated_at)).alias("generated_at"),
        F.lit(config_fp).alias("config_fp"),
        F.lit(ruleset).alias("ruleset")
    ]
    counts = report["health"].select("critical", "warning", "info")
    return report["summary"].crossJoin(F.broadcast(counts)).select(*head, "*")  # one row each
