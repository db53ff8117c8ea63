"""Runs over time: fingerprints of findings, deltas between runs, comparability, trends, merging and deleting domains."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgrain.functions.text import fingerprint
from webgrain.functions.urls import history_form

RULESET = "1"
VOLATILE_SETTINGS = ("concurrency", "delay_ms", "user_agent")


def finding_fingerprint(domain: Column, url: Column, rule: Column, evidence: Column) -> Column:
    """Identity of a finding across runs; evidence tells apart broken links, structured data and mixed content only."""
    detail = F.when(
        (rule == "broken_link") | rule.contains("schema") | rule.contains("mixed_content"), F.coalesce(evidence, F.lit(""))
    ).otherwise("")
    return fingerprint(domain, history_form(url), rule, detail)


def config_fingerprint(config: dict) -> str:
    kept = {k: v for k, v in config.items() if k not in VOLATILE_SETTINGS}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def scan_type(config: dict) -> str:
    full = all(config.get(k) for k in ("page_speed", "analyze_images", "report_broken_links", "analyze_schema"))
    most = config.get("max_pages")
    return "FULL" if most is None and full else "QUICK" if most and most <= 50 else "CUSTOM"


def run_sequence(runs: DataFrame) -> DataFrame:
    """runs (domain, run_id, generated_at, config_fp, ruleset) with the previous run and how the two compare."""
    w = Window.partitionBy("domain").orderBy("generated_at", "run_id")
    lagged = runs.withColumn(
        "previous_run", F.lag("run_id").over(w)
    ).withColumn("pc", F.lag("config_fp").over(w)).withColumn("pr", F.lag("ruleset").over(w)).withColumn("n", F.row_number().over(w))
    status = (
        F.when(F.col("previous_run").isNull(), "BASELINE")
        .when(F.col("pr") != F.col("ruleset"), "NOT_COMPARABLE")
        .when(F.col("pc") != F.col("config_fp"), "PARTIAL")
        .otherwise("COMPARABLE")
    )
    return lagged.withColumn("comparison", status).drop("pc", "pr")


def finding_deltas(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(domain, run_id, fingerprint, state) of every comparable run against the one before.

    One pass over each fingerprint's history: the gap to its last run tells persisting (1), reopened (more) and opened
    (none); a run in which it was and whose successor lacks it gives resolved there. Duplicate fingerprints of a run are one.
    """
    seq = run_sequence(runs).select("domain", "run_id", "n", "comparison")
    seen = findings.select("run_id", "fingerprint").distinct().join(seq, "run_id")
    w = Window.partitionBy("domain", "fingerprint").orderBy("n")
    marked = seen.withColumn("before", F.lag("n").over(w)).withColumn("after", F.lead("n").over(w))
    state = F.when(F.col("before") == F.col("n") - 1, "PERSISTING").when(F.col("before").isNotNull(), "REOPENED").otherwise("OPENED")
    now = marked.where(
        ~F.col("comparison").isin("BASELINE", "NOT_COMPARABLE")
    ).select("domain", "run_id", "fingerprint", state.alias("state"))
    gone = marked.where(
        F.col("after").isNull() | (F.col("after") != F.col("n") + 1)
    ).select("domain", (F.col("n") + 1).alias("n"), "fingerprint")
    resolved = gone.join(seq, ["domain", "n"]).where(~F.col("comparison").isin("BASELINE", "NOT_COMPARABLE")).select(
        "domain", "run_id", "fingerprint", F.lit("RESOLVED").alias("state")
    )
    return now.unionByName(resolved)


def delta_counts(deltas: DataFrame) -> DataFrame:
    states = ("OPENED", "PERSISTING", "REOPENED", "RESOLVED")
    return deltas.groupBy("domain", "run_id").agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in states])


def latest_runs(runs: DataFrame) -> DataFrame:
    """Runs and the latest one of each domain."""
    return runs.groupBy("domain").agg(
        F.count("*").alias("runs"),
        F.max_by("run_id", F.struct("generated_at", "run_id")).alias("latest_run"),
        F.max("generated_at").alias("latest_at")
    )


def merge_domains(runs: DataFrame, merges: DataFrame) -> DataFrame:
    """runs re-pointed by merges (source, target); a domain can't be merged into itself."""
    clean = merges.where("source <> target")
    return runs.join(
        clean, F.col("domain") == F.col("source"), "left"
    ).withColumn("domain", F.coalesce("target", "domain")).drop("source", "target")


EVENTS = "action string, domain string, run_id string, actor string, details string, at timestamp"


def event(spark: SparkSession, action: str, domain: str | None, run_id: str | None, actor: str, **details) -> DataFrame:
    """One row for the log of what was done to the history."""
    row = (action, domain, run_id, actor, json.dumps(details, sort_keys=True, default=str))
    return spark.createDataFrame([row], ", ".join(EVENTS.split(", ")[:5])).withColumn("at", F.current_timestamp())


def confirmed(what: str, confirmation: str) -> None:
    if confirmation != f"DELETE {what}":
        raise ValueError(f"confirm with: DELETE {what}")


def delete_run(runs: DataFrame, run_id: str, confirmation: str) -> DataFrame:
    """runs without one, if the caller typed what it asks for."""
    confirmed(run_id, confirmation)
    return runs.where(F.col("run_id") != run_id)


def delete_domain(
    tables: dict[str, DataFrame], domain: str, confirmation: str, actor: str = "local"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables (with column domain) without a domain's rows, merges from or to it included, and the event to log; the
    caller must have typed what it asks for. The log itself stays."""
    confirmed(domain, confirmation)
    left = {}
    for name, df in tables.items():
        if name == "events":
            left[name] = df
        elif name == "merges":
            left[name] = df.where(~F.col("source").eqNullSafe(F.lit(domain)) & ~F.col("target").eqNullSafe(F.lit(domain)))
        else:
            left[name] = df.where(~F.col("domain").eqNullSafe(F.lit(domain)))
    spark = next(iter(tables.values())).sparkSession
    return left, event(spark, "DOMAIN_DELETED", domain, None, actor, tables=sorted(tables))


def domain_trend(runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """(domain, runs): each domain's runs in order of time as one array, each with its deltas (fingerprint, state)."""
    changes = F.array_sort(F.collect_list(F.struct("fingerprint", "state"))).alias("deltas")
    per_run = deltas.groupBy("domain", "run_id").agg(changes)
    both = runs.join(per_run, ["domain", "run_id"], "left")
    fields = ["generated_at", "run_id", *[c for c in runs.columns if c not in ("domain", "run_id", "generated_at")]]
    return both.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct(*fields, "deltas"))).alias("runs"))
