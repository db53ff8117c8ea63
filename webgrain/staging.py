"""Tables in the folder that driver and executors share: where lineage is cut and lost executors do no harm."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and all run on one
    machine; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webgrain-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return (f"file://{base}" if base.startswith("/") else base).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a file where their number is known beforehand: small tables aren't strewn over as many files as tasks.
ROWS_A_FILE = 100_000


def staged(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: computed once, and durable. rows: about how many it has,
    if that is known; few rows then make few files (and few tasks write them)."""
    path = fresh_path(df.sparkSession, name)
    if rows is not None and (files := rows // ROWS_A_FILE + 1) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
