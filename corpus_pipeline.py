"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of documents, but for the last one,
which returns the pieces of packed sequences. run() applies all stages to the table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import lines, minhash, mixing, packing, quality
from webgrain.llm.common import staged


#: Rows that go, or repeat, up to which their keys are broadcast (16 bytes each); beyond, they are joined by shuffling.
BROADCAST_KEYS = 500_000


def _with_row(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, beside all columns of docs as one struct: no name can clash with its own."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted are those labelled good and not toxic.

    Defined results: null, empty and blank texts fail the base rules and go; a null id is never trusted; repeated rows share
    one verdict, and are all kept or all gone; very long texts are read whole; an empty table stays empty; columns of any
    name pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality_rules(_with_row(docs, "doc_id", "text"), quality.trusted_ids(labels))
    return judged.where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that repeat earlier ones; n_chars follows, a document left without a word goes.

    Defined results: a null or empty text has nothing to lose and stays, a blank one too; null ids come last in the order;
    rows of equal id and text lose the same lines; very long texts and lines are handled whole; an empty table stays empty;
    columns of any name pass through, and n_chars need not be among them.
    """
    out = lines.dedup_lines(_with_row(docs, "doc_id", "text"), exact_chars=lines.EXACT_CHARS)
    changed = F.col("n_removed_lines") > 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    left = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[(new.get(c) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Documents are told apart by id and text, so a text that is no copy stays though another has its id.
    Defined results: null ids come last in a group's order, and go like others; of rows with equal id and text one stays,
    the first by its other columns; texts without words are copies of nothing, so each stays (once to an id); very long texts
    are compared whole; an empty table stays empty; columns of any name pass through.
    """
    found = staged(minhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "text_hash", "stays"), "pipeline-groups")
    gone = found.where("NOT stays").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    twice = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.count("*").alias("n"), F.min("stays").alias("s"))
    twice = staged(twice.where("n > 1 AND s").select("d", "h"), "pipeline-twice")
    rows = _with_row(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    held = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    marked = rows.join(held(staged(gone, "pipeline-gone")), same, "left_anti").join(held(twice), same, "left")
    # of those rows alone: the first by all columns, whatever their types, so that the same one stays in every run
    repeated = marked.where("h IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return marked.where("h IS NULL").select("row.*").unionByName(repeated.select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, as many rows as there are documents in expectation; copies have equal ids.

    Defined results: a null source is a source of its own; null ids share one random number; null, empty and very long texts
    pass through untouched; repeated rows get equal counts; an empty table stays empty; columns of any name pass through.
    """
    return mixing.mixed(_with_row(docs, "doc_id", "source")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    Defined results: null and empty texts are the end id alone; null ids pass through; repeated rows (copies of the mixture)
    are packed each; very long texts fill windows of their own; an empty table gives no piece; other columns are ignored.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the 64-bit hashes of the quality score, code-point edit distances and token ids; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
