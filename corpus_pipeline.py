"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table: all but the last return the columns of their docs.  A stage
works on all that its predecessor kept.  Stages may read docs more than once; `run` stores each result in the shared
folder before the next stage reads it.

Nulls, empty tables and repeated rows are handled as each operator's docstring says: documents without words fail the
base quality rule; equal rows are near-duplicates of each other and one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gearfinch.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from gearfinch.llm.texts import small_batches, stored, table, text_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified threshold rejects go."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go from the texts; all documents stay.  n_chars follows the new text."""
    small_batches(spark)
    found = line_dedup.deduplicated(docs)
    kinds = dict(docs.dtypes)
    own = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("row.text")).otherwise(own["n_chars"]).cast(kinds["n_chars"])
    return found.select(*(own[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id."""
    small_batches(spark)
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go.  The verdict hangs on the text alone, so
    it is joined by the text's digest."""
    digest = text_key(docs, F.coalesce("text", F.lit("")))
    verdict = decontaminate.contamination(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(verdict.where("contaminated").select(F.col("doc_id").alias("__digest")).distinct(), "contaminated")
    return docs.withColumn("__key", digest).join(gone, F.col("__key") == F.col("__digest"), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
]

#: Certified thresholds, verified sketches and drawn blocks are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
