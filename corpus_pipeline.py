"""A corpus from raw documents: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the
columns of ``documents``; the last returns one row a packed piece.  ``n_chars``, where there is
one, follows a changed text.

In every stage: null and empty texts are documents without words, and very long ones are read whole;
repeated rows are judged alike (near duplicates keep one row of an id); null ids are kept as rows of
their own; an empty table gives an empty result; further columns of the table stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard, packing, quality, secrets
from tracelake.llm.common import cut, id_crc, release, small_batches, table
from tracelake.llm.queries import tokenizer_path


def _with_length(old: DataFrame, new: DataFrame, changed) -> DataFrame:
    if "n_chars" in old.columns:
        new = new.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*old.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the others go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)))
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    small_batches(spark)
    return jaccard.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; documents that are little else go as a whole."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), remove=True)
    return _with_length(docs, found, F.col("n_hit") > 0)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    small_batches(spark)
    return _with_length(docs, secrets.redact(docs, secrets.fit_crf(docs)), F.size("secrets") > 0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents, packed into sequences."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Training, suffix automata and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if k:
                release(before)
    return docs
