"""A corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents, and further columns of
docs whatever their names.  Null and empty texts go through as empty ones, very
long texts are read whole, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontaminate, langid, packing, secrets, simhash
from weir.llm.common import staged, unstaged, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language.

    A null or empty text rests on its lang and source, and goes where these are
    null too; repeated rows stay or go together.
    """
    return langid.accepted_rows(docs, F.col("lang"), F.col("source"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.

    Texts without words are one group; of repeated rows one stays; a null id
    stays only where its group has no other.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    A null text holds none, and an empty benchmark drops nothing; repeated rows
    stay or go together.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark and counts n_chars anew; a null text stays null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: The stages rest on trained models, hashing and a vocabulary; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    What a stage has written for itself, and what it has read, is removed once
    its own result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written()
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstaged(spark, since=before, but=kept)
        if hasattr(docs, "staged_path"):
            unstaged(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
