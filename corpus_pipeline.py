"""The corpus pipeline: quality rules, near copies, repeated passages, secrets, packing.

Each stage reads all that its predecessor wrote. Quality rules drop documents; the similarity join leaves one document of
each class; suffix deduplication removes repeated bytes from the texts (documents stay, though their text may become
empty); the secret scan masks findings; packing returns the pieces of the token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelume.llm.jaccard_join import keep_one
from pagelume.llm.packing import pack
from pagelume.llm.quality import apply_quality
from pagelume.llm.secrets import redact
from pagelume.llm.store import Scratch, table
from pagelume.llm.suffix_dedup import without_repeats


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts that they have now."""
    return docs.select(*[(F.length("text").cast("long") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_quality(spark, docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(spark, docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(without_repeats(spark, docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(redact(spark, docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("suffix_array_dedup", repeats_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the cutoffs, the join's classes or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
