"""The corpus pipeline: quality, toxicity, near duplicates, personal data, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelake.llm import packing, pii, quality_model, shingle_sets, toxicity
from carelake.llm.common import MADE, discard, staged, table
from carelake.llm.registry import word_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over five-word shingles stays, the one with the least id.

    SimHash fingerprints that the vantage-point tree links within two bits are candidates. Most such pairs are farther apart (about ten bits, and no
    tree prunes at that radius), so minima of shingle hashes bring more candidates. The sets themselves decide all of them.
    """
    return shingle_sets.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; all documents stay."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs, word_vocabulary())


STAGES = [("quality_classifier", quality), ("toxicity", toxic), ("simhash_near_dedup", near_dedup), ("pii", personal_data), ("best_fit_packing", packed)]
#: SQL has neither the models nor the shingle hashes and tokens, so the tests hold each stage against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table.

    Each stage's rows are written and read again. What a stage staged on its way, and what it read, is deleted once its own rows are written; the
    last stage's tables stay, as the result reads them.
    """
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = len(MADE)
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(spark, [*kept, *MADE[before:-1]])
        kept = MADE[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
