"""A corpus pipeline: toxicity, exact dedup, near dedup, PII surrogates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet into the shared folder and gives
what it reads back to the next one. Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column
names are defined by the operator of each stage; all stages but the last keep the columns of docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import common, exact, nearcopies, packing, pii, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model, fitted on the labels of sf_dir, rejects. Null and empty texts get the score
    of a text without terms; repeated rows are judged alike; without labels nothing is rejected."""
    return toxicity.toxicity_stage(docs, common.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: most code points, then smallest doc_id; null texts are empty ones."""
    return exact.exact_stage(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8): the smallest doc_id; texts without words are one component."""
    return nearcopies.near_duplicate_stage(docs)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with surrogates for personal data in the texts; null texts stay null."""
    return pii.surrogate_stage(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit), sequence_id, offset. A null text has its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", without_private_data),
    ("packing", packed),
]

#: The stages fit a model, link fingerprints and pack bins: SQL can't express them; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole `documents` of sf_dir; the rows of the last one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
