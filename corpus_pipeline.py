"""A corpus pipeline over ``documents``: language, quality, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and is written as Parquet in the
shared folder before the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import language_id, minhash, packing, quality_rules, secrets
from linkloom.llm.common import materialise, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter (null, empty and blank texts too) and those whose best language scores under 0.5."""
    return language_id.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail the base rule (null and empty texts have no words) or that the isolation forest finds anomalous."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows with the least doc_id of each component; texts without words, and rows without a doc_id, all stay."""
    return minhash.keep_one_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span in a text, and n_chars with it; a null text stays null, and no row goes."""
    return secrets.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the packing: the pieces of all documents with their sequence and offset; an empty text is one end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses none of the classifier, the components and the packing; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's defined results are those of its operator; an empty table stays one."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
