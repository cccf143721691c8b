"""A training-data pipeline over ``documents``: quality rules, language, lines, near-duplicates, packing.

Each stage works on all rows that the one before it kept. All but the last return the columns of
``documents``, extra columns of any name included; the last returns packed token pieces. An empty
table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, lines, nearcopies, packing, rules
from tidemark.llm.common import settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weakly supervised rules keep. Null, empty and very short texts go; repeated rows and
    ties are judged alike; rows with a null id are judged like any other."""
    return rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the string kernel knows. Texts that are null, empty or without a letter go, and
    all texts if no row has a language to learn from; ids and repeated rows have no influence."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without cross-site boilerplate; ``n_chars`` follows the text. Null and empty
    texts stay so, a text of boilerplate alone becomes empty, rows with a null id are not changed."""
    return lines.clean_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest ``doc_id``, of each group of near-duplicates: five-word shingles, a
    Jaccard similarity of 0.8 or more. Texts without a word are one group; rows with a null id stay."""
    return nearcopies.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows with their place in a sequence. Null and empty texts are the end id alone;
    repeated rows and null ids are pieces of their own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Vote models, kernels and fingerprints aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
