"""A corpus from raw documents to packed token sequences, as written stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import line_dedup, nbsvm, packing, simhash, subsequence
from seriesloom.llm.common import read, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled documents, accepts."""
    model = nbsvm.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(nbsvm.probability(model)(F.col("text"))["score"] >= 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on labelled documents, lets pass."""
    model = subsequence.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(subsequence.probability(model)(F.col("text"))["score"] < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest number of each SimHash group."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; ``n_chars`` follows the text."""
    return line_dedup.cleaned(docs, n_chars="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_lines", without_repeats),
    ("packing", packed),
]

#: The classifiers are trained, fingerprints are XXH64 sums: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
