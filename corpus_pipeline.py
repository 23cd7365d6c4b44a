"""From raw documents to token ids: quality, language, near duplicates, mixture, encoding.

Each stage takes what its predecessor kept and, but for the last, returns the columns of documents.
Every stage passes columns of any names through, takes null ids and sources, and gives no rows for
an empty table. Null and empty texts are scored as empty ones, are in no known language (the second
stage drops them), have no near duplicates, and mix with size 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import language_id, mixing, ngram_join, piece_fst, quality
from corpusmill.llm.common import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels outside the held-out fold, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    return quality.keep_good(docs, quality.fit(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learnt from the rows outside the held-out fold."""
    return language_id.keep_known(docs, language_id.learn(docs.where(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, percent=80, width=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 at 150 % of all words; documents come as often as the sample draws them."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix, with the checksum of the text that they decode to."""
    return piece_fst.encode(docs, piece_fst.model_file())


STAGES = [("quality classifier", good_quality), ("language ID", known_language), ("n-gram Jaccard join", near_duplicates), ("mixing", mixture), ("SentencePiece", pieces)]

#: Classifiers can't be written in SQL; tests compare the operators with brute force, and each stage with what its operator says.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
