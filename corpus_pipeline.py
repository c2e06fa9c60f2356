"""A corpus from raw documents: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. A table is deleted once the next one is written.

Defined cases: a null text counts as empty, and empty texts are scored, deduplicated (one stays), kept apart by the near-copy
stage, mixed and encoded like others; a null source is a source of its own; ids that are null or repeat name no row, so stages
delete rows, never ids; further columns go along whatever their names, up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import exact_dedup, mixing, ngram_join, quality_gam, queries, sentence_pieces
from stepweave.session import cut, discard, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from this stage's own input."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, Jaccard of 0.8 or more."""
    return ngram_join.keep_one(docs)


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return mixing.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    return sentence_pieces.encode_digests(docs, queries.tokenizer())


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies), ("mixing to target weights", in_mixture), ("SentencePiece", tokens)]

#: Neither a boosted model, components nor tokens can be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            discard(before)
    return docs
