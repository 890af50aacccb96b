"""Corpus pipeline: documents in, encoded training mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import language_id, ngram_jaccard, pii, sentencepiece_codec, source_mixing
from lexloom.llm.common import release, stored

#: The encoder's vocabulary. Words of a shingle and the similarity of near duplicates.
PIECE_MODEL, SHINGLE, SIMILAR = "piece_bpe_32k.model", 5, (80, 100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without any letter go, as do longer ones that are like no language
    that was learned; where lang is null it becomes the predicted one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~language_id.held_out())
    return language_id.keep_identified(docs, language_id.learn(rows))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest doc_id
    stays. Rows with a null doc_id are linked with nothing and stay."""
    groups = ngram_jaccard.ngram_jaccard_join(docs, SHINGLE, *SIMILAR)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first.hint("merge"), "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every document stays; its personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents are repeated or left out by Poisson draws."""
    return source_mixing.replicate(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: number of ids and digests of ids and decoded text per document."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path(PIECE_MODEL), digests=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learned prototypes and merges by score are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
