"""Corpus pipeline over documents: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage works on all rows that the one before it kept. A document that the quality rules reject
goes; boilerplate lines of its source go; one document of each group of near copies stays (four fifths
of the five-word shingles shared: SimHash fingerprints of 256 bits, compared in tiles, find the pairs and whole
sets settle them; 64 bits at op1's radius would miss most of them); the mix
repeats or leaves out documents to meet its sources' targets; the last stage returns token ids with
their round-trip digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamcast.llm import bpe, line_dedup, mixing, near_dedup, quality
from loamcast.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, F.col("source"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.simhash_keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, valid; a repeated document has a row each time."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_by_source),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing", mix_sources),
    ("byte-level bpe", bpe_tokens),
]

#: The stages aren't expressible in SQL (EM, XXH64, BPE); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
