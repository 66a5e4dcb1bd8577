"""The corpus operators as queries over the standard tables; each derives its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamcast.llm import bpe, cover_tree, license_scan, line_dedup, lm_score, mixing, quality, simhash, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("__size") * F.col("copies")).alias("taken")
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", F.col("__size").alias("size"), "source_size", "target", taken)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, pattern)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = line_dedup.clean_pages(pages)
    return found.select("page_id", line_dedup.host(F.col("url")).alias("host"), F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), F.md5("html").alias("kept_md5"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.cut(_table(spark, sf_dir, "documents"), kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_licenses": op8_licenses,
    "op9_cover_tree": op9_cover_tree,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_cover_tree": cover_tree.ORACLE,
}
