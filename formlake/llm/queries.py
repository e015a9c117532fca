"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formlake.llm import (
    align, best_fit, bitpack, decontam, licenses, near_dup, ppm, quality, shards, topk, trie, urls, warc,
)
from formlake.llm.tokens import public_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_assignment(_table(spark, sf_dir, "documents"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=2, special_ids=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed_documents(_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=1, special_ids=True)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.topic_labels(pages)).drop("bad")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.document_files(_table(spark, sf_dir, "documents")), id_col="doc_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_figures(
        _table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_near_duplicates, op3_extendible_shards, op4_ppm_scores, op5_archives,
        op6_best_fit_packing, op7_quality_rules, op8_packed_tokens, op9_url_filter, op10_license_scan, op11_token_alignment,
        op12_top_k, op13_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_extendible_shards": shards.shard_sql(),
    "op7_quality_rules": quality.quality_sql(),
    "op10_license_scan": licenses.license_sql(),
    "op12_top_k": topk.top_k_sql(),
}
