"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bm25 import top_k
from cadenza.llm.decontamination import contaminated_spans
from cadenza.llm.filter_audit import filter_audit
from cadenza.llm.html_text import extracted
from cadenza.llm.jaccard_join import jaccard_classes
from cadenza.llm.language_id import language_id
from cadenza.llm.mixing import mix_sources
from cadenza.llm.packing import Limits, pack_documents
from cadenza.llm.pii import BASE, personal_data, written_spans
from cadenza.llm.prefix_trie import ordered_turns, prefix_trie, spliced
from cadenza.llm.sql import ORACLES
from cadenza.llm.substring_dedup import deduplicated
from cadenza.llm.token_counts import token_counts
from cadenza.llm.token_records import token_records


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    n_hit = F.aggregate("hit", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_docs(spark, sf_dir))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written_spans("base").cast("binary"), 256).alias("base_sha256"), written_spans("spans").alias("spans"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_docs(spark, sf_dir), k=5, percent=80)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(_docs(spark, sf_dir), run=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return top_k(docs, docs.filter(F.col("doc_id") % 100 == 0), k=10)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_docs(spark, sf_dir))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_docs(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(spliced(turns, F.expr("conv - conv % 5"), F.crc32(F.col("conv").cast("string").cast("binary")) % 9))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), Limits(1024), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by its name."""
    return {f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_decontamination, op4_pii, op5_ngram_jaccard_join, op6_substring_dedup, op7_exact_top_k, op8_language_id, op9_token_records, op10_mix_sources, op11_conversation_trie, op12_filter_audit, op13_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express. HTML rendering, tokenizers, span
    discovery, a trained model and files have none; they are tested against
    the libraries, brute force, held-out accuracy and round trips."""
    return dict(ORACLES)
