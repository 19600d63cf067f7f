"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frailscope.llm import (
    alignment,
    decontamination,
    html_text,
    language_model,
    line_dedup,
    minhash,
    oracle,
    pieces,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    toxicity,
    url_filters,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_divergence_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_log_bilinear_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(_table(spark, sf_dir, "documents"))


def op5_class_conditional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_additive_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op7_suffix_array_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_deleted", text.alias("text_sha256"))


def op8_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(_table(spark, sf_dir, "pages"))


def op9_ownership_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op10_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the counts and scores, a digest of the ids (comma-joined) and a hash of the ids of each of the N best."""
    found = pieces.encode(_table(spark, sf_dir, "documents"), with_paths=True)
    scores = F.array_join(F.transform("nbest_scores", lambda x: x.cast("decimal(38,3)").cast("string")), ",")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    paths = F.array_join(F.transform("nbest_ids", lambda x: F.xxhash64(x).cast("string")), ",")
    return found.select(
        "doc_id",
        "n_pieces",
        "ids_hash",
        scores.alias("nbest_scores"),
        "round_trip",
        F.sha2(ids, 256).alias("ids_sha256"),
        paths.alias("nbest_hashes"),
    )


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_host_suffix_array_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_benchmark_decontamination,
        op2_divergence_quality_rules,
        op3_minhash_near_duplicates,
        op4_log_bilinear_language_model,
        op5_class_conditional_toxicity,
        op6_additive_quality_classifier,
        op7_suffix_array_line_dedup,
        op8_link_graph_url_filter,
        op9_ownership_secret_scan,
        op10_sentencepiece_n_best,
        op11_conversation_prefix_trie,
        op12_host_suffix_array_html,
        op13_cross_tokenizer_alignment,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
