"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import compact_windows, decontamination, lexical_search, mixing, neighbour_graph, ngram_join, page_text, quality, rule_cascade, secrets, sql, token_alignment, token_output, url_templates

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(_table(spark, sf_dir, "pages"))


def op3_descent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbour_graph.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_output.read_documents(token_output.write_sequences(docs, public_tokenizers.path(TOKENIZER)))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op2_novel_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op5_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(_table(spark, sf_dir, "pages"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.judged(_table(spark, sf_dir, "documents"))


def op12_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_alignment.aligned_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_suffix_text": op1_host_suffix_text,
    "op2_novel_secrets": op2_novel_secrets,
    "op3_descent_neighbours": op3_descent_neighbours,
    "op4_arrow_token_files": op4_arrow_token_files,
    "op5_shingle_components": op5_shingle_components,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_subword_quality": op7_subword_quality,
    "op8_url_templates": op8_url_templates,
    "op9_source_mixture": op9_source_mixture,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_rule_cascade": op11_rule_cascade,
    "op12_pair_bound_search": op12_pair_bound_search,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {"op11_rule_cascade": sql.RULE_CASCADE, "op12_pair_bound_search": sql.RANKED_SEARCH}
