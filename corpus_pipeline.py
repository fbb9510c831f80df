"""The stages that turn `documents` into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of `documents`, in their order; other columns of the input are kept as they are. A stage decides
about a row from its own operator's result. Rows without a doc_id stay until the token files, where they come first;
rows with equal doc_ids are rows of their own in every stage but the near-duplicate one, which keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsieve.llm import decontamination, mixing, ngram_join, quality, token_output
from ionsieve.llm.tables import written

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of those that are there."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; documents without words all stay."""
    found = ngram_join.similar_components(docs)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    if others.count() <= ngram_join.BROADCAST_IDS:
        others = F.broadcast(others)
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    # Only rows that share a doc_id have to meet; nearly all rows stay where they are.
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if repeated.count() == 0:
        return kept
    alone = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return alone.unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares that the sources' targets ask for: repeated, left out, or cut where a quota ends."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in Arrow files; returns what the files say of each document."""
    return token_output.read_documents(token_output.write_sequences(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_files),
]

# The stages train a model, hash and tokenize; SQL cannot express them. tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written, and the next one reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
