"""A corpus from raw documents to packed token sequences, in five stages over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, line_dedup, ngram_jaccard, packing
from docloom.llm.common import drop
from docloom.operators.lineage import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected go: no letter, or far from every language learnt from the labelled ones. A missing
    lang is filled in."""
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, F.col("text").alias("whole"), "lang", "source", "n_chars").where("not rejected")
    return found.select("doc_id", F.col("whole").alias("text"), F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents at least stay in the one of the largest doc_id. A document stays, even
    when nothing of it is left."""
    kept = line_dedup.kept_lines(docs.select(*COLUMNS), line_dedup.repeated_lines(docs))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one of the smallest doc_id stays."""
    first = ngram_jaccard.ngram_jaccard(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(first, "doc_id", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_passages(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't say what a learnt language model and a tokenizer do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them; what a stage wrote for itself, and
    the rows that it read, are then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        read = docs
        docs = settled(lambda stage=stage, read=read: stage(spark, read, sf_dir))
        drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
