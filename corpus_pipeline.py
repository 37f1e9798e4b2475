"""Stages that turn `documents` into encoded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; written as Parquet and read again, it is the next one's
docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, nearcopies, quality, queries
from tessera.llm.common import Scratch, fresh, small_batches, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes. It learns from the raw documents, labels but for the held-out fold."""
    small_batches(spark)
    weights = quality.model(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").filter(f"not ({queries.HELD_OUT})"))
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, quality.scored(docs, weights)).filter(F.col(score) >= queries.QUALITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of the smallest id."""
    small_batches(spark)
    return nearcopies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document, or place, has."""
    small_batches(spark)
    out = lines.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text's bytes back."""
    small_batches(spark)
    ids = queries.tokenizer(spark).encode(docs.select("doc_id", "text"), same="round_trip")
    return ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL has no classifier and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, before = scratch.save(stage(spark, docs, sf_dir)), docs
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
