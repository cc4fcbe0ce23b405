"""A training corpus out of raw documents, stage by stage.

Every stage takes all that the one before it kept, as a Parquet table read
anew, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho.llm import linededup, ngramjoin, packing, pii, quality
from skyecho.llm.common import held_out, written
from skyecho.llm.queries import pii_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more; all, if there is nothing to learn from)."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return quality.accepted(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that match an earlier one; a document left without lines stays, empty."""
    return _recounted(linededup.dedup(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id. Rows that repeat an id stay or go together;
    rows without an id, which nothing tells apart, all stay."""
    kept = ngramjoin.similar(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms."""
    return _recounted(pii.apply(docs, pii_key(spark), count=None), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens: one row per piece of a document, with its id and no other column of the document."""
    # Stages share their executors: the tokenizer remembers less than by itself.
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=300_000)


def _recounted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The number of characters follows the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
