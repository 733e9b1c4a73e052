"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, secret scan, BPE digests.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
the documents. ``run`` writes each stage's documents to the shared folder and reads them again for the next; of two stages the first one's are dropped.

Null, empty and letterless texts are in no language, so the first stage drops them; null languages and sources do no harm. Of repeated rows (one doc_id, one text) all stay or all go, and of documents
that are near copies the one with the smallest doc_id stays; rows with null ids are kept with their own. Very long texts are read whole. Further columns, whatever their names, pass through all stages but the last, which gives the
columns of its digests. An empty table gives an empty table with those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import bpe, decontaminate, lang_id, near_dup, secrets
from tidecast.llm._shared import Scratch, small_batches

#: Documents whose language is predicted with a smaller probability go, as do those without a letter.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is told with a probability of ``MIN_SCORE`` or more."""
    small_batches(spark)
    return lang_id.keep(docs, lang_id.fit(docs), MIN_SCORE)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates, the document with the smallest doc_id."""
    return near_dup.keep_first(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; no document goes."""
    return secrets.redact(docs, secrets.fit())


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    import public_tokenizers

    return bpe.round_trip(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("near-dedup", dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("BPE", encoding)]
#: SQL can express neither the language model nor the network of the secret scan.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
