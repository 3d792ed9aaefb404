"""The corpus pipeline: documents go through five operators; each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. The first four return the columns of documents; the
last returns the packed pieces. Stages on word shingles take five words and a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, kneser_ney, minhash, packing, pii
from lodestar.llm.queries import table, tokenizer_path
from lodestar.llm.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"), min_count=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (rows with a null
    doc_id stay; of repeated rows with one doc_id one stays)."""
    return minhash.deduplicate(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes placeholders; n_chars follows the text."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece."""
    pieces = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), seq_len=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("minhash", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", personal_data),
    ("pack", pack),
]

#: The language model, MinHash and packing can't be put in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
