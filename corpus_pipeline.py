"""A corpus from raw documents to packed sequences: the stages and their run over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import exact, neardup, packing, secret_scan, toxicity
from panelcast.llm.common import fresh_folder, table
from panelcast.llm.queries import tokenizer, toxicity_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labels of those at hand."""
    return toxicity.drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), bar=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_copies(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the forest takes for a secret is masked in the text; every document stays."""
    return secret_scan.redact(docs, secret_scan.scan(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences."""
    own = packing.pieces(docs, tokenizer("word_bpe_49k.json"), end_id=1, lean=True)
    return packing.pack(own).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None  # model fits, sketches and packing have no SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{fresh_folder(spark)}/{name}"
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs
