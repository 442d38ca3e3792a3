"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed to weights, texts become tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.

The operators define what becomes of nulls, empty and very long texts, ties, repeated rows, empty tables and
further columns; see their modules. Here, a document with a null text is an empty one: it is not toxic, is a copy
of other empty documents, and has no words for the mix to take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tallyweave.llm.queries import rank_file, toxic_model
from tallyweave.session import configure, scratch

#: A document with this score or more is rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: the documents that score below TOXIC."""
    names = docs.columns
    model = toxic_model(configure(spark), docs, sf_dir)
    return toxicity.keep_below(docs, model, TOXIC).select(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: the smallest id of each text stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-deduplication: the smallest id of each class stays."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the words taken of each document, a row for each round that takes some."""
    return mixing.mix_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: a row per row of the mix with its tokens, and digests of the ids and of what they decode to."""
    ranks, pattern = rank_file()
    return bpe.encode_and_check(docs, ranks, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: A fitted model, near copies and merges by rank are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is written to the shared folder."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
