"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import settle

#: Labelled rows that a classifier is fitted to (expected number; the hash decides).
SAMPLE_ROWS = 12_000


def labelled_sample(labels: DataFrame, label_col: str, training: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label) of about ``most`` rows at most for which ``training`` holds, chosen by a hash of the id."""
    known = (
        labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
        .filter(training).groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    known = settle(known, "labels")
    share = min(1.0, most / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(0))
