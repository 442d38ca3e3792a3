import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size, sha) by normalised text."""
    groups = {}
    for doc_id, text in rows:
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append(doc_id)
    keep = {sha: min((i for i in ids if i is not None), default=None) for sha, ids in groups.items()}
    return sorted(((i, keep[sha], len(ids), sha) for sha, ids in groups.items() for i in ids), key=repr)


def test_groups_of_odd_rows(odd_docs):
    got = exact_dedup.exact_groups(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_full_filter_changes_nothing(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1_900).alias("text"))
    small = exact_dedup.exact_groups(docs, max_bits=exact_dedup.BLOCK_BITS).collect()
    assert sorted(small) == sorted(exact_dedup.exact_groups(docs).collect())
    assert sum(r.kept for r in small) == 1_900


def test_only_possible_repeats_are_shuffled(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.greatest("id", F.lit(10))).alias("text"))
    digests = docs.select("doc_id", exact_dedup.digest(F.col("text")).alias("sha"))
    marked, blocks = exact_dedup.repeated_filter(digests)
    possible = exact_dedup.test_rows(digests, marked, blocks).filter("possible")
    assert possible.filter("doc_id <= 10").count() == 11
    assert possible.count() < 1_500


def test_rows_that_stay_carry_all_columns(odd_docs):
    got = exact_dedup.drop_copies(odd_docs)
    assert got.schema.names == odd_docs.schema.names
    texts = sorted(re.sub(r"\s+", " ", r.text or "") for r in got.collect())
    assert texts == sorted({re.sub(r"\s+", " ", r.text or "") for r in odd_docs.collect()})
    assert {r.doc_id for r in got.collect()} == {1, 3, 5, 6, 8, 9, 10, None}


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, exact_dedup.drop_copies])
def test_empty_table(no_docs, operator):
    assert operator(no_docs).collect() == []
