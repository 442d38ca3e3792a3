import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import toxicity, words
from tallyweave.llm.labels import remainder

FILLER = [f"word{i}" for i in range(40)]


def paired(spark, rows=1_200):
    """Label 1 only where an insult meets a group; either alone is harmless."""
    random = np.random.default_rng(3)
    data = []
    for i in range(rows):
        insult, group = (random.random(2) < 0.5).tolist()
        text = " ".join([*random.choice(FILLER, 12), *["awful"] * int(insult), *["folks"] * int(group)])
        data.append((i, text, int(insult and group)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_pairs_of_terms_decide(spark):
    docs, labels = paired(spark)
    model = toxicity.fit(docs, labels, "toxic", remainder(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(got[r.doc_id] >= 0.5) == r.toxic for r in held]) > 0.98
    assert all(0 <= s <= 1 for s in got.values())


def test_margin_is_that_of_a_factorization_machine():
    random = np.random.default_rng(1)
    model = toxicity.Machine(np.arange(5), 0.3, random.normal(size=5), random.normal(size=(5, 3)))
    terms = np.array([0, 2, 4])
    want = 0.3 + model.weights[terms].sum() + sum(model.factors[i] @ model.factors[j] for i in terms for j in terms if i < j)
    assert np.isclose(toxicity._margin(model, np.zeros(3, np.int64), terms, 1)[0][0], want)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", remainder(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(remainder(F.col("doc_id"), 3) == 1)
    hits = {(r.toxic, r.p): r["count"] for r in scored.withColumn("p", F.col("score") >= 0.7).groupBy("toxic", "p").count().collect()}
    assert hits[1, True] > 0.88 * (hits[1, True] + hits.get((1, False), 0))
    assert hits.get((0, True), 0) < 0.005 * hits[0, False]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
            model = toxicity.fit(docs, known, "toxic", F.lit(True))
            assert toxicity.score(docs, model).count() == docs.count()
            assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    kept = toxicity.keep_below(odd_docs, model, 0.7)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


@pytest.mark.parametrize("cut", [50, 5_000])
def test_words_of_long_texts(monkeypatch, cut):
    monkeypatch.setattr(words, "CUT_CHARS", cut)
    monkeypatch.setattr(words, "RUN_BYTES", 300)
    words._POWERS.clear()
    texts = ["the cat, THE hat " * 20, None, "", "été x1 été", "a" * 45, "the hat"]
    rows = {}
    for first, hashes, heads, counts in words.word_hashes(texts, 3):
        ends = np.cumsum(counts)
        assert len(hashes) == len(heads) == counts.sum()
        for k, n in enumerate(counts):
            rows[first + k] = hashes[ends[k] - n : ends[k]].tolist()
    words._POWERS.clear()
    assert [len(rows[i]) for i in range(6)] == [80, 0, 0, 3, 1, 2]
    assert rows[0][0] == rows[0][2] == rows[5][0] and rows[0][3] == rows[5][1] and rows[3][0] == rows[3][2]
