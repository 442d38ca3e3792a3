import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import quality
from tallyweave.llm.labels import remainder


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0)
    assert 0 < len(model.rules) < 200
    scored = quality.score(docs, model).join(labels, "doc_id").filter(remainder(F.col("doc_id"), 5) == 0)
    right = scored.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


def test_paths_are_the_trees_splits():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 6 <= 0.25)
     If (feature 0 <= 3.5)
      Predict: 0.0
     Else (feature 0 > 3.5)
      Predict: 1.0
    Else (feature 6 > 0.25)
     Predict: 0.0"""
    up, low = ("upper", True, 0.25), ("upper", False, 0.25)
    assert quality.paths(text) == [(up,), (up, ("log_chars", True, 3.5)), (up, ("log_chars", False, 3.5)), (low,)]
    assert quality.simplified((up, ("upper", True, 0.5), low)) == (("upper", False, 0.25), ("upper", True, 0.25))


def test_compiled_score_is_the_sum_of_rules(spark):
    model = quality.Ensemble(-1.0, (((("upper", True, 0.1),), 2.0), ((("upper", False, 0.05), ("digits", True, 0.5)), -0.5)))
    docs = spark.createDataFrame([(1, "abc def"), (2, "ABC"), (3, "Abcdefghijklmnop")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    want = {1: 1.0, 2: -1.5, 3: 0.5}
    assert all(np.isclose(got[i], 1 / (1 + np.exp(-m))) for i, m in want.items())


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    for docs, known in ((odd_docs, labels), (no_docs, labels), (odd_docs, labels.limit(0)), (odd_docs, labels.filter("quality = 1"))):
        model = quality.fit(docs, known, "quality", F.lit(True))
        rows = quality.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
