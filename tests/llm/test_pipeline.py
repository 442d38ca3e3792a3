import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import bpe, toxicity
from tallyweave.llm.queries import rank_file, toxic_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_return_documents(results):
    for name, (before, after) in list(results.items())[:-1]:
        assert after.dtypes == before.dtypes, name


def test_toxic_documents_go_and_clean_ones_stay(spark, results):
    before, after = results["toxicity"]
    scores = toxicity.score(before, toxic_model(spark, before, SF))
    assert ids(after) == ids(scores.filter("score < 0.7"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for toxic, least, most in ((1, 0.6, 1.0), (0, 0.0, 0.01)):  # share of the labelled that goes
        known = labels.filter(F.col("toxic") == toxic).join(before, "doc_id")
        assert least <= known.join(after, "doc_id", "left_anti").count() / known.count() <= most


def test_one_row_of_each_text_stays(results):
    before, after = results["exact_dedup"]
    least = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert ids(after) == Counter(least.values())


def test_one_document_of_each_near_class_stays(results):
    from tests.llm.test_near_dedup import brute, multiset

    before, after = results["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    # only texts that share a shingle can be near copies
    owners = {}
    for i, (_, t) in enumerate(rows):
        for s in multiset(t):
            owners.setdefault(s, []).append(i)
    some = sorted({i for o in owners.values() if len(o) > 1 for i in o})
    classes = brute([rows[i] for i in some])
    assert ids(after) == Counter({d for d, _ in rows if classes.get(d, d) == d})


def test_the_mix_meets_its_targets(results):
    from tests.llm.test_mixing import targets

    before, after = results["mix_sources"]
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    sizes, got = ({r.source: r.n for r in df.groupBy("source").agg(F.sum(words).alias("n")).collect()} for df in (before, after))
    assert all(abs(got.get(s, 0) - t) <= 128 + 0.02 * t for s, t in targets(sizes).items())
    assert max(ids(after).values()) <= 2 and after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_tokens_decode_to_the_texts(results):
    before, after = results["byte_bpe"]
    want = Counter((r.doc_id, r.sha) for r in before.select("doc_id", F.sha2("text", 256).alias("sha")).collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in after.collect()) == want
    ranks, pattern = rank_file()
    coder = bpe.Coder(bpe.parse_ranks(ranks), pattern)
    texts = before.filter("doc_id < 40").collect()
    for r, encoded in zip(texts, coder.encode_many([r.text for r in texts]), strict=True):
        assert coder.token_bytes.gather(encoded.astype("int64")).tobytes().decode() == r.text


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, stage):
    run = corpus_pipeline.STAGES[stage][1]
    assert run(spark, no_docs, SF).count() == 0
    assert run(spark, odd_docs, SF).count() > 0
