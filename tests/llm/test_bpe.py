import hashlib

import numpy as np
import pytest

from tallyweave.llm import bpe
from tallyweave.llm.queries import rank_file

tiktoken = pytest.importorskip("tiktoken")
RANKS, PATTERN = rank_file()


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})


TEXTS = ["Hello world", "", None, "  \n\n x  y\t\t", "a" * 3_000, "ab" * 900 + " x", "é" * 500, "日本語テキスト" * 30, "<|endoftext|> hi", "\U0001f600" * 90,
         "don't we're I'll", "supercalifragilisticexpialidocious" * 3, "\x00\x01\x7f"]


def test_ids_match_the_public_library(spark, public):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, PATTERN).collect()}
    assert got == {i: public.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_round_trip_and_digests(spark, public):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    encoded = bpe.encode(docs, RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS, PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in bpe.decode_digests(encoded, RANKS, PATTERN).collect():
        ids = public.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_bounded_cache_and_runs(monkeypatch, public):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "RUN_PIECES", 3)
    monkeypatch.setattr(bpe, "RUN_CHARS", 20)
    monkeypatch.setattr(bpe, "MATRIX_BYTES", 6)
    texts = [t or "" for t in TEXTS] * 2
    assert [x.tolist() for x in bpe.Coder(bpe.parse_ranks(RANKS), PATTERN).encode_many(texts)] == [public.encode_ordinary(t) for t in texts]


def test_odd_rows(odd_docs, public):
    got = sorted(((r.doc_id, tuple(r.ids)) for r in bpe.encode(odd_docs, RANKS, PATTERN).collect()), key=repr)
    assert got == sorted(((r.doc_id, tuple(public.encode_ordinary(r.text or ""))) for r in odd_docs.collect()), key=repr)
    assert bpe.encode_and_check(odd_docs, RANKS, PATTERN).count() == odd_docs.count()


def test_null_ids_and_empty_table(spark, no_docs):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows, RANKS, PATTERN).collect()} == {1: b"", 2: b""}
    assert bpe.decode_digests(bpe.encode(no_docs, RANKS, PATTERN), RANKS, PATTERN).collect() == []


def test_a_worker_that_decodes_makes_no_table_and_matrices_are_bounded(public, monkeypatch):
    coder, cells = bpe.Coder(bpe.parse_ranks(RANKS), PATTERN), []
    text = " ".join("x" * (i % 90) + str(i) for i in range(3_000))
    ids = public.encode_ordinary(text)
    assert bpe._one(coder, np.array(ids, np.int64), True)[0] == text.encode()
    assert "table" not in vars(coder)
    merge = coder._merge_matrix
    monkeypatch.setattr(bpe, "MATRIX_CELLS", 4_000)
    monkeypatch.setattr(coder, "_merge_matrix", lambda part: cells.append(len(part) * max(map(len, part))) or merge(part))
    assert coder.encode_many([text])[0].tolist() == ids
    assert len(cells) > 10 and max(cells) <= 4_000


def test_encoding_and_decoding_share_a_worker(spark, odd_docs):
    both = bpe.encode_and_check(odd_docs, RANKS, PATTERN)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe.decode_digests(bpe.encode(odd_docs, RANKS, PATTERN), RANKS, PATTERN)
    key = lambda rows: sorted((tuple(r) for r in rows.collect()), key=repr)
    assert key(both.drop("ids")) == key(apart)
