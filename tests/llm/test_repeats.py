import hashlib
import re

import numpy as np
import pytest

from tallyweave.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=repeats.LENGTH):
    """(doc_id, n_words, n_removed, kept_sha256) by the definition."""
    key = lambda i: (i is None, i or 0)
    texts = [(doc_id, WORD.findall(text or "")) for doc_id, text in rows]
    least = {}
    for doc_id, words in texts:
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            least[window] = min(least.get(window, key(doc_id)), key(doc_id))
    out = []
    for doc_id, words in texts:
        gone = set()
        for k in range(len(words) - length + 1):
            if least[tuple(words[k : k + length])] < key(doc_id):
                gone.update(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def documents(seed=1, n=60, vocabulary=40):
    """Texts of few words that share passages, whole copies and single anchors with other surroundings."""
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[words[i] for i in draw.integers(0, vocabulary, size)] for size in (5, 12, 13, 14, 30, 80)]
    rows = []
    for doc_id in range(n):
        text = []
        for _ in range(draw.integers(0, 5)):
            text += [words[i] for i in draw.integers(0, vocabulary, draw.integers(0, 30))]
            text += passages[draw.integers(0, len(passages))]
        rows.append((doc_id, " ".join(text)))
    rows += [(n + k, rows[3][1]) for k in range(20)]
    return [(int(i), t) for i, t in rows]


def report(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in repeats.removal_report(docs, **limits).collect()), key=repr)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_equals_brute_force(spark, hot):
    rows = documents()
    assert report(spark, rows, hot=hot) == brute(rows)


def test_tiny_vocabulary(spark):
    """Windows that hold their anchor several times, and documents that repeat themselves."""
    rows = documents(2, 30, 2) + [(900, "a b " * 40), (901, "a b " * 30), (902, "a " * 20 + "b " * 3), (903, "a " * 25)]
    assert report(spark, rows) == brute(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in repeats.removal_report(odd_docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    # the later copy of the long text goes, the earlier one stays
    removed = {r[0]: r[2] for r in got}
    assert removed[6] == 0 and removed[7] == 45_002
    assert repeats.removal_report(no_docs).collect() == []


def test_null_ids_are_largest(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(None, text), (None, text), (5, text)]
    assert report(spark, rows) == brute(rows)
    rows = [(None, text), (None, text)]
    assert [r[2] for r in report(spark, rows)] == [0, 0]


def test_texts_and_spans(spark):
    shared = " ".join(f"s{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"x {shared} y"), (2, f"a\n{shared}\tb  c")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert got[1].kept == f"x {shared} y" and got[1].removed == []
    assert got[2].kept == "a b c" and [tuple(s) for s in got[2].removed] == [(1, 15)]


def test_long_texts_are_read_in_pieces(monkeypatch, spark):
    text = ("alpha beta gamma delta " * 2_000).encode()
    monkeypatch.setattr(repeats, "RUN_BYTES", 1_000)
    parts = list(repeats.pieces(text))
    assert b"".join(parts) == text and max(map(len, parts)) < 1_020
    assert list(repeats.pieces(b"x" * 5_000)) == [b"x" * 5_000]
    assert sum(n for n, _ in repeats._kept_words(text, [])) == 8_000
