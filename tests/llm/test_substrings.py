import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import substrings

LIMITS = {"length": 12, "anchor": 4}


def brute(rows, length):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        count.update(t[a : a + length] for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        cover = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                cover[a : a + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((i, len(t), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def report(docs, **limits):
    return sorted((tuple(r) for r in substrings.removal_report(docs, **limits).collect()), key=repr)


def random_rows(seed, alphabet="abé", rows=60):
    random = np.random.default_rng(seed)
    pieces = ["".join(random.choice(list(alphabet), random.integers(5, 40))) for _ in range(12)]
    return [(i, "".join(random.choice(pieces, random.integers(0, 6)))) for i in range(rows)] + [(900, "ab" * 60), (901, "a" * 30), (902, None), (903, "")]


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_against_brute_force(spark, hot):
    for seed in range(2):
        rows = random_rows(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert report(docs, hot=hot, **LIMITS) == brute(rows, 12)


def test_sparse_repeats_and_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 37)
    random = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzé0123456789 ")
    shared = ["".join(random.choice(letters, n)) for n in (11, 12, 13, 30)]
    rows = [(i, "".join(random.choice(letters, 80)) + shared[i % 4] + "".join(random.choice(letters, 50))) for i in range(24)]
    assert report(spark.createDataFrame(rows, "doc_id long, text string"), **LIMITS) == brute(rows, 12)


def test_kept_bytes_and_removed_spans(spark):
    docs = spark.createDataFrame([(1, "xx" + "q" * 3 + "0123456789abcdef"), (2, "0123456789abcdef" + "zz")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.removed]) for r in substrings.remove_repeats(docs, **LIMITS).collect()}
    assert got == {1: (b"xxqqq", [(5, 21)]), 2: (b"zz", [(0, 16)])}


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    # the two long texts are copies of each other
    assert report(odd_docs) == brute(rows, substrings.LENGTH)
    assert report(no_docs) == []
