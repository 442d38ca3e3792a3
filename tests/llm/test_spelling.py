import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tallyweave.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=spelling.RATIO):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=repr)


def vocabulary(seed, n, letters="abcdefgéÿ"):
    draw = np.random.default_rng(seed)
    counts = {}
    for _ in range(n):
        word = "".join(draw.choice(list(letters), int(draw.integers(6, 9))))
        counts[word] = int(draw.integers(5, 2_000))
        for _ in range(int(draw.integers(0, 4))):
            at, c = int(draw.integers(0, len(word))), str(draw.choice(list(letters)))
            word = [word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]][int(draw.integers(0, 3))]
            counts[word] = int(draw.integers(5, 100))
    return counts


def grouped(spark, counts, **limits):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling.group_variants(words, **limits).collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"cell_words": 8}, {"cell_words": 3, "max_sample": 40}])
def test_equals_brute_force(spark, limits):
    counts = vocabulary(5, 200) | {"ab" * 5_000: 9, "ab" * 4_999 + "a": 90, "aab" * 3: 12, "日本語日本語": 5, "日本語日本": 70}
    assert grouped(spark, counts, **limits) == brute(counts)


def test_anagrams_share_a_point(spark):
    """Words with the same letters cannot be told apart by a tree: their cell is dealt into blocks."""
    draw = np.random.default_rng(6)
    counts = {"".join(draw.permutation(list("aabbcd"))): 5 for _ in range(150)} | {"".join(draw.permutation(list("aabbce"))): 25 for _ in range(150)}
    assert grouped(spark, counts, cell_words=20) == brute(counts)


def test_trees_find_all_within_reach():
    draw = np.random.default_rng(7)
    at = draw.integers(0, 4, (500, spelling.DIMS)).astype(np.int16) * (np.arange(spelling.DIMS) < 6)
    for whole in (False, True):
        tree = spelling.Tree(at.astype(np.int16), 5, whole)
        row, leaf = tree.reach(at[:50].astype(np.int16), 1, 1)
        found = {(r, k) for r, n in zip(row, leaf, strict=True) for k in tree.leaves[n]}
        change = at[None, :, :].astype(int) - at[:50, None, :]
        want = np.argwhere((np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1))
        assert {tuple(x) for x in want} <= found
    home = tree.home(at.astype(np.int16))
    assert all(k in tree.leaves[home[k]] for k in range(len(at)))


def counted(docs):
    return {r.word: r.n for r in spelling.count_words(docs, spelling.drop_letters, 3, 1).collect()}


def test_counts_with_dropped_letters(spark, odd_docs, no_docs):
    want = Counter()
    for r in odd_docs.collect():
        for run in RUN.findall(r.text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{word}".encode())
            if len(word) >= spelling.LEAST_CHARS:
                want[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    assert counted(odd_docs) == dict(want)
    assert counted(no_docs) == {} and grouped(spark, {"abcdef": 5}) == [("abcdef", None, "abcdef", 5, 0, None)]
    assert spelling.group_variants(spelling.count_words(no_docs)).collect() == []


def test_runs_of_letters():
    text = "CafÉ-×÷x Œuvre ÀÿĀ \U0001f600ab\x80cd¿ef"
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    assert [w.decode("latin-1") for part in spelling.text_words(text) for w in part] == [r.translate(lower) for r in RUN.findall(text)]


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.follow(forms).collect()} == {f"w{k}": "w9" for k in range(9)} | {"x": "w9"}
