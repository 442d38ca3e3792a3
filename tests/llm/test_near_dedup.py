import re
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import near_dedup
from tallyweave.llm.words import word_hashes


def multiset(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute(rows):
    """{doc_id: smallest id of its class} by comparing all pairs."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if union and sum((sets[i] & sets[j]).values()) >= 0.8 * union:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(rows)}


def edited(random, words, share):
    return " ".join(str(random.integers(10**6)) if random.random() < share else w for w in words)


def corpus(seed=1):
    """Groups of near copies around the threshold, chains of edits, repeated lines, copies and singles."""
    random = np.random.default_rng(seed)
    rows = []
    for size in (2, 2, 3, 5, 9, 40):
        base = [f"w{x}" for x in random.integers(0, 900, 220)]
        rows += [edited(random, base, random.choice([0.0, 0.005, 0.01, 0.02, 0.03])) for _ in range(size)]
    chain = [f"c{i}" for i in range(160)]
    for step in range(12):
        chain[step * 12 + 3] = f"changed{step}"
        rows.append(" ".join(chain))
    rows += ["same line of six words here " * n for n in (10, 11, 30, 33, 90)]
    rows += [" ".join(f"s{x}" for x in random.integers(0, 10**6, n)) for n in (1, 2, 4, 5, 6, 300)]
    rows += ["One, TWO three!", "one two three", "", None, " ?! "]
    return [(int(i), t) for i, t in enumerate(rows)]


def test_classes_match_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id: r.class_id for r in got} == brute(rows)
        sizes = Counter(r.class_id for r in got)
        assert all(r.class_size == sizes[r.class_id] for r in got)


def crowd(seed=3, members=1_500, twos=5):
    """Edits of one base, alike by 0.65 to 0.75 mostly, and some that are alike by 0.8 and more."""
    random = np.random.default_rng(seed)
    base = [f"w{x}" for x in range(300)]

    def edit(words):
        words = list(words)
        for at in random.choice(300, 6, replace=False):
            words[at] = str(random.integers(10**9))
        return words

    rows = [edit(base) for _ in range(members)]
    rows += [edit(words) for words in rows[:twos]]
    return [(int(i), " ".join(rows[r])) for i, r in enumerate(random.permutation(len(rows)))]


def brute_classes(rows):
    """As ``brute``, for texts without repeated shingles, by one product of matrices."""
    sets = [multiset(t) for _, t in rows]
    place = {x: n for n, x in enumerate(sorted({x for s in sets for x in s}))}
    marks = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        marks[i, [place[x] for x in s]] = 1
    shared = marks @ marks.T
    size = marks.sum(axis=1)
    alike = shared >= 0.8 * (size[:, None] + size[None, :] - shared)
    least = np.arange(len(rows))
    while True:
        lower = np.array([least[alike[i]].min() for i in range(len(rows))])
        if (lower == least).all():
            return {rows[i][0]: rows[least[i]][0] for i in range(len(rows))}
        least = lower


def test_crowd_of_edits_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_ROWS", 300, raising=False)
    rows = crowd()
    want = brute_classes(rows)
    assert len(set(want.values())) > 1_000
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.class_id for r in got} == want


@pytest.mark.parametrize("members", [500, 1_500])
def test_crowd_makes_few_pairs(spark, monkeypatch, members):
    """Candidate pairs grow with the members, not with the pairs of a crowd."""
    judged, likely = [], near_dedup._likely
    monkeypatch.setattr(near_dedup, "_likely", lambda pairs, nodes: judged.append(pairs.count()) or likely(pairs, nodes))
    rows = crowd(members=members)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert sum(judged) <= 12.5 * members


def test_true_pairs_of_low_estimate_are_compared(spark):
    # pairs of similarity 33/41 of which only 64 or 65 components of the signatures are equal
    rows = []
    for n in (909, 9234, 18971, 22270):
        words = [f"p{n}x{i}" for i in range(41)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:37] + [f"q{n}x{i}" for i in range(4)]))]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) == {i: i - i % 2 for i, _ in rows}


def test_signature_is_unbiased_for_weighted_similarity():
    random = np.random.default_rng(4)
    errors = []
    for _ in range(40):
        names = random.integers(0, 2**48, 120).astype(np.uint64)
        a = random.integers(0, 12, 120)
        b = np.where(random.random(120) < 0.7, a, random.integers(0, 12, 120))
        row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        signed = near_dedup.signatures(row, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 400)
        errors.append((signed[0] == signed[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.04


def test_signature_does_not_depend_on_neighbours():
    texts = ["a b c d e f g h i j " * 3, "x y", "one two three four five six"]
    alone = []
    for t in texts:
        _, hashes, _, counts = next(word_hashes([t]))
        alone.append(near_dedup.signatures(*near_dedup.shingles(hashes, counts), 1)[0])
    _, hashes, _, counts = next(word_hashes(texts))
    assert np.array_equal(near_dedup.signatures(*near_dedup.shingles(hashes, counts), 3), np.array(alone))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1005), (1005, 1001), (2000, 2000)]
    got = {r.node: r["class"] for r in near_dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1005: 1000, 1001: 1000}


def test_one_of_each_class_stays_with_all_columns(spark, odd_docs):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == sorted(set(brute(rows).values()))
    kept = near_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 2, 9: 1, 10: 1, None: 1})


@pytest.mark.parametrize("operator", [near_dedup.near_classes, near_dedup.drop_near_copies])
def test_empty_table(no_docs, operator):
    assert operator(no_docs).collect() == []
