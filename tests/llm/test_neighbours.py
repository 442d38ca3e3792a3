import math

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import neighbours


def brute(rows, k, is_query):
    out = []
    for q, v in rows:
        if is_query(q):
            scored = sorted((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def test_recall_for_unequal_norms(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_VALUES", 24 * 700)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 40)
    random = np.random.default_rng(2)
    rows = [(i, np.float32(random.normal(size=24) * random.uniform(0.2, 3))) for i in range(2_000)]
    got = [tuple(r) for r in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10).collect()]
    want = brute(rows, 10, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, _, i, s in brute(rows, len(rows), lambda i: i % 20 == 0)}
    assert all(math.isclose(s, exact[q, i], abs_tol=1e-9) for q, _, i, s in got)


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = [tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect()]
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert recall(got, brute(rows, 20, lambda i: i % 20 == 0)) >= 0.9


def test_probing_finds_every_code_within_the_radius():
    random = np.random.default_rng(5)
    codes = random.integers(0, 256, (3_000, 8)).astype(np.uint8)
    codes[:50] = codes[0] ^ (random.random((50, 8)) < 0.3).astype(np.uint8)
    index = neighbours.Index(codes)
    for radius in (0, 3, 8, 20, 27, 64):
        for q in (0, 7, 99):
            want = np.flatnonzero(np.unpackbits(codes ^ codes[q], axis=1).sum(axis=1) <= radius)
            assert np.array_equal(index.within(codes[q], radius), want)


def test_ties_go_to_the_smaller_id_and_odd_vectors_take_no_part(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(40)] + [(100, None), (101, [0, 0, 0]), (102, [1, None, 2]), (103, [1, float("nan"), 2]), (104, [1, 2]), (105, [float("inf"), 1, 1]), (106, [])]
    got = sorted(tuple(r)[:3] for r in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect())
    assert got == [(0, r, r) for r in range(1, 6)] + [(20, r, r - 1) for r in range(1, 6)]


def test_few_and_no_vectors(spark):
    two = vectors(spark, [(0, [1, 0]), (1, [0.5, 0.5])])
    assert [tuple(r) for r in neighbours.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(vectors(spark, [(0, [1, 0])]), F.lit(True)).collect() == []
    assert neighbours.nearest(vectors(spark, []), F.lit(True)).collect() == []


def test_small_table_gives_all_candidates(spark):
    random = np.random.default_rng(6)
    rows = [(i, np.float32(random.normal(size=16))) for i in range(15)]
    got = neighbours.nearest(vectors(spark, rows), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(r[:3] for r in brute(rows, 20, lambda i: True))


def test_queries_outside_all_clusters_find_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_VALUES", 16 * 500)
    random = np.random.default_rng(7)
    centres = random.normal(size=(40, 16))
    rows = [(i, np.float32(centres[i % 40] + random.normal(size=16) * 1e-3)) for i in range(2_000)]
    rows += [(i, np.float32(random.normal(size=16))) for i in range(2_000, 2_010)]
    asked = (F.col("vec_id") >= 2_000) | (F.col("vec_id") % 100 == 0)
    got = [tuple(r) for r in neighbours.nearest(vectors(spark, rows), asked).collect()]
    want = brute(rows, 20, lambda i: i >= 2_000 or i % 100 == 0)
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in want)
    assert recall(got, want) >= 0.9
