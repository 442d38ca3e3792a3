"""Approximate nearest neighbours by multi-index hashing.

Nearness is the inner product. Vectors are lifted to a sphere (one more component makes all norms equal to the
largest one), where the largest inner product is the smallest angle. A projection and a rotation, learned on a
bounded sample by iterative quantisation, turn each into a code of BITS bits; substrings of the code are the
indexes. If two codes differ in at most r bits, they differ in at most r / PARTS bits in some substring
(pigeonhole), so probing all substring values that near finds every code within radius r. The codes found are
filtered by their full distance and ranked by the exact inner product.

The radius is learned too: it is the least one that holds the share RECALL of the true neighbours of sampled
queries. A sample of s of n rows stands for all of them by taking as many neighbours as the nearest k of n
leave in it (k * s / n, one at least), so the radius shrinks as the table grows. Queries that find fewer than k
rows within it, though the table has more, are asked again with the radius that holds every code, which is exact.

Rows are dealt into shards and queries into blocks of bounded size; each pair of a shard and a block is one
task. Vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part. Repeated ids are different rows: a query leaves out the rows with its own id only. Ties go to the
smaller id, so repeated vectors are no trouble. Tables without vectors give an empty result. Only id and
vector are read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import settle

BITS = 64
PARTS = 8
RECALL = 0.96
SAMPLE_ROWS = 8_000
SAMPLE_QUERIES = 400
ROUNDS = 30
#: Bounds of one task: components of a shard's vectors, and queries of a block.
SHARD_VALUES = 1 << 22
BLOCK_QUERIES = 8_192


@dataclass(frozen=True)
class Hasher:
    """A learned code: ``lift`` is the largest norm; the signs of lifted vectors times ``turn`` are the bits."""

    lift: float
    turn: np.ndarray
    radius: int

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.lift**2 - (vectors**2).sum(axis=1), 0))
        return self._codes(np.concatenate([vectors, extra[:, None]], axis=1) / self.lift)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return self._codes(np.concatenate([vectors / norms, np.zeros((len(vectors), 1))], axis=1))

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(lifted @ self.turn > 0, axis=1)


def learn(vectors: np.ndarray, lift: float, total: int, k: int, seed: int = 5) -> Hasher:
    """Code and radius from a sample of ``total`` rows."""
    random = np.random.default_rng(seed)
    extra = np.sqrt(np.maximum(lift**2 - (vectors**2).sum(axis=1), 0))
    lifted = np.concatenate([vectors, extra[:, None]], axis=1) / lift
    axes = np.linalg.eigh(lifted.T @ lifted)[1].T[::-1]  # principal directions first
    turns, left = [], BITS
    while left > 0:  # short vectors get several rotations
        width = min(left, lifted.shape[1])
        flat = lifted @ axes[:width].T
        turn = np.linalg.qr(random.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        turns.append(axes[:width].T @ turn)
        left -= width
    hasher = Hasher(lift, np.concatenate(turns, axis=1), BITS)
    return Hasher(lift, hasher.turn, _radius(hasher, vectors, total, k))


def _radius(hasher: Hasher, vectors: np.ndarray, total: int, k: int) -> int:
    queries = np.arange(min(len(vectors), SAMPLE_QUERIES))
    stand = max(1, min(len(vectors) - 1, round(k * len(vectors) / max(total, 1))))
    if len(vectors) < 2:
        return BITS
    near = vectors[queries] @ vectors.T
    near[queries, queries] = -np.inf
    best = np.argpartition(-near, stand - 1, axis=1)[:, :stand]
    gaps = _distances(hasher.queries(vectors[queries])[:, None, :], hasher.rows(vectors)[best])
    return int(np.quantile(gaps, RECALL, method="higher"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words = np.bitwise_xor(np.ascontiguousarray(a), np.ascontiguousarray(b))
    return np.bitwise_count(words.view(np.uint64)).sum(axis=-1).astype(np.int64)


class Index:
    """For each substring of the codes, the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.begin = [np.searchsorted(codes[:, p][self.order[p]], np.arange(257)) for p in range(PARTS)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from ``query`` in at most ``radius`` bits."""
        # radius = base * PARTS + rest: some of the first rest + 1 substrings is within base, or a later one within base - 1
        base, rest = divmod(radius, PARTS)
        seen = np.zeros(len(self.codes), bool)
        for p in range(PARTS):
            for value in _near_values(base if p <= rest else base - 1) ^ query[p]:
                a, b = self.begin[p][value], self.begin[p][int(value) + 1]
                seen[self.order[p][a:b]] = True
        found = np.flatnonzero(seen)
        return found[_distances(self.codes[found], query[None, :]) <= radius]


_VALUES: dict[int, np.ndarray] = {}


def _near_values(most: int) -> np.ndarray:
    """All bytes with at most ``most`` bits."""
    if most not in _VALUES:
        flips = [sum(1 << b for b in bits) for n in range(max(most, -1) + 1) for bits in combinations(range(8), n)]
        _VALUES[most] = np.array(flips, np.uint8)
    return _VALUES[most]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _search(rows: pa.Table, queries: pa.Table, hasher: Hasher, k: int) -> pa.Table:
    """The nearest rows of one shard for one block of queries."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        row_ids, vectors = _vectors(rows)
        query_ids, asked = _vectors(queries)
        index, codes = Index(hasher.rows(vectors)), hasher.queries(asked)
        for q in range(len(query_ids)):
            found = index.within(codes[q], hasher.radius)
            found = found[row_ids[found] != query_ids[q]]
            score = vectors[found] @ asked[q]
            if len(found) > k:
                # equal vectors must score equally: rank by a sum whose order does not depend on the row's place
                found = found[score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9 * max(1.0, hasher.lift**2)]
            score = (vectors[found] * asked[q]).sum(axis=1)
            best = np.lexsort([row_ids[found], -score])[:k]
            out.append((np.full(len(best), query_ids[q]), row_ids[found][best], score[best]))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, norm2) of the vectors that take part."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.filter(finite).withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).filter("norm2 > 0")
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"))
    width = sizes.orderBy(F.desc("n"), "size").limit(1).first()
    return rows.filter(F.size("vec") == (width["size"] if width else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row that ``is_query``, a condition on vec_id, names."""
    rows = settle(usable(vectors, id_col, vec_col), "vectors")
    total, lift2 = rows.agg(F.count("*"), F.max("norm2")).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    share = int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < share).orderBy(F.xxhash64("vec_id"), "vec_id")
    hasher = learn(_vectors(picked.limit(2 * SAMPLE_ROWS).select("vec_id", "vec").toArrow())[1], float(np.sqrt(lift2)), total, k)
    asked = rows.filter(is_query)
    ranked = settle(_ranked(rows, asked, total, hasher, k), "ranked")
    # what a query may find are the rows with another id
    own = asked.select("vec_id").distinct().join(rows.groupBy("vec_id").agg(F.count("*").alias("own")), "vec_id")
    hits = ranked.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    fewer = F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.lit(total) - F.col("own"))
    short = settle(own.join(hits, "vec_id", "left").filter(fewer).select("vec_id"), "short")
    if not short.limit(1).count():
        return ranked
    again = _ranked(rows, settle(asked.join(short, "vec_id").select("vec_id", "vec"), "again"), total, replace(hasher, radius=BITS), k)
    return ranked.join(short, F.col("query_id") == short["vec_id"], "left_anti").unionByName(again)


def _ranked(rows: DataFrame, asked: DataFrame, total: int, hasher: Hasher, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows within the radius of each row of ``asked``."""
    shards = -(-total // max(1, SHARD_VALUES // (len(hasher.turn) - 1)))
    # queries are cut further where the shards alone would leave cores idle
    idle = -(-rows.sparkSession.sparkContext.defaultParallelism // shards)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES), idle)

    def dealt(frame: DataFrame, own: str, many: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(many)).cast("int")
        return frame.select("vec_id", "vec", place.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(rows, "shard", shards, "block", blocks).groupBy("shard", "block")
    right = dealt(asked, "block", blocks, "shard", shards).groupBy("shard", "block")
    schema = "query_id bigint, vec_id bigint, score double"
    found = left.cogroup(right).applyInArrow(lambda a, b: _search(a, b, hasher, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
