"""Bucketed ranks equal the plain window, also for skewed groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import ranking as rk


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Many buckets per group although the data are small."""
    monkeypatch.setattr(rk, "BUCKET_ROWS", 500)
    monkeypatch.setattr(rk, "FINEST_BUCKET_ROWS", 50)


@pytest.fixture(scope="module")
def skewed(spark):
    # one group holds most of the rows
    return spark.range(20000).selectExpr("id * 37 AS id", "CASE WHEN id % 10 < 7 THEN 0 ELSE id % 5 END AS g")


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_shuffled_rank(skewed):
    key = rk.shuffle_key(5, "id")
    for groups in ([], ["g"]):
        window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(key, "id")
        plain = skewed.withColumn("rank", F.row_number().over(window).cast("long"))
        same(rk.shuffled_rank(skewed, key, "id", groups).select("id", "g", "rank"), plain.select("id", "g", "rank"))


def test_id_rank_and_slice(skewed):
    window = Window.partitionBy("g").orderBy("id")
    plain = skewed.withColumn("rank", F.row_number().over(window).cast("long"))
    same(rk.id_rank(skewed, "id", ["g"]).select("id", "rank"), plain.select("id", "rank"))
    piece = rk.id_slice(skewed, "id", ["g"], 1700, 2100, total="total")
    same(piece.select("id", "rank"), plain.filter("rank BETWEEN 1700 AND 2100").select("id", "rank"))
    sizes = {r.g: r["count"] for r in skewed.groupBy("g").count().collect()}
    assert all(r.total == sizes[r.g] for r in piece.select("g", "total").distinct().collect())


def test_take_quota_with_a_quota_per_group(spark, skewed):
    quotas = spark.createDataFrame([(0, 5000), (1, 10), (2, 0), (3, 10**9)], "g long, q long")
    key = rk.shuffle_key("s", "id")
    got = rk.take_quota(skewed, quotas, ["g"], "q", key, "id")
    window = Window.partitionBy("g").orderBy(key, "id")
    plain = skewed.join(quotas, "g").withColumn("rank", F.row_number().over(window)).filter("rank <= q")
    same(got.select("id", "g"), plain.select("id", "g"))


def test_buckets_are_small(skewed):
    for bucketed in (rk._by_hash(rk._with_group(skewed, ["g"], _total=F.count("*")), rk.shuffle_key(5, "id"), 500), rk._by_id(skewed, "id", ["g"], 500)):
        sizes = [r["count"] for r in bucketed.groupBy("g", "_bucket").count().collect()]
        assert max(sizes) < 1_000 and len(sizes) > 30


@pytest.mark.parametrize("ids", ["IF(id = 7, 9e17, id)", "id * 1000003 % 65537", "(id % 4) * 8589934592 + id"])
def test_gaps_and_outliers_among_ids(spark, ids):
    rows = spark.range(20_000).selectExpr(f"CAST({ids} AS BIGINT) AS id", "id % 2 AS g").dropDuplicates(["id"])
    assert max(r["count"] for r in rk._by_id(rows, "id", ["g"], 500).groupBy("_bucket").count().collect()) < 1_000
    window = Window.partitionBy("g").orderBy("id")
    plain = rows.withColumn("rank", F.row_number().over(window))
    page = rk.id_slice(rows, "id", ["g"], 5_001, 5_050)
    want = plain.filter("rank BETWEEN 5001 AND 5050").select("id", "g", "rank").collect()
    assert sorted(map(tuple, page.select("id", "g", "rank").collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_matter(spark, skewed, parts):
    quotas = spark.createDataFrame([(0, 300), (3, 20)], "g long, q long")
    draw = lambda df: {r.id for r in rk.take_quota(df, quotas, ["g"], "q", rk.shuffle_key(1, "id"), "id").collect()}
    assert draw(skewed.repartition(parts)) == draw(skewed)


def test_draws_are_uniform_and_fixed(spark):
    values = [r[0] for r in spark.range(20000).select(rk.uniform("s", "id")).collect()]
    assert all(0 <= v < 1 for v in values)
    assert abs(sum(values) / len(values) - 0.5) < 0.01
    assert values[:2] == [r[0] for r in spark.range(2).select(rk.uniform("s", "id")).collect()]
