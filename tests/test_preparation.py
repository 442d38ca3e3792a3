import pytest
from pyspark.sql import functions as F

from tallyweave.operators import preparation as pp


@pytest.mark.parametrize("size", [1, 2, 3, 97, 1_000])
def test_permutation_is_one_to_one(spark, size):
    rows = spark.range(size).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number"), F.lit(size).cast("long").alias("n"))
    placed = rows.withColumn("to", pp.permuted(F.col("id"), F.col("n"), pp._round_keys(7, F.col("number"), F.col("n")))).collect()
    orders = []
    for number in (1, 2, 3):
        part = {r.id: r.to for r in placed if r.number == number}
        assert sorted(part.values()) == list(range(size))
        orders.append([part[i] for i in range(size)])
    if size >= 97:
        assert orders[0] != orders[1] != orders[2]
        assert max(sum(a == b for a, b in zip(x, range(size), strict=True)) for x in orders) < 12
        # neighbours do not stay neighbours
        assert sum(abs(a - b) == 1 for a, b in zip(orders[0], orders[0][1:], strict=False)) < size / 10


def test_plan_does_not_depend_on_partitions_and_sorts_once(spark):
    images = spark.range(500).select((F.col("id") * 3).alias("image_id"))
    one = pp.batch_plan(images.repartition(1), 4, 16)
    many = pp.batch_plan(images.repartition(7), 4, 16)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}
    plan = pp.batch_plan(images, 40, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.index("Generate") < plan.index("Window [")
    rows = one.collect()
    assert len(rows) == 4 * (500 // 16) * 16 - sum(16 - 500 % 16 for _ in range(3)) and {r.slot for r in rows} == set(range(1, 17))
