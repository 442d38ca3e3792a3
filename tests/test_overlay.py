from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.session import scratch
from tallyweave.sources import overlay

IMAGE = "image_id long, dataset_id long, image_path string, label_id long, used_for_training boolean, used_for_testing boolean"


@pytest.fixture
def table(spark):
    path = scratch(spark, "table")
    rows = spark.range(2000).select(
        F.col("id").alias("image_id"), (F.col("id") % 3).alias("dataset_id"), F.format_string("p/%d.png", "id").alias("image_path"),
        (F.col("id") % 5).alias("label_id"), F.lit(False).alias("used_for_training"), F.lit(False).alias("used_for_testing"),
    )
    overlay.create_table(rows, path, "image", buckets=16)
    return path


def state(spark, path, as_of=None):
    rows = overlay.read_current(spark, path, "image", as_of).select("image_id", "dataset_id", "image_path", "used_for_training").collect()
    assert len({r.image_id for r in rows}) == len(rows)
    return {r.image_id: tuple(r)[1:] for r in rows}


def moved(spark, *rows):
    return spark.createDataFrame(list(rows), "image_id long, dataset_id long, used_for_training boolean")


def size(path):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))


def test_changes_set_their_columns_and_keep_the_others(spark, table):
    start = state(spark, table)
    assert len(start) == 2000 and start[7] == (1, "p/7.png", False)
    assert overlay.write_changes(spark, table, "image", 1, moved(spark, (7, 50, True), (8, None, True), (5000, 50, False)))
    now = state(spark, table)
    assert now[7] == (50, "p/7.png", True) and now[8] == (None, "p/8.png", True) and now[5000] == (50, None, False)
    assert len(now) == 2001 and {k: v for k, v in now.items() if k not in (7, 8, 5000)} == {k: v for k, v in start.items() if k not in (7, 8)}


def test_batches_follow_each_other_column_by_column(spark, table):
    overlay.write_changes(spark, table, "image", 1, moved(spark, (7, 50, True)))
    overlay.write_changes(spark, table, "image", 2, spark.createDataFrame([(7, "q.png")], "image_id long, image_path string"))
    overlay.write_changes(spark, table, "image", 3, moved(spark, (7, 60, False)))
    assert state(spark, table)[7] == (60, "q.png", False)
    assert state(spark, table, 2)[7] == (50, "q.png", True) and state(spark, table, 0)[7] == (1, "p/7.png", False)
    # a batch that is written again replaces itself
    assert overlay.write_changes(spark, table, "image", 3, moved(spark, (7, 70, False)))
    assert state(spark, table)[7] == (70, "q.png", False)


def test_deleted_rows_come_back_empty(spark, table):
    keys = spark.createDataFrame([(7,), (9,), (9999,)], "image_id long")
    overlay.write_changes(spark, table, "image", 1, moved(spark, (7, 50, True)))
    overlay.write_changes(spark, table, "image", 2, moved(spark, (10, 50, True)), gone=keys)
    now = state(spark, table)
    assert len(now) == 1998 and not {7, 9, 9999} & set(now) and now[10] == (50, "p/10.png", True)
    overlay.write_changes(spark, table, "image", 3, spark.createDataFrame([(7, "new.png")], "image_id long, image_path string"))
    assert state(spark, table)[7] == (None, "new.png", None)


def test_compaction_changes_no_row_and_rewrites_touched_buckets_only(spark, table):
    overlay.write_changes(spark, table, "image", 1, moved(spark, (7, 50, True), (5000, 50, True)))
    overlay.write_changes(spark, table, "image", 2, gone=spark.createDataFrame([(8,)], "image_id long"))
    before, first = state(spark, table), state(spark, table, 1)
    numbers = overlay.compact(spark, table, "image")
    assert 1 <= len(numbers) <= 3 and state(spark, table) == before and state(spark, table, 1) == first
    assert overlay.compact(spark, table, "image") == []
    # what is inside the base is not written again
    assert not overlay.write_changes(spark, table, "image", 2, moved(spark, (7, 99, True)))
    overlay.write_changes(spark, table, "image", 3, moved(spark, (7, 51, True), (11, 51, True)))
    overlay.compact(spark, table, "image")
    now = state(spark, table)
    assert now[7][0] == now[11][0] == 51 and now[5000][0] == 50 and 8 not in now and len(now) == 2000


def test_a_table_can_lose_all_its_rows(spark, table):
    overlay.write_changes(spark, table, "image", 1, gone=spark.range(2000).select(F.col("id").alias("image_id")))
    assert state(spark, table) == {}
    assert len(overlay.compact(spark, table, "image")) == 16
    assert state(spark, table) == {} and len(state(spark, table, 0)) == 2000
    overlay.write_changes(spark, table, "image", 2, moved(spark, (1, 5, True)))
    assert state(spark, table) == {1: (5, None, True)}


def test_a_compaction_that_died_is_not_read(spark, table):
    overlay.write_changes(spark, table, "image", 1, moved(spark, (7, 50, True)))
    before = state(spark, table)
    # rows of the next version are there, but not its layout
    spark.createDataFrame([(7, 1)], "image_id long, dataset_id long").write.parquet(f"{table}/base/version=1/bucket=3")
    assert state(spark, table) == before
    overlay.compact(spark, table, "image")
    assert state(spark, table) == before


def test_two_changes_of_one_key_in_a_batch_are_refused(spark, table):
    overlay.write_changes(spark, table, "image", 1, moved(spark, (7, 50, True), (7, 51, True)))
    with pytest.raises(Exception, match="more than one change"):
        state(spark, table)


def test_a_small_change_is_a_small_file(spark):
    path = scratch(spark, "large")
    rows = spark.range(400_000).select(
        F.col("id").alias("image_id"), F.lit(1).alias("dataset_id"), F.md5(F.col("id").cast("string")).alias("image_path"),
        F.lit(1).alias("label_id"), F.lit(False).alias("used_for_training"), F.lit(False).alias("used_for_testing"),
    )
    overlay.create_table(rows, path, "image")
    whole = size(path)
    changes = spark.range(100).select(F.col("id").alias("image_id"), F.lit(2).alias("dataset_id"), F.lit(True).alias("used_for_training"))
    overlay.write_changes(spark, path, "image", 1, changes.coalesce(1))
    assert size(f"{path}/changes") < 20_000 < whole / 100
    current = overlay.read_current(spark, path, "image")
    assert current.filter("dataset_id = 2").count() == 100
    # the base meets the changes by broadcast joins and is not shuffled
    plan = current._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin image_id" not in plan.split("LeftAnti")[0]
