"""Plan shapes that must hold at any scale."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import evaluation as ev
from tallyweave.operators import filters as fl
from tallyweave.operators import membership as mb
from tallyweave.operators import preparation as pp
from tallyweave.plans.domain import Domain
from tallyweave.plans.registry import load_all

SF_DIR = "/root/testdata/sf0.001"
# these train a model or run a stream while being built
EAGER = ("k1", "k2", "k3", "s1", "s2", "s3", "s4")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in load_all() if not n.startswith(EAGER)])
def test_no_product_joins(spark, name):
    text = plan(load_all()[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr(
        "id AS session_id", "id % 3 AS study_id", "'x' AS name", "'Pending' AS status", "'long text' AS notes"
    ).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    text = plan(fl.sessions_by_status(stored, "Pending").select("session_id"))
    assert "EqualTo(status,Pending)" in text
    assert "notes" not in text


def test_report_scans_the_results_once_and_has_no_join(spark):
    d = Domain(spark, SF_DIR)
    results = d.fx_result.select("test_id", "true_label", "prediction", "confidence")
    joins = plan(results).count("Join ")
    text = plan(ev.test_report(results))
    assert text.count("Join ") == joins  # only the join that makes the fixture
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange hashpartitioning") == 2  # result rows by cell, cells by test


def test_no_window_over_a_whole_group(spark):
    """Row numbers are taken inside a bucket, never over a label or over everything."""
    images = spark.range(50).selectExpr("id AS image_id", "1 AS label_id")
    for df in (pp.train_val_split(images, 0.2), pp.batch_plan(images, 2, 8)):
        for line in plan(df).splitlines():
            if "row_number" in line and "Window" in line:
                assert "_bucket" in line


def test_optional_filters_do_not_filter(spark):
    images = spark.range(5).selectExpr("id AS image_id", "id AS dataset_id", "id AS label_id")
    assert fl.images_by(images).count() == 5
    assert fl.images_by(images, dataset_id=1, label_id=2).count() == 0
    assert mb.apply_moves(
        images.withColumns({f: F.lit(False) for f in mb.FLAGS}),
        spark.createDataFrame([], "image_id long, new_dataset_id long, used_for_training boolean, used_for_testing boolean"),
    ).count() == 5
