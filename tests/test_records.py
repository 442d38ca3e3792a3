from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.operators import lookups as lk
from tallyweave.operators import quality
from tallyweave.operators import records as rc


def test_cascade_follows_the_delete_rules(spark):
    make = spark.createDataFrame
    tables = {
        "study": make([(1,), (2,)], "study_id long"),
        "label": make([(1,), (2,)], "label_id long"),
        "dataset": make([(1, 1), (2, 2), (3, None)], "dataset_id long, study_id long"),
        "dataset_label": make([(1, 1), (2, 1), (3, 2)], "dataset_id long, label_id long"),
        "dataset_shared": make([(1, 2), (2, 1), (3, 2)], "dataset_id long, study_id long"),
        "model": make([(1,)], "model_id long"),
        "session": make([(1, 1, 1, 1), (2, 2, 2, 1), (3, 2, 1, 1)], "session_id long, study_id long, dataset_id long, model_id long"),
        "image": make([(1, 1, 1), (2, 2, 1), (3, None, 2)], "image_id long, dataset_id long, label_id long"),
        "epoch": make([(1, 1), (2, 2)], "epoch_id long, session_id long"),
        "test": make([(1, 2, 1), (2, 2, 2)], "test_id long, dataset_id long, session_id long"),
        "result": make([(1, 1, 1), (2, 2, 1), (3, 2, None)], "result_id long, test_id long, image_id long"),
    }
    keys = lambda name, col: sorted(r[0] for r in left[name].select(col).collect())
    left = rc.cascade_delete(tables, "study", make([(1,)], "study_id long"))
    assert keys("dataset", "dataset_id") == [2, 3]
    # session 1 by its study, session 3 because its dataset goes
    assert keys("session", "session_id") == [2] and keys("epoch", "epoch_id") == [2]
    assert keys("test", "test_id") == [2] and keys("result", "result_id") == [2, 3]
    assert keys("dataset_label", "dataset_id") == [2, 3] and keys("dataset_shared", "dataset_id") == [3]
    images = {r.image_id: r.dataset_id for r in left["image"].collect()}
    assert images == {1: None, 2: 2, 3: None}
    left = rc.cascade_delete(tables, "label", make([(1,)], "label_id long"))
    assert keys("image", "image_id") == [3] and keys("result", "result_id") == [3] and keys("dataset_label", "dataset_id") == [3]


def test_links(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "dataset_id long, label_id long")
    new = spark.createDataFrame([(1, 3), (1, 3), (9, 9)], "dataset_id long, label_id long")
    owners = spark.createDataFrame([(1,)], "dataset_id long")
    assert sorted(tuple(r) for r in rc.set_labels(links, owners, new).collect()) == [(1, 3), (2, 1)]
    assert sorted(tuple(r) for r in rc.set_labels(links, owners, new.limit(0)).collect()) == [(2, 1)]


def test_status_and_upsert(spark):
    old, t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)
    table = spark.createDataFrame([(1, "a", "Pending", old, old), (2, "b", "Pending", old, old)], "id long, name string, status string, created_at timestamp, updated_at timestamp")
    updates = spark.createDataFrame([(1, 1, "Training", t1), (1, 2, "Completed", t2), (1, 3, "Failed", t2)], "id long, seq long, status string, ts timestamp")
    got = {r.id: r for r in rc.apply_status(table, updates, "id", tie="seq").collect()}
    assert (got[1].status, got[1].updated_at) == ("Failed", t2)
    assert (got[2].status, got[2].updated_at) == ("Pending", old)
    rows = spark.createDataFrame([(2, "B"), (3, "c")], "id long, name string")
    now = F.lit(t2)
    got = {r.id: r for r in rc.upsert(table, rows, "id", now).collect()}
    assert (got[1].name, got[1].updated_at) == ("a", old)
    assert (got[2].name, got[2].status, got[2].created_at, got[2].updated_at) == ("B", "Pending", old, t2)
    assert (got[3].name, got[3].status, got[3].created_at) == ("c", None, t2)


def test_model_default(spark):
    models = spark.createDataFrame([(1, False), (4, True), (2, True)], "model_id long, is_default boolean")
    requests = spark.createDataFrame([(1, 9), (2, 0), (3, None)], "request_id long, model_id long")
    requests = requests.union(spark.createDataFrame([(4, 4)], requests.schema))
    good, bad = lk.resolve_model(requests, models)
    assert {r.request_id: r.model_id for r in good.collect()} == {2: 2, 3: 2, 4: 4}
    assert [(r.request_id, r.reason) for r in bad.collect()] == [(1, "unknown model")]
    good, bad = lk.resolve_model(requests, models.filter("model_id = 1"))
    assert good.count() == 0 and {r.request_id: r.reason.split()[0] for r in bad.collect()} == {1: "unknown", 2: "no", 3: "no", 4: "unknown"}


def test_documents_round_trip(spark):
    datasets = spark.createDataFrame([(1,), (2,)], "dataset_id long")
    labels = spark.createDataFrame([(1, 5), (1, 3)], "dataset_id long, label_id long")
    shared = spark.createDataFrame([(1, 7), (1, 8), (1, 9)], "dataset_id long, study_id long")
    docs = lk.dataset_documents(datasets, labels, shared)
    got = {r.dataset_id: (r.labels, r.shared) for r in docs.collect()}
    assert got == {1: ([3, 5], [7, 8, 9]), 2: ([], [])}
    back = lk.flatten_documents(docs)
    assert back[0].exceptAll(labels).count() == 0 and back[1].count() == 3


def test_result_without_image(spark):
    make = spark.createDataFrame
    docs = lk.result_documents(
        make([(1, 1, None), (2, 1, 1)], "result_id long, test_id long, image_id long"),
        make([(1, 1, 1)], "test_id long, dataset_id long, session_id long"),
        make([(1, "s")], "session_id long, name string"),
        make([(1, None, 1)], "image_id long, dataset_id long, label_id long"),
        make([(1, "d")], "dataset_id long, name string"),
        make([(1, "l")], "label_id long, name string"),
    )
    got = {r.result_id: r for r in docs.collect()}
    assert got[1].image is None and got[1].test.dataset.name == "d"
    assert got[2].image.label.name == "l" and got[2].image.dataset is None


def test_violations(spark):
    tables = {
        "study": spark.createDataFrame([(1,)], "study_id long"),
        "dataset": spark.createDataFrame([(1, 1, "a", "224"), (2, 7, "a", "224x224"), (3, None, "x" * 101, "512")], "dataset_id long, study_id long, name string, resolution string"),
    }
    got = sorted((r.rule, r.id) for r in quality.violations(tables).collect())
    assert got == [("dangling study_id", 2), ("name not unique", 1), ("name not unique", 2), ("name too long", 3), ("unknown resolution", 2)]


def test_request_validation(spark):
    studies = spark.createDataFrame([(1,)], "study_id long")
    rows = [(1, 5, None, 1), (2, None, 50, 1), (3, 0, 0, 1), (4, 5, None, None), (5, 5, None, 9)]
    requests = spark.createDataFrame(rows, "request_id long, dataset_id long, hotdataset int, study_id long")
    good, bad = quality.validate_session_requests(requests, studies)
    assert {r.request_id for r in good.collect()} == {1, 2}
    assert {r.request_id: r.reason.split()[-1] for r in bad.collect()} == {3: "provided.", 4: "required.", 5: "exist."}


def test_requests_name_what_exists(spark):
    studies = spark.createDataFrame([(1,)], "study_id long")
    datasets = spark.createDataFrame([(5, False), (6, False)], "dataset_id long, base boolean")
    models = spark.createDataFrame([(3,)], "model_id long")
    rows = [(1, 5, 0, 3, 1), (2, 7, 0, 3, 1), (3, 5, 50, 3, 1), (4, 6, None, 4, 1), (5, 6, None, 0, 1), (6, 6, None, None, 1)]
    requests = spark.createDataFrame(rows, "request_id long, dataset_id long, hotdataset int, model_id long, study_id long")
    good, bad = quality.validate_session_requests(requests, studies, datasets, models)
    assert good.columns == requests.columns and {r.request_id for r in good.collect()} == {1, 5, 6}
    assert {r.request_id: r.reason for r in bad.collect()} == {2: "unknown dataset", 3: "no base dataset to draw from", 4: "unknown model"}
    based = datasets.union(spark.createDataFrame([(9, True)], datasets.schema))
    assert 3 in {r.request_id for r in quality.validate_session_requests(requests, studies, based, models)[0].collect()}
