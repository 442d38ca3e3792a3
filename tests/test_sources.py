import json

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import quality
from tallyweave.schemas import ENTITIES, PRE_MODELS
from tallyweave.sources import catalog, exports, ingest, seeds, sinks

SEED = [
    {"model": "datasets.dataset", "pk": 1, "fields": {"name": "First", "description": "", "labels": [1, 2], "resolution": "224x224", "created_at": "2021-02-03T04:05:06.789Z", "updated_at": "2021-02-03T05:00:00.250Z"}},
    {"model": "datasets.label", "pk": 1, "fields": {"name": "One", "created_at": "2022-07-08T09:10:11.125Z", "updated_at": "2022-07-08T09:10:12.500Z"}},
    {"model": "datasets.label", "pk": 2, "fields": {"name": "Two"}},
    {"model": "datasets.image", "pk": 4, "fields": {"dataset": 1, "image": "datasets/first-1/a.png", "label": 2}},
    {"model": "feature_extractor.tfmodel", "pk": 1, "fields": {"name": "M", "epochs": 5, "batch_size": 12, "validation_split": 0.2, "data_augmentation": False}},
    {"model": "feature_extractor.testresult", "pk": 3, "fields": {"test": 2, "image": 4, "prediction": "one", "confidence": 0.5}},
]


def test_seed_dump(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text(json.dumps(SEED, indent=1))
    tables = seeds.load_fixture_json(spark, str(path))
    assert {e: tables[e].schema.names for e in ("image", "model")} == {e: ENTITIES[e].names for e in ("image", "model")}
    dataset = tables["dataset"].first()
    assert (dataset.dataset_id, dataset.resolution, dataset.base, dataset.for_testing) == (1, "224x224", False, True)
    assert dataset.created_at.isoformat() == "2021-02-03T04:05:06.789000"
    assert sorted(r.label_id for r in tables["dataset_label"].collect()) == [1, 2]
    image = tables["image"].first()
    assert (image.image_id, image.dataset_id, image.label_id, image.image_path) == (4, 1, 2, "datasets/first-1/a.png")
    assert image.used_for_training is False
    model = tables["model"].first()
    assert (model.epochs, model.batch_size, model.fine_tuning, model.pre_model) == (5, 12, False, "mobilenet_v3_large_075_224")
    result = tables["result"].first()
    assert (result.test_id, result.image_id, result.prediction) == (2, 4, "one")
    broken = quality.violations({k: tables[k] for k in ("dataset", "label", "image", "model")})
    assert [(r.rule, r.id) for r in broken.collect()] == [("unknown resolution", 1)]


def test_catalog_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s")], "study_id int, name string").withColumns(
        {"description": F.lit(None), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    )
    catalog.write_catalog(rows, str(tmp_path), "study")
    back = catalog.read_catalog(spark, str(tmp_path), "study")
    assert back.schema == ENTITIES["study"] and back.first().name == "s"


def test_stored_names(spark):
    stored = spark.createDataFrame([(3, 2, "datasets/a.png", 1, True, False, None, None)], "id int, dataset_id int, image string, label_id int, used_for_training boolean, used_for_testing boolean, created_at timestamp, updated_at timestamp")
    row = catalog.from_stored(stored, "image").first()
    assert (row.image_id, row.image_path, row.label_id) == (3, "datasets/a.png", 1)
    assert len(PRE_MODELS) == 50


def test_ingest_is_all_or_nothing_per_request(spark):
    datasets = spark.createDataFrame([(1, "My Set")], "dataset_id long, name string")
    labels = spark.createDataFrame([(1,), (2,)], "label_id long")
    images = spark.createDataFrame([(41,)], "image_id long")
    uploads = spark.createDataFrame([(10, 1, 1, "a.png"), (11, 1, 2, "b.png"), (12, 1, 9, "c.png"), (13, 8, 1, "d.png")], "upload_id long, dataset_id long, label_id long, file_name string")
    good, bad = ingest.ingest_images(uploads, datasets, labels, images)
    assert sorted((r.image_id, r.image_path) for r in good.collect()) == [(42, "datasets/my_set-1/a.png"), (43, "datasets/my_set-1/b.png")]
    assert sorted((r.reason, r.files) for r in bad.collect()) == [("unknown dataset", 1), ("unknown label", 1)]


def test_labelled_folder(spark, tmp_path):
    for name in ("b class/1.png", "a/2.JPG", "a/x.txt", "c++ 50%20/sub/deep/3.jpeg", "c++ 50%20/png", "top.png", "_hidden/4.png"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True, parents=True)
        f.write_bytes(b"12345")
    (tmp_path / "b_empty").mkdir()
    short = lambda r: r.path.rsplit("/", 1)[1]
    scan = lambda **how: sorted((short(r), r.label, r.class_idx, r.length) for r in ingest.scan_labelled_dir(spark, str(tmp_path) + "/", **how).collect())
    refused = lambda **how: sorted((short(r), r.label, r.reason) for r in ingest.scan_rejects(spark, str(tmp_path), **how).collect())
    assert ingest.class_folders(spark, str(tmp_path)) == ["a", "b class", "b_empty", "c++ 50%20"]
    assert scan() == [("1.png", "b class", 1, 5), ("2.JPG", "a", 0, 5), ("3.jpeg", "c++ 50%20", 3, 5)]
    assert refused() == [("png", "c++ 50%20", "ending not accepted"), ("top.png", None, "not in a class folder"), ("x.txt", "a", "ending not accepted")]
    # the labels of a collection as classes
    assert scan(classes=["z", "b class"]) == [("1.png", "b class", 0, 5)]
    assert ("2.JPG", "a", "unknown class") in refused(classes=["z", "b class"])
    assert scan(classes=[]) == []
    assert [r[0] for r in scan(endings=["txt"])] == ["x.txt"]
    empty = tmp_path / "b_empty"
    assert ingest.scan_labelled_dir(spark, str(empty)).count() == 0 and ingest.class_folders(spark, str(empty)) == []


def test_a_dump_written_is_the_dump_loaded(spark, tmp_path):
    path = str(tmp_path / "dump")
    (tmp_path / "seed.json").write_text(json.dumps(SEED))
    first = seeds.load_fixture_json(spark, str(tmp_path / "seed.json"))
    seeds.write_fixture_json(first, path, per_file=1)
    again = seeds.load_fixture_json(spark, path)
    for entity, rows in first.items():
        assert sorted(rows.collect(), key=repr) == sorted(again[entity].collect(), key=repr), entity


def test_the_manifest_reads_the_images_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, "x/a.png")], "image_id long, dataset_id long, label_id long, image_path string").write.parquet(str(tmp_path / "i"))
    images = spark.read.parquet(str(tmp_path / "i"))
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: read.add(1) or x, "long").asNondeterministic()
    datasets = spark.createDataFrame([(1, "A")], "dataset_id long, name string")
    labels = spark.createDataFrame([(1, "L"), (2, "M")], "label_id long, name string")
    links = spark.createDataFrame([(1, 1), (1, 2)], "dataset_id long, label_id long")
    for _ in range(2):  # with and without an earlier export
        exports.write_export(exports.export_manifest(images.withColumn("image_id", counted("image_id")), datasets, labels, links), str(tmp_path / "e"))
    assert read.value == 2
    assert sorted((r.label_slug, r.file_name) for r in exports.read_export(spark, str(tmp_path / "e")).collect()) == [("l", "a.png"), ("m", None)]


def test_export_replaces_whole_datasets(spark, tmp_path):
    path = str(tmp_path / "export")
    datasets = spark.createDataFrame([(1, "Set A"), (2, "Set B")], "dataset_id long, name string")
    labels = spark.createDataFrame([(1, "L One"), (2, "L Two"), (3, "L Three")], "label_id long, name string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "dataset_id long, label_id long")
    images = spark.createDataFrame([(1, 1, 1, "x/a.png"), (2, 1, 1, "y/a.png"), (3, 1, 3, "x/b.png"), (4, 2, 1, "x/c.png")], "image_id long, dataset_id long, label_id long, image_path string")
    manifest = exports.export_manifest(images, datasets, labels, links)
    got = lambda: sorted((r.dataset_slug, r.label_slug, r.file_name, r.image_id) for r in exports.read_export(spark, path).collect())
    exports.write_export(manifest, path)
    first = [("set_a", "l_one", "a.png", 1), ("set_a", "l_two", None, None), ("set_b", "l_one", "c.png", 4)]
    assert sorted(got(), key=repr) == sorted(first, key=repr)
    exports.write_export(manifest, path)
    assert sorted(got(), key=repr) == sorted(first, key=repr)
    # label two leaves set A; set B is not exported again and stays
    again = exports.export_manifest(images, datasets, labels, links.filter("dataset_id = 1 AND label_id = 1"))
    exports.write_export(again, path)
    assert got() == [("set_a", "l_one", "a.png", 1), ("set_b", "l_one", "c.png", 4)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "epochs")
    epochs = spark.createDataFrame([(1, 1, 0.5, 1.0, 0.4, 1.1)], "session_id long, number int, accuracy double, loss double, val_accuracy double, val_loss double")
    sinks.append_epochs(epochs, path)
    sinks.append_epochs(epochs.withColumn("number", F.lit(2)), path)
    stored = spark.read.parquet(path).collect()
    assert len(stored) == 2 and len({r.epoch_id for r in stored}) == 2
    results = spark.createDataFrame([(1, 2, "a", "b", 0.5)], "test_id long, image_id long, true_label string, prediction string, confidence double")
    sinks.append_results(results, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).first().grad_cam is None


def test_a_batch_is_appended_once_and_ids_have_no_gaps(spark, tmp_path):
    path = str(tmp_path / "batches")
    make = lambda n, first: spark.range(first, first + n).select(F.lit(1).alias("session_id"), F.col("id").cast("int").alias("number"), F.rand(1).alias("loss"))
    assert sinks.read_batches(spark, path, "epoch").count() == 0
    assert sinks.append_batch(make(40, 0), path, "epoch", "a")
    first = {r.number: r.epoch_id for r in sinks.read_batches(spark, path, "epoch").collect()}
    assert sorted(first.values()) == list(range(1, 41))
    assert not sinks.append_batch(make(40, 0), path, "epoch", "a")
    assert sinks.append_batch(make(0, 0), path, "epoch", "nothing") and not sinks.append_batch(make(5, 0), path, "epoch", "nothing")
    # a writer that died left rows without a commit: they are not read, and the batch is written over
    make(7, 100).withColumn("epoch_id", F.lit(41).cast("long")).write.parquet(f"{path}/rows/batch=007")
    assert sinks.read_batches(spark, path, "epoch").count() == 40
    assert sinks.append_batch(make(10, 100).repartition(5), path, "epoch", "007")
    stored = sinks.read_batches(spark, path, "epoch").collect()
    assert sorted(r.epoch_id for r in stored) == list(range(1, 51)) and {r.batch for r in stored} == {"a", "007"}
    other = str(tmp_path / "others")
    sinks.append_batch(make(40, 0).repartition(7), other, "epoch", "a")
    assert {r.number: r.epoch_id for r in sinks.read_batches(spark, other, "epoch").collect()} == first
    with pytest.raises(ValueError):
        sinks.append_batch(make(1, 0), path, "epoch", "../x")


def test_weights_are_replaced_per_session(spark, tmp_path):
    path = str(tmp_path / "weights")
    rows = [(1, "one", 0, "a", [1.0, 2.0], 0.5), (2, "two", 0, "a", [3.0, 4.0], 0.5)]
    frame = spark.createDataFrame(rows, "session_id long, session_slug string, class_idx int, class_name string, w array<double>, b double")
    sinks.write_weights(frame, path)
    sinks.write_weights(frame.filter("session_id = 1").withColumn("b", F.lit(9.0)), path)
    assert {r.session_id: r.b for r in sinks.read_weights(spark, path).collect()} == {1: 9.0, 2: 0.5}
    assert sinks.read_weights(spark, path, "two").first().w == [3.0, 4.0]


def test_a_dump_is_parsed_once_and_lies_in_one_folder(spark, tmp_path):
    path = tmp_path / "dump"
    results = spark.createDataFrame([(i, 7, 100 + i, "a", "b", 0.5) for i in range(50)], "result_id long, test_id long, image_id long, true_label string, prediction string, confidence double")
    images = spark.createDataFrame([(1, 2, 3, "x/1.png")], "image_id long, dataset_id long, label_id long, image_path string")
    seeds.write_fixture_json({"result": results, "image": images}, str(path), per_file=10)
    assert not [p for p in path.iterdir() if p.is_dir()]
    for file in path.glob("part-*.txt"):
        assert json.loads(file.read_text())
    loaded = seeds.load_fixture_json(spark, str(path))
    assert [r.image_path for r in loaded["image"].collect()] == ["x/1.png"]
    assert sorted(r.image_id for r in loaded["result"].collect()) == list(range(100, 150))
    for entity, rows in loaded.items():
        assert "FileScan json" not in rows._jdf.queryExecution().toString(), entity


def test_dumps_are_compressed_arrays_that_no_shuffle_made(spark, tmp_path):
    import gzip

    results = spark.range(0, 95, 1, 3).selectExpr("id AS result_id", "id + 100 AS image_id", "id % 7 AS test_id")
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    seeds.write_fixture_json({"result": results}, str(tmp_path / "dump"), per_file=10)
    jobs = set(tracker.getJobIdsForGroup()) - before
    assert [len(tracker.getJobInfo(job).stageIds) for job in jobs] == [1]
    arrays = [json.loads(gzip.open(file).read()) for file in (tmp_path / "dump").glob("part-*.gz")]
    assert sorted(len(array) for array in arrays) == [1, 2, 2] + [10] * 9
    assert sorted(record["pk"] for array in arrays for record in array) == list(range(95))
    loaded = seeds.load_fixture_json(spark, str(tmp_path / "dump"))["result"]
    assert sorted(r.image_id for r in loaded.collect()) == list(range(100, 195))


def test_notes_of_a_labelled_folder_are_written_by_all_tasks(spark, tmp_path):
    from types import SimpleNamespace

    from tallyweave.plans import catalog_queries

    images = spark.range(40).selectExpr("id AS image_id", "id % 2 AS dataset_id", "id % 3 AS label_id").repartition(4)
    root = catalog_queries._labelled_folder(SimpleNamespace(spark=spark, fx_image=images))
    assert spark.read.format("binaryFile").load(f"{root}/a class of notes").count() == 4
