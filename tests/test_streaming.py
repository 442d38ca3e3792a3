import pytest
from pyspark.sql import functions as F

from tallyweave.operators import evaluation as ev
from tallyweave.plans.domain import Domain
from tallyweave.session import scratch
from tallyweave.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return Domain(spark, SF_DIR).fx_result.persist()


def as_stream(spark, df, path, parts):
    """Write ``df`` as several files and read them one per micro-batch."""
    df.repartition(parts).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def same(a, b):
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])
    x, y = rounded(a), rounded(b)
    assert x.count() == y.count() and x.exceptAll(y).count() == 0


def test_reports_follow_many_batches(spark, results, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 3)  # several stored states within the run
    stream = as_stream(spark, results, tmp_path / "in", 8)
    got = jobs.stream_test_reports(stream, str(tmp_path / "out"))
    same(got, ev.test_report(results))
    assert spark.read.parquet(str(tmp_path / "out/cells/base")).select("batch_id").distinct().count() == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_a_restarted_stream_goes_on(spark, results, tmp_path):
    early, late = results.filter("image_id % 2 = 0"), results.filter("image_id % 2 = 1")
    run = lambda s: jobs.stream_test_reports(s, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    same(run(as_stream(spark, early, tmp_path / "in", 2)), ev.test_report(early))
    same(run(as_stream(spark, late, tmp_path / "in", 2)), ev.test_report(results))


def test_label_counts_and_status(spark, tmp_path):
    d = Domain(spark, SF_DIR)
    images = d.fx_image.select("image_id", "dataset_id", "label_id")
    got = jobs.stream_label_counts(as_stream(spark, images, tmp_path / "i", 4))
    same(got, images.filter("dataset_id IS NOT NULL").groupBy("dataset_id", "label_id").agg(F.count("*").alias("image_count")))
    events = d.fx_status_event
    got = jobs.stream_status(as_stream(spark, events, tmp_path / "e", 4))
    plain = events.groupBy("session_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))
    same(got, plain)


def test_no_input_gives_an_empty_state(spark, results, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(results.schema).parquet(str(tmp_path / "none"))
    got = jobs.stream_test_reports(stream)
    assert got.count() == 0 and "precision" in got.columns


def test_reexport_touches_changed_datasets_only(spark, tmp_path):
    tables = {
        "dataset": spark.createDataFrame([(1, "A"), (2, "B")], "dataset_id long, name string"),
        "label": spark.createDataFrame([(1, "L")], "label_id long, name string"),
        "dataset_label": spark.createDataFrame([(1, 1), (2, 1)], "dataset_id long, label_id long"),
        "image": spark.createDataFrame([(1, 1, 1, "x/a.png"), (2, 2, 1, "x/b.png")], "image_id long, dataset_id long, label_id long, image_path string"),
    }
    changes = spark.createDataFrame([(1, 1), (7, None)], "image_id long, dataset_id long")
    run = lambda: jobs.stream_reexport(as_stream(spark, changes, tmp_path / "in", 2), lambda: tables, str(tmp_path / "ex"), checkpoint=str(tmp_path / "cp"))
    assert [(r.dataset_slug, r.file_name) for r in run().collect()] == [("a", "a.png")]
    tables["image"] = tables["image"].filter("image_id = 2")
    assert [(r.dataset_slug, r.file_name) for r in run().collect()] == [("a", None)]


def test_many_batches_keep_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 4)
    folder, kept = str(tmp_path / "s"), lambda part: sorted(int(f.name.split("=")[1]) for f in (tmp_path / "s" / part).iterdir())
    rows = lambda b: spark.createDataFrame([(b % 7, b)], "k int, v int").coalesce(1)
    for b in range(30):
        jobs.write_delta(rows(b), folder, ["k"], b)
        assert len(kept("delta")) <= 8
    assert kept("base") == [23, 27] and kept("delta") == list(range(24, 30))
    newest = {r.k: r.v for r in jobs.latest(spark, folder, ["k"]).collect()}
    assert newest == {b % 7: b for b in range(23, 30)}
    # a batch that stored a state and is repeated finds all it needs
    jobs.write_delta(rows(27), folder, ["k"], 27)
    assert kept("base") == [23, 27]
    assert {r.k: r.v for r in jobs.latest(spark, folder, ["k"]).collect()} == newest


def test_a_started_job_returns_before_its_input_ends(spark, tmp_path):
    images = spark.createDataFrame([(i, i % 2, 1) for i in range(10)], "image_id long, dataset_id long, label_id long")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(images.schema).parquet(str(tmp_path / "in"))
    start = lambda: jobs.start_label_counts(stream, str(tmp_path / "out"), {"processingTime": "0 seconds"}, str(tmp_path / "cp"))
    job = start()
    assert job.query.isActive and job.state().count() == 0
    images.write.mode("append").parquet(str(tmp_path / "in"))
    job.query.processAllAvailable()
    assert job.query.isActive and {r.dataset_id: r.image_count for r in job.state().collect()} == {0: 5, 1: 5}
    job.stop()
    assert not job.query.isActive
    images.write.mode("append").parquet(str(tmp_path / "in"))
    job = start()
    job.query.processAllAvailable()
    assert {r.dataset_id: r.image_count for r in job.stop().collect()} == {0: 10, 1: 10}


def test_a_batch_takes_more_files_as_rows_grow(spark, monkeypatch):
    from tallyweave.plans import stream_queries as sq

    d, made = Domain(spark, "/root/testdata/sf0.001"), []
    make = lambda s, purpose: made.append(scratch(s, purpose)) or made[-1]
    rows = d.lineitem.count()
    monkeypatch.setattr(sq, "FILE_ROWS", -(-rows // 12))
    monkeypatch.setattr(sq, "scratch", make)
    counts = sq.arriving(d, "lineitem", jobs.stream_test_reports, "fx_result")
    assert len(spark.read.parquet(made[0]).inputFiles()) == 12
    batches = spark.read.parquet(f"{made[1]}/reports/delta").select("batch_id").distinct().count()
    assert batches == 4 and counts.agg(F.sum("rows")).first()[0] == rows
