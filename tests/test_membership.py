import pytest
from pyspark.sql import functions as F

from tallyweave.operators import listings as ls
from tallyweave.operators import lookups as lk
from tallyweave.operators import membership as mb
from tallyweave.operators import preparation as pp

IMAGE = "image_id long, dataset_id long, label_id long, image_path string, used_for_training boolean, used_for_testing boolean"


@pytest.fixture(scope="module")
def datasets(spark):
    return spark.createDataFrame(
        [
            (1, 1, "Base One", "224", True, False), (2, 1, "Train One", "224", False, False), (3, 1, "Test One", "384", False, True),
            (4, 2, "Base Two", "512", True, False), (5, 3, "Base A", "224", True, False), (6, 3, "Base B", "224", True, False),
        ],
        "dataset_id long, study_id long, name string, resolution string, base boolean, for_testing boolean",
    )


@pytest.fixture(scope="module")
def images(spark):
    rows = [
        # base one: label 1 has four images (one used for testing), label 2 has two
        (1, 1, 1, "d/a.png", False, False), (2, 1, 1, "d/b.png", False, False), (3, 1, 1, "d/c.png", False, True),
        (4, 1, 1, "d/e.png", True, False), (5, 1, 2, "d/f.png", False, False), (6, 1, 2, "d/g.png", False, False),
        # training and testing set of study one
        (7, 2, 1, "d/h.png", True, False), (8, 3, 1, "x/a.png", False, True), (9, 3, 2, "x/b.png", False, True),
        (14, 3, 2, "y/a.png", False, True), (15, 3, 2, "y/none.png", False, True),
        # base two: one a.png, two b.png, one name that merely ends in a.png
        (10, 4, 1, "z/a.png", False, False), (11, 4, 2, "z/b.png", False, False), (12, 4, 1, "w/b.png", False, False),
        (13, None, 1, "d/lost.png", False, False),
    ]
    return spark.createDataFrame(rows, IMAGE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, lab) for d in range(1, 7) for lab in (1, 2)], "dataset_id long, label_id long")


def requests(spark, *rows):
    ids = spark.createDataFrame(rows, "dataset_id long, study_id long, n long")
    return ids, ids.select("dataset_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("label_id"))


def kept_whole(before, after):
    """No image is lost, doubled or renamed by a move."""
    keys = ["image_id", "image_path", "label_id"]
    assert before.select(keys).exceptAll(after.select(keys)).count() == 0
    assert after.select(keys).exceptAll(before.select(keys)).count() == 0


def test_testing_set(spark, images, datasets):
    edit = mb.make_testing_set(images, datasets, *requests(spark, (100, 1, 2)), seed=1)
    moved = edit.changes.collect()
    assert len(moved) == 4 and all(r.used_for_testing and r.old_dataset_id == 1 for r in moved)
    assert 3 not in {r.image_id for r in moved}  # already used for testing
    kept_whole(images, edit.images)
    assert edit.images.filter("dataset_id = 100 AND used_for_testing").count() == 4


def test_strict_sampling_is_all_or_nothing(spark, images, datasets):
    edit = mb.make_testing_set(images, datasets, *requests(spark, (100, 1, 3)), seed=1)
    assert edit.changes.count() == 0
    short = edit.rejected.collect()
    assert [(r.label_id, r.quota, r.available) for r in short] == [(2, 3, 2)]
    assert edit.images.exceptAll(images.select(edit.images.columns)).count() == 0


def test_requests_of_one_study_are_served_in_turn(spark, images, datasets):
    edit = mb.make_testing_set(images, datasets, *requests(spark, (100, 1, 1), (101, 1, 1), (102, 1, 50)), seed=1)
    moved = edit.changes.collect()
    assert {r.new_dataset_id for r in moved} == {100, 101} and len({r.image_id for r in moved}) == len(moved)
    assert {r.new_dataset_id for r in edit.rejected.collect()} == {102}
    assert edit.images.count() == images.count()


def test_training_set(spark, images, datasets):
    fresh = mb.make_training_set(images, datasets, *requests(spark, (100, 1, 2)), seed=1)
    got = {r.image_id for r in fresh.changes.collect()}
    assert got == {1, 2, 5, 6}  # not 3 (test-used), not 4 (training-used)
    dated = datasets.withColumn("created_at", F.current_timestamp())
    more = mb.make_training_set(images, dated, *requests(spark, (100, 1, 2)), seed=1, prior="latest")
    got = {r.image_id for r in more.changes.collect()}
    assert 7 in got and len(got) == 4 and len(got & {1, 2}) == 1
    # the carry-over is not cut when it already exceeds the wanted number
    none = mb.make_training_set(images, dated, *requests(spark, (100, 1, 0)), seed=1, prior="latest")
    assert {r.image_id for r in none.changes.collect()} == {7}


def test_soft_sampling_skips_short_labels(spark, images, labels):
    ask = lambda n: spark.createDataFrame([(1, 2, n)], "dataset_id long, target_id long, n long")
    got = mb.move_random(images, labels, ask(3), seed=1)
    assert got.changes.count() == 3 and all(r.used_for_training for r in got.changes.collect())
    assert mb.move_random(images, labels, ask(7), seed=1).changes.count() == 0
    kept_whole(images, got.images)


def test_requests_on_one_base_share_what_there_is(spark, images, labels, datasets):
    ask = spark.createDataFrame([(1, 2, 2), (1, 3, 1), (1, 4, 50), (1, 77, 1)], "dataset_id long, target_id long, n long")
    edit = mb.move_random(images, labels, ask, 1, datasets)
    moved = edit.changes.collect()
    assert len({r.image_id for r in moved}) == len(moved) and edit.images.count() == images.count()
    assert {r.new_dataset_id for r in moved} == {2, 3}
    assert {(r.target_id, r.n) for r in edit.rejected.collect()} == {(4, 50), (77, 1)}


def test_requests_with_one_origin(spark, images, datasets):
    ask = spark.createDataFrame([(2, 1), (2, 4)], "origin_id long, target_id long")
    edit = mb.move_all(images, datasets, ask)
    assert edit.images.count() == images.count()
    assert {r.new_dataset_id for r in edit.changes.collect()} == {1}
    assert [(r.origin_id, r.target_id) for r in edit.rejected.collect()] == [(2, 4)]


def test_two_changes_of_one_image_are_an_error(spark, images):
    twice = spark.createDataFrame([(1, 1, 2, False, False), (1, 1, 3, False, False)],
                                  "image_id long, old_dataset_id long, new_dataset_id long, used_for_training boolean, used_for_testing boolean")
    with pytest.raises(Exception, match="more than one change"):
        mb.apply_moves(images, twice).collect()


def test_sample_copy(spark, images, datasets, labels):
    edit = mb.sample_copy(images, datasets.filter("dataset_id <= 4"), labels, 1, seed=3)
    copies = edit.changes.orderBy("image_id").collect()
    assert [r.image_id for r in copies] == [16, 17] and {r.dataset_id for r in copies} == {5}
    assert edit.images.count() == images.count() + 2
    new = edit.datasets.first()
    assert new.name.startswith("Dataset 1-") and len(new.name) == 16 and new.resolution == "512" and not new.for_testing
    # a second call with the same seed and base gives another name
    known = datasets.filter("dataset_id <= 4").unionByName(edit.datasets.select(*datasets.columns), allowMissingColumns=True)
    again = mb.sample_copy(images, known, labels, 1, seed=3).datasets.first()
    assert again.dataset_id == new.dataset_id + 1 and again.name != new.name
    # the last base of any study lacks images
    assert mb.sample_copy(images, datasets, labels, 1, seed=3).changes.count() == 0


def test_copies_are_numbered_without_gaps(spark, images, datasets, labels):
    ask = spark.createDataFrame([(1, 9, 200), (3, 9, 201), (99, 9, 202)], "dataset_id long, new_study_id long, new_dataset_id long")
    edit = mb.clone_dataset(images, datasets, labels, ask)
    ids = sorted(r.image_id for r in edit.changes.collect())
    assert ids == list(range(16, 16 + 10))
    assert [r.dataset_id for r in edit.rejected.collect()] == [99]
    assert {(r.dataset_id, r.name, r.base, r.for_testing) for r in edit.datasets.collect()} == {
        (200, "Base One_clone", False, False), (201, "Test One_clone", False, False),
    }


def test_clone_base_and_study(spark, images, datasets, labels):
    ask = spark.createDataFrame([(1, 9, 200, "copy"), (8, 9, 201, "none")], "old_study_id long, new_study_id long, new_dataset_id long, name string")
    base = mb.clone_base(images, datasets, labels, ask)
    assert base.changes.count() == 6 and base.changes.filter("used_for_training OR used_for_testing").count() == 2
    assert base.datasets.first().base and base.rejected.count() == 1
    study = mb.clone_study(images, datasets, labels, ask)
    assert study.changes.count() == 11 and study.changes.filter("used_for_training OR used_for_testing").count() == 0
    assert study.datasets.first().resolution == "224"


def clone_request(spark, *rows):
    return spark.createDataFrame(rows, "dataset_id long, new_study_id long, new_dataset_id long")


def test_clone_by_file_name(spark, images, datasets, labels):
    edit = mb.clone_testing_set(images, datasets, labels, clone_request(spark, (3, 2, 200)))
    # a.png twice among the sources but once in the base; b.png is ambiguous; none.png has no match
    assert [(r.image_id, r.new_dataset_id, r.used_for_testing) for r in edit.changes.collect()] == [(10, 200, True)]
    assert {r.image_id for r in edit.extra["ambiguous"].collect()} == {9}
    assert {r.image_id for r in edit.extra["unmatched"].collect()} == {15}
    kept_whole(images, edit.images)
    strict = mb.clone_testing_set(images, datasets, labels, clone_request(spark, (3, 2, 200)), strict=True)
    assert strict.changes.count() == 0 and strict.datasets.count() == 0


def test_clone_refusals(spark, images, datasets, labels):
    edit = mb.clone_testing_set(images, datasets, labels, clone_request(spark, (2, 2, 200), (3, 3, 201), (3, 7, 202)))
    reasons = {r.new_dataset_id: r.reason for r in edit.rejected.collect()}
    assert reasons[200] == "no such testing dataset"
    assert reasons[201] == reasons[202] == "the new study needs exactly one base dataset"
    assert edit.changes.count() == 0


def test_a_base_image_moves_once(spark, images, datasets, labels):
    ask = clone_request(spark, (3, 2, 201), (3, 2, 200))
    edit = mb.clone_testing_set(images, datasets, labels, ask)
    assert [(r.image_id, r.new_dataset_id) for r in edit.changes.collect()] == [(10, 200)]
    assert edit.images.count() == images.count()


def test_clone_training_set(spark, images, datasets, labels):
    ask = spark.createDataFrame([(2, 2, 200, 1), (2, 2, 201, 77)], "dataset_id long, new_study_id long, new_dataset_id long, base_id long")
    renamed = images.withColumn("image_path", F.when(F.col("image_id") == 1, "q/h.png").otherwise(F.col("image_path")))
    edit = mb.clone_training_set(renamed, datasets, labels, ask)
    assert [(r.image_id, r.used_for_training) for r in edit.changes.collect()] == [(1, True)]
    assert [tuple(r) for r in edit.dataset_shared.collect()] == [(200, 2)]
    assert [r.reason for r in edit.rejected.collect()] == ["no such base dataset"]


def test_suffix_mode_finds_longer_names(spark, images):
    sources = spark.createDataFrame([(1, 50, "s/a.png"), (1, 51, "s/xa.png"), (1, 52, "s/q.png")], "scope long, image_id long, image_path string")
    bases = spark.createDataFrame([(1, 60, "b/a.png"), (1, 61, "b/xa.png"), (2, 62, "b/q.png")], "scope long, image_id long, image_path string")
    plain = {r.image_id: r.matches for r in lk.match_by_filename(sources, bases, "scope").collect()}
    tail = {r.image_id: r.matches for r in lk.match_by_filename(sources, bases, "scope", "suffix").collect()}
    assert plain == {50: 1, 51: 1, 52: 0} and tail == {50: 2, 51: 1, 52: 0}


def test_plain_moves(spark, images, datasets):
    ask = spark.createDataFrame([(2, 1), (3, 1), (1, 99)], "origin_id long, target_id long")
    edit = mb.move_all(images, datasets, ask)
    assert [(r.image_id, r.old_dataset_id, r.new_dataset_id, r.used_for_training) for r in edit.changes.collect()] == [(7, 2, 1, True)]
    assert edit.rejected.count() == 2
    claimed = mb.claim_unused(images, datasets, 2)
    assert claimed.extra["count"].first()[0] == claimed.changes.count() == 8
    assert mb.claim_unused(images, datasets, 77).changes.count() == 0
    recycled = mb.recycle_on_delete(images, datasets, datasets.filter("dataset_id IN (2, 3, 5)"))
    back = recycled.changes.collect()
    assert {r.image_id for r in back} == {7, 8, 9, 14, 15} and all(r.new_dataset_id == 1 and not r.used_for_testing for r in back)


def test_split_and_batches(spark):
    images = spark.range(107).selectExpr("id AS image_id")
    split = pp.train_val_split(images, 0.2)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"training": 86, "validation": 21}
    assert split.select("image_id").distinct().count() == 107
    again = pp.train_val_split(images.repartition(13), 0.2)
    assert again.exceptAll(split.select(again.columns)).count() == 0
    steps = pp.step_counts(split, 16).first()
    assert (steps.steps, steps.val_steps) == (5, 1)
    plan = pp.batch_plan(split.filter("split = 'training'").select("image_id"), epochs=3, batch=16).collect()
    # six batches per pass, the last of six images; each epoch takes five of the endless stream
    sizes = {}
    for r in plan:
        sizes[r.epoch, r.step] = sizes.get((r.epoch, r.step), 0) + 1
    stream = [16, 16, 16, 16, 16, 6] * 3
    assert [sizes[e, s] for e in (1, 2, 3) for s in range(1, 6)] == stream[:15]
    assert pp.batch_plan(images.limit(5), 2, 16).count() == 0
    assert pp.val_batches(split, 16).count() == 16


def test_pages(spark, images):
    assert ls.page_bounds(2) == (11, 20) and ls.page_bounds(1, 500) == (1, 100)
    with pytest.raises(ValueError):
        ls.page_bounds(0)
    page = ls.paginate_all(images, 1, 2)
    rows = {(r.dataset_id, r.label_id): [] for r in page.collect()}
    for r in page.orderBy("image_id").collect():
        rows[r.dataset_id, r.label_id].append((r.image_id, r.has_next))
    assert rows[1, 1] == [(1, True), (2, True)] and rows[1, 2] == [(5, False), (6, False)]
    assert [r.image_id for r in ls.paginate(images, 2, 5).collect()] == [6, 7, 8, 9, 10]


def test_new_sets_carry_their_texts_and_labels(spark, images, datasets):
    base = datasets.filter("base").orderBy("dataset_id").first()
    label = images.filter(f"dataset_id = {base.dataset_id}").first().label_id
    requests = spark.createDataFrame(
        [(base.study_id, 900, 1, "small"), (base.study_id, 901, 10**6, "large")], "study_id long, dataset_id long, n long, name string"
    )
    links = spark.createDataFrame([(900, label), (900, label), (901, label)], "dataset_id long, label_id long")
    edit = mb.make_testing_set(images.withColumn("used_for_testing", F.lit(False)), datasets, requests, links, 7)
    rows = [(r.dataset_id, r.study_id, r["name"], r.description, r.base, r.for_testing) for r in edit.datasets.collect()]
    assert rows == [(900, base.study_id, "small", None, False, True)]
    assert [tuple(r) for r in edit.dataset_labels.collect()] == [(900, label)]
