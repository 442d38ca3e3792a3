import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions.ranking import shuffle_key
from tallyweave.operators import head as hd
from tallyweave.operators import preparation as pp
from tallyweave.operators import training as tr

SESSION = "session_id long, name string, dataset_id long, status string, epochs int, batch_size int, validation_split double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[2.0, 0, 0, 1], [0, 2.0, 0, -1], [0, 0, 2.0, 0]])
    images, features = [], []
    for i in range(330):
        k = i % 3
        images.append((i, 7 if i < 300 else 8, k + 1))
        features.append((i, (centres[k] + rng.normal(0, 0.4, 4)).tolist()))
    return (
        spark.createDataFrame(images, "image_id long, dataset_id long, label_id long"),
        spark.createDataFrame(features, "image_id long, features array<double>"),
        spark.createDataFrame([(1, "B B"), (2, "A"), (3, "C")], "label_id long, name string"),
    )


def one(spark, *sessions):
    return spark.createDataFrame(list(sessions), SESSION)


def heads(trained):
    out = {}
    for r in trained.weights.orderBy("session_id", "class_idx").collect():
        out.setdefault(r.session_id, []).append([*r.w, r.b])
    return {s: np.array(w) for s, w in out.items()}


def history(trained):
    return {(r.session_id, r.number): r for r in trained.epochs.collect()}


def plain(tables, dataset, share):
    """(images, x, y) of the training and the validation part, by position."""
    images, features, labels = tables
    rows = images.filter(F.col("dataset_id") == dataset).join(features, "image_id").join(labels, "label_id")
    rows = rows.withColumn("key", shuffle_key(pp.SPLIT_SEED, "image_id")).collect()
    rows = sorted(rows, key=lambda r: (r.key, r.image_id))
    cut = len(rows) - math.floor(len(rows) * share)
    slugs = {"A": 0, "B B": 1, "C": 2}
    make = lambda part: (np.array([r.image_id for r in part]), np.array([r.features for r in part]), np.array([slugs[r.name] for r in part]))
    return make(rows[:cut]), make(rows[cut:])


def slow_hash(x, key):
    y = (x + key) % pp.PRIME
    return (y * y % pp.PRIME * 48271 + 12345) % pp.PRIME


def slow_epoch(session, part, w, speed, epoch, batch, lr, dropout):
    """One image and one input at a time, without numpy's help for draws, orders and gradients."""
    images, x, y = part
    n, k = len(images), len(w)
    steps, per_pass = n // batch, math.ceil(n / batch)
    stream = []
    for number in range((epoch + 1) * steps // per_pass + 1):
        draw = {int(i): slow_hash(slow_hash(slow_hash(int(i) % pp.PRIME, session), number), 17) for i in images}
        order = sorted(range(n), key=lambda j: (draw[int(images[j])], images[j]))
        stream += [[(j, draw[int(images[j])]) for j in order[s : s + batch]] for s in range(0, n, batch)]
    loss = hits = seen = 0
    for chosen in stream[epoch * steps : (epoch + 1) * steps]:
        grad = [[2e-4 * w[c][d] if d < 4 else 0.0 for d in range(5)] for c in range(k)]
        penalty = 1e-4 * sum(w[c][d] ** 2 for c in range(k) for d in range(4))
        for j, draw in chosen:
            inputs = [
                x[j][d] / (1 - dropout) if slow_hash(slow_hash(draw, (d + 1) * 104729), 31) >= dropout * pp.PRIME else 0.0 for d in range(4)
            ] + [1.0]
            z = [sum(a * b for a, b in zip(w[c], inputs)) for c in range(k)]
            e = [math.exp(v) for v in z]
            target = [0.1 / k + (0.9 if c == y[j] else 0.0) for c in range(k)]
            loss += penalty - sum(target[c] * math.log(e[c] / sum(e)) for c in range(k))
            hits += max(range(k), key=lambda c: (z[c], -c)) == y[j]
            seen += 1
            for c in range(k):
                for d in range(5):
                    grad[c][d] += (e[c] / sum(e) - target[c]) * inputs[d] / len(chosen)
        speed = [[0.9 * speed[c][d] - lr * grad[c][d] for d in range(5)] for c in range(k)]
        w = [[w[c][d] + speed[c][d] for d in range(5)] for c in range(k)]
    return w, speed, seen, loss, hits


def test_one_block_is_plain_stochastic_descent(spark, tables):
    trained = tr.train_sessions(one(spark, (3, "S", 7, "Pending", 3, 32, 0.2)), *tables, tr.Descent(lr=0.1))
    training, held = plain(tables, 7, 0.2)
    w, speed = [[0.0] * 5 for _ in range(3)], [[0.0] * 5 for _ in range(3)]
    rows = history(trained)
    assert sorted(rows) == [(3, 1), (3, 2), (3, 3)]
    for epoch in range(3):
        w, speed, seen, loss, hits = slow_epoch(3, training, w, speed, epoch, 32, 0.1, 0.2)
        row = rows[(3, epoch + 1)]
        assert math.isclose(row.loss, loss / seen, rel_tol=1e-9) and math.isclose(row.accuracy, hits / seen)
        x, y = held[1][:32], held[2][:32]  # 60 images are one whole batch
        z = x @ np.array(w)[:, :4].T + np.array(w)[:, 4]
        assert math.isclose(row.val_accuracy, (z.argmax(1) == y).mean())
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        target = np.eye(3)[y] * 0.9 + 0.1 / 3
        assert math.isclose(row.val_loss, -(target * np.log(p)).sum(1).mean() + 1e-4 * (np.array(w)[:, :4] ** 2).sum(), rel_tol=1e-9)
    assert np.allclose(heads(trained)[3], w)
    assert [tuple(r) for r in trained.updates.collect()] == [(3, "Completed", "a, b_b, c", None)]


def test_blocks_are_averaged_by_their_rows(spark, tables):
    # 240 images in blocks of 64: the third block holds 112
    trained = tr.train_sessions(one(spark, (9, "S", 7, "Pending", 2, 32, 0.2)), *tables, tr.Descent(lr=0.1, block_values=64 * 4))
    (images, x, y), _ = plain(tables, 7, 0.2)
    w, speed = np.zeros((3, 5)), np.zeros((3, 5))
    for epoch in range(2):
        parts = []
        for cut in (slice(0, 64), slice(64, 128), slice(128, 240)):
            got = slow_epoch(9, (images[cut], x[cut], y[cut]), w.tolist(), speed.tolist(), epoch, 32, 0.1, 0.2)
            parts.append(got)
        seen = np.array([p[2] for p in parts])
        w = sum(np.array(p[0]) * p[2] for p in parts) / seen.sum()
        speed = sum(np.array(p[1]) * p[2] for p in parts) / seen.sum()
        assert math.isclose(history(trained)[(9, epoch + 1)].loss, sum(p[3] for p in parts) / seen.sum(), rel_tol=1e-9)
    assert np.allclose(heads(trained)[9], w)


def test_every_image_is_drawn_over_the_epochs():
    images = np.arange(70, dtype=np.int64)
    x, y = np.ones((70, 2)), np.zeros(70, dtype=np.int64)
    seen = sum(tr.descend(1, images, y, x, np.zeros((2, 3)), np.zeros((2, 3)), e, 32, tr.Descent())[2] for e in range(3))
    assert seen == 2 * 70  # two batches an epoch, passes of three: six batches are two passes


def test_dropout_leaves_out_its_share():
    draws = tr.input_draw(tr.place_draw(4, np.arange(2000, dtype=np.int64), 1), 64)
    dropped = draws < 0.2 * pp.PRIME
    assert abs(dropped.mean() - 0.2) < 0.005
    assert np.abs(dropped.mean(axis=0) - 0.2).max() < 0.05
    assert np.abs(np.corrcoef(dropped[:, :16].T) - np.eye(16)).max() < 0.12


def test_sessions_do_not_disturb_each_other(spark, tables):
    images, features, labels = tables
    sessions = one(
        spark, (1, "One", 7, "Pending", 1, 32, 0.2), (2, "Two", 7, "Pending", 4, 16, 0.1), (3, "Done", 7, "Completed", 4, 16, 0.1),
        (4, "Small", 8, "Pending", 2, 64, 0.2), (5, "No images", 9, "Pending", 2, 8, 0.2), (6, "No settings", 7, "Pending", None, 8, 0.2),
        (7, "No validation", 8, "Pending", 2, 8, 0.0), (8, "No dataset", None, "Pending", 2, 8, 0.2),
    )
    trained = tr.train_sessions(sessions, images, features, labels)
    status = {r.session_id: (r.status, r.reason) for r in trained.updates.collect()}
    assert status == {
        1: ("Completed", None), 2: ("Completed", None), 4: ("Failed", "fewer training images than a batch"), 5: ("Failed", "dataset has no images"),
        6: ("Failed", "settings are missing or out of range"), 7: ("Completed", None), 8: ("Failed", "dataset has no images"),
    }
    rows = history(trained)
    assert sorted(rows) == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (7, 1), (7, 2)]
    assert rows[(7, 1)].val_loss is None and rows[(2, 4)].val_loss is not None
    alone = tr.train_sessions(sessions.filter("session_id = 2"), images, features, labels)
    assert np.allclose(heads(trained)[2], heads(alone)[2])
    assert {r.session_slug for r in trained.weights.collect()} == {"one", "two", "no_validation"}


def test_images_that_cannot_be_learned_fail_their_session_only(spark, tables):
    images, features, labels = tables
    # datasets 10 to 16 copy dataset 8, whose images are 300 to 329; in each, something is wrong with image 310, or 310 and on
    wrong = {
        10: None, 11: "image has no features", 12: "image has no label", 13: "features differ in length", 14: "features are not finite",
        15: "features are not finite", 16: "head does not stay finite",
    }
    copies, vectors = [], []
    for dataset, fault in wrong.items():
        for r in images.filter("dataset_id = 8").join(features, "image_id").collect():
            new, spoiled = dataset * 1000 + r.image_id, r.image_id == 310
            copies.append((new, dataset, None if spoiled and dataset == 12 else r.label_id))
            if spoiled and dataset in (13, 14, 15):
                vectors.append((new, {13: [1.0], 14: [float("nan")] * 4, 15: [None] * 4}[dataset]))
            elif dataset == 16 and r.image_id >= 310:
                vectors.append((new, [1.7e308] * 4))
            elif not (spoiled and dataset == 11):
                vectors.append((new, r.features))
    images = spark.createDataFrame(copies, images.schema)
    features = spark.createDataFrame(vectors, features.schema)
    sessions = one(spark, *[(d, f"S {d}", d, "Pending", 1, 8, 0.2) for d in wrong])
    trained = tr.train_sessions(sessions, images, features, labels)
    assert {r.session_id: r.reason for r in trained.updates.collect()} == wrong
    assert set(heads(trained)) == {10}


def test_training_learns_and_scores(spark, tables):
    images, features, labels = tables
    sessions = one(spark, (1, "One", 7, "Pending", 8, 16, 0.2))
    trained = tr.train_sessions(sessions, images, features, labels, tr.Descent(lr=0.05, block_values=256))
    assert history(trained)[(1, 8)].val_accuracy > 0.95
    named = images.join(labels, "label_id").filter("dataset_id = 7").join(features, "image_id").withColumn("session_id", F.lit(1).cast("long"))
    scored = hd.score(named, trained.weights)
    assert scored.filter("prediction = replace(lower(name), ' ', '_')").count() > 285


def test_nothing_to_train(spark, tables):
    trained = tr.train_sessions(one(spark, (1, "One", 7, "Completed", 1, 16, 0.2)), *tables)
    assert trained.weights.count() == trained.epochs.count() == trained.updates.count() == 0


def test_sessions_that_share_a_block_take_the_steps_each_takes_alone():
    rng = np.random.default_rng(3)
    images, y, x = np.arange(70, dtype=np.int64) * 3, rng.integers(0, 3, 70), rng.normal(size=(70, 5))
    w, speed, sessions = rng.normal(size=(4, 3, 6)), rng.normal(size=(4, 3, 6)), np.array([1, 9, 2**40, 77], np.int64)
    together = tr.descend_many(sessions, images, y, x, w, speed, 1, 16, tr.Descent())
    for k, session in enumerate(sessions.tolist()):
        alone = tr.descend(session, images, y, x, w[k], speed[k], 1, 16, tr.Descent())
        for a, b in zip(together, alone, strict=True):
            assert np.allclose(a if np.ndim(a) == 0 else a[k], b, rtol=1e-12)


@pytest.mark.parametrize("dropout", [0.0, 1e-9, 0.2, 0.999999])
def test_inputs_are_kept_by_the_same_draws(dropout):
    places = np.concatenate([np.arange(40), pp.PRIME - 1 - np.arange(40), np.arange(3, pp.PRIME, 9_999_991)]).astype(np.int64)
    expected = tr.input_draw(places, 3000) >= dropout * pp.PRIME
    assert (tr._kept(places, 3000, dropout) == expected).all()


def test_a_task_gives_one_row_for_all_blocks_of_a_session():
    import pyarrow as pa

    rng, blocks, sessions = np.random.default_rng(3), 6, list(range(40))
    one = {"sessions": sessions, "part": "training", "batch_size": 8, "classes": 2, "w": [0.0] * 240, "speed": [0.0] * 240}
    rows = [one | {"images": list(range(b * 20, b * 20 + 20)), "class_idx": [0, 1] * 10, "x": rng.normal(size=40).tolist()} for b in range(blocks)]
    out = list(tr._block_pass(0, tr.Descent())([pa.RecordBatch.from_pylist(rows)]))
    assert sorted(r["session_id"] for b in out for r in b.to_pylist()) == sessions
    assert {r["n"] for b in out for r in b.to_pylist()} == {blocks * 16}


@pytest.mark.parametrize("width", [3, 64, 130])
def test_a_table_of_draws_keeps_the_same_inputs(width):
    draws = tr._Draws(width, 0.2)
    draws._tabulate(end=9)  # only the rows of the first remainders
    longest = pp.PRIME // tr.INPUT_STEP
    places = np.array([r + tr.INPUT_STEP * q for r in range(9) for q in (0, 1, 62, 63, 64, 5000, longest - width, longest - 1, longest)])
    places = places[places < pp.PRIME].reshape(-1, 3)
    for some in (draws, tr._Draws(width, 0.2)):
        assert (np.unpackbits(some.bits(places), axis=-1, bitorder="little")[..., :width] == tr._kept(places, width, 0.2)).all()


def test_a_worker_makes_the_table_once_it_has_drawn_as_much(monkeypatch):
    made = []
    monkeypatch.setattr(tr._Draws, "_tabulate", lambda self: made.append(self.drawn))
    draws = tr._Draws(64, 0.2, least=64 * 100)
    for _ in range(3):
        draws.bits(np.arange(40).reshape(4, 10))
    assert made == [64 * 120]


def test_blocks_that_travel_together_are_trained_apart():
    import pyarrow as pa

    rng, sessions = np.random.default_rng(3), [4, 9]
    base = {"sessions": sessions, "part": "training", "batch_size": 8, "classes": 2, "w": [0.0] * 12, "speed": [0.0] * 12}
    rows = [
        {"images": list(range(b * 50, b * 50 + 20)), "class_idx": [0, 1] * 10, "block": [b] * 20, "x": rng.normal(size=40).tolist()} for b in range(3)
    ]
    bundle = base | {name: [v for row in rows for v in row[name]] for name in rows[0]}
    apart, together = (
        {r["session_id"]: r for b in tr._block_pass(0, tr.Descent())([pa.RecordBatch.from_pylist(given)]) for r in b.to_pylist()}
        for given in ([base | row for row in rows], [bundle])
    )
    for session in sessions:
        assert together[session]["n"] == apart[session]["n"] == 3 * 16
        assert np.allclose(together[session]["w"], apart[session]["w"], rtol=1e-12)
        assert math.isclose(together[session]["loss"], apart[session]["loss"], rel_tol=1e-12)


def test_bundles_and_groups_of_sessions_change_nothing(spark, tables, monkeypatch):
    sessions = one(spark, *[(s, f"S {s}", 7, "Pending", 2, 8, 0.2) for s in range(1, 6)])
    how = tr.Descent(lr=0.1, block_values=16 * 4)  # 15 blocks of 16 images
    plain = heads(tr.train_sessions(sessions, *tables, how))
    monkeypatch.setattr(tr, "BUNDLE_VALUES", 16 * 4 * 2)
    monkeypatch.setattr(tr, "PARTS", 3)
    monkeypatch.setattr(tr, "TOGETHER", 2)
    dealt = heads(tr.train_sessions(sessions, *tables, how))
    assert sorted(plain) == sorted(dealt) == [1, 2, 3, 4, 5]
    assert all(np.allclose(plain[s], dealt[s], rtol=1e-10) for s in plain)
