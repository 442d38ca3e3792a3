import math

import pytest

from tallyweave.operators import evaluation as ev
from tallyweave.plans.domain import Domain

# 3 true labels (a, b, c) and one label that is only ever predicted (z)
RESULTS = [
    (1, "a", "a", 0.9), (1, "a", "a", 0.5), (1, "a", "b", 0.51), (1, "b", "b", 0.6), (1, "b", "a", 0.5),
    (1, "b", "z", 0.2), (1, "c", "a", 0.7), (1, "c", "a", 0.3), (2, "a", "b", 0.8), (2, "b", "a", 0.1),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(RESULTS, "test_id int, true_label string, prediction string, confidence double")


def by_hand(rows):
    """The metrics from a full matrix, as a plain loop."""
    labels = sorted({r[1] for r in rows} | {r[2] for r in rows})
    m = {(t, p): sum(1 for r in rows if (r[1], r[2]) == (t, p)) for t in labels for p in labels}
    pct = lambda a, b: 0 if b == 0 else 100 * a / b
    mean = lambda values: sum(values) / len(labels)
    pr = mean([pct(m[x, x], sum(m[t, x] for t in labels)) for x in labels])
    re = mean([pct(m[x, x], sum(m[x, p] for p in labels)) for x in labels])
    rest = lambda x: sum(m[t, p] for t in labels for p in labels if t != x and p != x)
    sp = mean([pct(rest(x), sum(m[t, p] for t in labels for p in labels if p != x)) for x in labels])
    st = mean([pct(rest(x), sum(m[t, p] for t in labels for p in labels if t != x)) for x in labels])
    return pr, re, (2 * pr * re / (pr + re) if pr + re else None), sp, st


def report(df, **kw):
    return {r.test_id: r for r in ev.test_report(df, **kw).collect()}


def test_report_by_hand(results):
    for test_id, got in report(results).items():
        rows = [r for r in RESULTS if r[0] == test_id]
        pr, re, f1, sp, st = by_hand(rows)
        assert got.rows == len(rows)
        assert math.isclose(got.accuracy, 100 * sum(r[1] == r[2] for r in rows) / len(rows))
        assert math.isclose(got.avg_confidence, 100 * sum(r[3] for r in rows) / len(rows))
        assert math.isclose(got.precision, pr) and math.isclose(got.recall, re)
        assert got.f1 is None if f1 is None else math.isclose(got.f1, f1)
        assert math.isclose(got.specificity, sp) and math.isclose(got.specificity_true, st)


def test_outcomes_at_the_threshold(results):
    got = {r.test_id: r for r in ev.outcome_counts(results).collect()}[1]
    # the correct result at exactly 0.5 is in no class; FP and TN share their predicate
    assert (got.true_positive, got.false_positive, got.false_negative, got.true_negative) == (2, 2, 3, 2)


def test_counts_ignore_the_outcome_filter(results):
    got = report(results, outcome="FalseNegative")
    assert got[1].rows == 3 and got[1].true_positive == 2
    assert got[1].f1 is None and got[1].precision == 0
    pr, re, _, sp, st = by_hand([r for r in RESULTS if r[0] == 1 and r[1] != r[2] and r[3] <= 0.5])
    assert math.isclose(got[1].specificity, sp) and math.isclose(got[1].specificity_true, st)


def test_nothing_left_means_no_report(results):
    assert report(results, species="none") == {}
    assert set(report(results, species="c", outcome="TruePositive")) == set()
    assert set(report(results, species="All", outcome="All")) == {1, 2}


def test_label_only_in_filtered_rows_does_not_count(results):
    # z appears only in a row that the outcome filter removes
    assert report(results, outcome="TruePositive")[1].labels == 2


def test_dense_cells(results):
    cells = {(r.test_id, r.true_label, r.prediction): r.n for r in ev.confusion_cells(results).collect()}
    assert len(cells) == 16 + 4
    assert sum(cells.values()) == len(RESULTS)
    assert cells[1, "z", "a"] == 0 and cells[1, "b", "z"] == 1
    wide = {r.true_label: r for r in ev.confusion_matrix(results.filter("test_id = 1"), ["a", "b", "z"]).collect()}
    assert (wide["b"]["a"], wide["b"]["b"], wide["b"]["z"]) == (1, 1, 1)


def test_cells_and_matrix_keep_every_result(spark):
    rows = [(1, None, "a"), (1, "a", None), (1, "a", "x"), (1, "a", "a"), (1, None, None)]
    gaps = spark.createDataFrame(rows, "test_id int, true_label string, prediction string")
    assert ev.confusion_cells(gaps).agg({"n": "sum"}).first()[0] == 5 and ev.confusion_cells(gaps).count() == 9
    wide = {r.true_label: (r.a, r.other) for r in ev.confusion_matrix(gaps, ["a"]).collect()}
    assert wide == {"a": (1, 2), None: (1, 1), "x": (0, 0)}


def test_missing_labels_compare_equal(spark):
    rows = spark.createDataFrame([(1, None, None, 0.9), (1, "a", None, 0.9)], "test_id int, true_label string, prediction string, confidence double")
    got = report(rows)[1]
    assert got.true_positive == 1 and got.false_positive == 1 and got.accuracy == 50.0


def test_partitioning_does_not_matter(results):
    base = {k: tuple(v) for k, v in report(results).items()}
    for n in (1, 7, 64):
        again = report(results.repartition(n))
        for k, row in again.items():
            assert all(a == b or math.isclose(a, b) for a, b in zip(row, base[k]) if a is not None)


def test_golden_report(spark):
    """Known figures of the test tables (FIXTURES.md, section 5)."""
    d = Domain(spark, "/root/testdata/sf0.01")
    expect = {
        (None, None): (659, 6, 76.479514, 50.051593, 76.603649, 76.632972, 76.618308, 95.302397, 95.301190, 243, 66, 89),
        ("promo", None): (106, 2, 72.641509, 48.056604, 50.0, 36.320755, 42.076503, 50.0, 36.320755, 31, 14, 15),
        (None, "FalsePositive"): (66, 6, 0.0, 76.151515, 0.0, 0.0, None, 79.769946, 79.768907, 243, 66, 89),
    }
    for (species, outcome), figures in expect.items():
        r = report(d.fx_result.filter("test_id = 0"), species=species, outcome=outcome)[0]
        got = (r.rows, r.labels, r.accuracy, r.avg_confidence, r.precision, r.recall, r.f1, r.specificity, r.specificity_true,
               r.true_positive, r.false_positive, r.false_negative)
        assert r.true_negative == r.false_positive
        for a, b in zip(got, figures):
            assert a is b if b is None else abs(a - b) < 1e-6


def test_epoch_curves(spark, rows):
    epochs = spark.createDataFrame([(1, 3, 0.5, 1.5, 0.4, 1.6)], "session_id int, number int, accuracy double, loss double, val_accuracy double, val_loss double")
    assert rows(ev.epoch_curves(epochs), "metric", "split", "x", "y") == [
        ("accuracy", "training", 3, 0.5), ("accuracy", "validation", 3, 0.4), ("loss", "training", 3, 1.5), ("loss", "validation", 3, 1.6),
    ]
