"""Judging classifiers: confusion cells, macro metrics, outcome counts and the test report.

All metrics come from the (test, true label, prediction) cells. The cells are the only
aggregation that touches the result rows; it combines map-side, so a test that holds a third of
all rows still shuffles at most one row per cell and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.scalars import ratio

# Fixed value: the confidence above which an outcome counts as positive.
THRESHOLD = 0.5
# The outcome classes. "TrueNegative" repeats the predicate of "FalsePositive",
# as in the behaviour to be matched; a correct result at or below the threshold is in none.
OUTCOMES = ["TruePositive", "FalsePositive", "FalseNegative", "TrueNegative"]

COUNT_COLUMNS = {
    "TruePositive": "true_positive",
    "FalsePositive": "false_positive",
    "FalseNegative": "false_negative",
    "TrueNegative": "true_negative",
}


def outcome_predicate(outcome: str | None, threshold: float = THRESHOLD) -> Column:
    """The rows of an outcome class; ``None`` or ``All`` (or an unknown name) keeps every row."""
    same = F.col("true_label").eqNullSafe(F.col("prediction"))
    sure = F.col("confidence") > threshold
    return {
        "TruePositive": same & sure,
        "FalsePositive": ~same & sure,
        "FalseNegative": ~same & ~sure,
        "TrueNegative": ~same & sure,
    }.get(outcome or "All", F.lit(True))


def species_predicate(species: str | None) -> Column:
    return F.lit(True) if species in (None, "All") else F.col("true_label") == species


def filter_results(results: DataFrame, species: str | None = None, outcome: str | None = None) -> DataFrame:
    """Results of one true label, then of one outcome class."""
    return results.filter(species_predicate(species) & outcome_predicate(outcome))


def sparse_cells(results: DataFrame, by: str = "test_id") -> DataFrame:
    """Non-zero confusion cells: (by, true_label, prediction, n)."""
    return results.groupBy(by, "true_label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_cells(results: DataFrame, by: str = "test_id") -> DataFrame:
    """Dense cells including zeros: (by, true_label, prediction, n), over every label seen on either side.

    A null label is a label like any other, so the cells of a test add up to its results.

    The full matrix is the output itself; it is laid out from the label list of each test, which is
    bounded by its number of classes, and filled by an equality join.
    """
    cells = sparse_cells(results, by)
    # a struct keeps a null, which collect_set would leave out
    sides = cells.select(by, F.explode(F.array("true_label", "prediction")).alias("label"))
    labels = sides.groupBy(by).agg(F.collect_set(F.struct("label")).alias("labels"))
    grid = labels.select(by, "labels", F.explode("labels").alias("t")).select(by, "t", F.explode("labels").alias("p"))
    grid = grid.select(by, F.col("t.label").alias("true_label"), F.col("p.label").alias("prediction"))
    keys = [by, "true_label", "prediction"]
    found = cells.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return grid.join(found, same, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(results: DataFrame, labels: list[str], by: str | None = None) -> DataFrame:
    """Wide matrix: a row for each label of either side, a column for each of the given classes, the rest in ``other``.

    Predictions outside the list, null ones too, are counted in ``other``, so every row adds up to its label's results.
    """
    keys = [by, "true_label"] if by else ["true_label"]
    named = [by] if by else []
    zero = F.lit(0).cast("long")
    actual = results.select(*keys, "prediction", F.lit(1).cast("long").alias("_n"))
    # a label that is only predicted has an empty row
    predicted = results.select(*named, F.col("prediction").alias("true_label"), "prediction", zero.alias("_n"))
    listed = F.coalesce(F.col("prediction").isin(labels), F.lit(False))
    columns = [F.sum(F.when(F.col("prediction").eqNullSafe(c), F.col("_n")).otherwise(zero)).alias(c) for c in labels]
    other = F.sum(F.when(~listed, F.col("_n")).otherwise(zero)).alias("other")
    return actual.unionByName(predicted).groupBy(*keys).agg(*columns, other)


def label_marginals(cells: DataFrame, by: str = "test_id", carried: list[str] | None = None) -> DataFrame:
    """Per label: diagonal, row sum (actual), column sum (predicted), and the sums of ``carried`` cell columns.

    Each cell contributes one row-side and one column-side record, so no labels are paired up.
    Carried columns ride on the row side only and are therefore counted once.
    """
    zero = F.lit(0).cast("long")
    carried = carried or []

    def side(label: str, actual, predicted, diagonal, keep: bool) -> Column:
        rest = [F.when(F.lit(keep), F.col(c)).alias(c) for c in carried]
        return F.struct(
            F.col(label).alias("label"),
            actual.alias("actual"),
            predicted.alias("predicted"),
            diagonal.alias("diagonal"),
            *rest,
        )

    n = F.col("n")
    same = F.col("true_label").eqNullSafe(F.col("prediction"))
    row_side = side("true_label", n, zero, F.when(same, n).otherwise(zero), True)
    column_side = side("prediction", zero, n, zero, False)
    # cells are few per test; placed by test once, they need no further shuffle for labels, totals and macro means
    placed = cells.repartition(by)
    sides = placed.select(by, F.explode(F.array(row_side, column_side)).alias("s")).select(by, "s.*")
    return sides.groupBy(by, "label").agg(*[F.sum(c).alias(c) for c in ["actual", "predicted", "diagonal", *carried]])


def macro_metrics(marginals: DataFrame, by: str = "test_id", carried: list[str] | None = None) -> DataFrame:
    """Macro precision, recall, F1 and both specificities, plus accuracy and the label count.

    ``specificity`` keeps the denominator of the behaviour to be matched (cells whose *column* is
    another label, which makes it the negative predictive value); ``specificity_true`` is
    TN / (TN + FP). F1 is taken from the macro precision and recall; 0/0 gives NULL. A label without
    any counted result does not take part; a test without any has no row.
    """
    # a test has one marginal row per class, so this window holds no more rows than classes
    per = marginals.withColumn("total", F.sum("actual").over(Window.partitionBy(by)))
    seen = F.col("actual") + F.col("predicted") > 0
    tn = F.col("total") - F.col("actual") - F.col("predicted") + F.col("diagonal")
    mean = lambda value: F.avg(F.when(seen, value))
    macro = (
        per.groupBy(by)
        .agg(
            F.sum("actual").alias("rows"),
            F.count_if(seen).alias("labels"),
            F.sum("diagonal").alias("_correct"),
            mean(ratio(F.col("diagonal"), F.col("predicted"))).alias("precision"),
            mean(ratio(F.col("diagonal"), F.col("actual"))).alias("recall"),
            mean(ratio(tn, F.col("total") - F.col("predicted"))).alias("specificity"),
            mean(ratio(tn, F.col("total") - F.col("actual"))).alias("specificity_true"),
            *[F.sum(c).alias(c) for c in carried or []],
        )
        .filter(F.col("rows") > 0)
    )
    pr = F.col("precision") + F.col("recall")
    f1 = F.when(pr == 0, F.lit(None)).otherwise(2 * F.col("precision") * F.col("recall") / pr)
    return macro.withColumns({"accuracy": ratio(F.col("_correct"), F.col("rows")), "f1": f1}).drop("_correct")


def outcome_counts(results: DataFrame, by: str = "test_id", threshold: float = THRESHOLD) -> DataFrame:
    counts = [F.count_if(outcome_predicate(o, threshold)).alias(COUNT_COLUMNS[o]) for o in OUTCOMES]
    return results.groupBy(by).agg(*counts)


def accuracy_confidence(results: DataFrame, by: str = "test_id") -> DataFrame:
    """100 * share of correct results and 100 * mean confidence."""
    return results.groupBy(by).agg(
        (100 * F.avg(F.col("true_label").eqNullSafe(F.col("prediction")).cast("double"))).alias("accuracy"),
        (100 * F.avg("confidence")).alias("avg_confidence"),
    )


def report_cells(
    results: DataFrame, species: str | None = None, outcome: str | None = None, by: str = "test_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One mergeable row per cell: what the whole report needs from the result rows."""
    # right or wrong is a property of the cell, so two counts per cell give all outcome classes
    counted = (
        results.filter(species_predicate(species))
        .groupBy(by, "true_label", "prediction")
        .agg(
            F.count(F.lit(1)).alias("_all"),
            F.count_if(F.col("confidence") > threshold).alias("_sure"),
            F.sum(F.when(outcome_predicate(outcome, threshold), F.col("confidence"))).alias("confidence_sum"),
        )
    )
    same = F.col("true_label").eqNullSafe(F.col("prediction"))
    none = F.lit(0).cast("long")
    per_outcome = {
        "TruePositive": F.when(same, F.col("_sure")).otherwise(none),
        "FalsePositive": F.when(same, none).otherwise(F.col("_sure")),
        "FalseNegative": F.when(same, none).otherwise(F.col("_all") - F.col("_sure")),
        "TrueNegative": F.when(same, none).otherwise(F.col("_sure")),
    }
    return counted.select(
        by,
        "true_label",
        "prediction",
        per_outcome.get(outcome or "All", F.col("_all")).alias("n"),
        "confidence_sum",
        *[per_outcome[o].alias(COUNT_COLUMNS[o]) for o in OUTCOMES],
    )


def report_from_cells(cells: DataFrame, by: str = "test_id") -> DataFrame:
    """The report columns from (possibly merged) report cells; a test with no kept row has no report."""
    carried = ["confidence_sum", *COUNT_COLUMNS.values()]
    metrics = macro_metrics(label_marginals(cells, by, carried), by, carried)
    return metrics.select(
        by,
        "rows",
        "labels",
        "accuracy",
        ratio(F.col("confidence_sum"), F.col("rows")).alias("avg_confidence"),
        "precision",
        "recall",
        "f1",
        "specificity",
        "specificity_true",
        *COUNT_COLUMNS.values(),
    )


def test_report(
    results: DataFrame, species: str | None = None, outcome: str | None = None, by: str = "test_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every test's report in one job.

    The four outcome counts see the species filter only; all other figures see the species and
    the outcome filter.
    """
    return report_from_cells(report_cells(results, species, outcome, by, threshold), by)


def epoch_curves(epochs: DataFrame) -> DataFrame:
    """Long series (session_id, x, metric, split, y) for the loss and accuracy charts."""
    long = epochs.select("session_id", F.col("number").alias("x"), "accuracy", "loss", "val_accuracy", "val_loss").unpivot(
        ["session_id", "x"], ["accuracy", "loss", "val_accuracy", "val_loss"], "series", "y"
    )
    return long.select(
        "session_id",
        "x",
        F.replace("series", F.lit("val_"), F.lit("")).alias("metric"),
        F.when(F.startswith("series", F.lit("val_")), "validation").otherwise("training").alias("split"),
        "y",
    )
