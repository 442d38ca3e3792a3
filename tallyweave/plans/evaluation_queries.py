"""Queries over test results and training history."""

from pyspark.sql import functions as F

from tallyweave.operators import evaluation as ev
from tallyweave.plans.registry import query

# Shared SQL: the report over ``kept`` rows (all filters) with counts over ``base`` rows (species filter only).
_REPORT = """
cells AS (SELECT test_id, true_label AS t, prediction AS p, count(*) AS n FROM kept GROUP BY ALL),
tot AS (SELECT test_id, sum(n) AS total, sum(CASE WHEN t = p THEN n ELSE 0 END) AS correct FROM cells GROUP BY ALL),
lab AS (SELECT test_id, t AS label FROM cells UNION SELECT test_id, p FROM cells),
marg AS (
  SELECT l.test_id, l.label,
         sum(CASE WHEN c.t = l.label THEN n ELSE 0 END) AS actual,
         sum(CASE WHEN c.p = l.label THEN n ELSE 0 END) AS predicted,
         sum(CASE WHEN c.t = l.label AND c.p = l.label THEN n ELSE 0 END) AS tp,
         sum(CASE WHEN c.t <> l.label AND c.p <> l.label THEN n ELSE 0 END) AS tn,
         sum(CASE WHEN c.p <> l.label THEN n ELSE 0 END) AS not_predicted,
         sum(CASE WHEN c.t <> l.label THEN n ELSE 0 END) AS not_actual
  FROM lab l JOIN cells c ON c.test_id = l.test_id GROUP BY ALL),
macro AS (
  SELECT test_id, count(*) AS labels,
         avg(CASE WHEN predicted = 0 THEN 0 ELSE 100.0E0 * tp / predicted END) AS pr,
         avg(CASE WHEN actual = 0 THEN 0 ELSE 100.0E0 * tp / actual END) AS re,
         avg(CASE WHEN not_predicted = 0 THEN 0 ELSE 100.0E0 * tn / not_predicted END) AS sp,
         avg(CASE WHEN not_actual = 0 THEN 0 ELSE 100.0E0 * tn / not_actual END) AS spt
  FROM marg GROUP BY ALL),
conf AS (SELECT test_id, 100 * avg(confidence) AS conf FROM kept GROUP BY ALL),
counts AS (
  SELECT test_id,
         count(*) FILTER (WHERE true_label = prediction AND confidence > 0.5) AS true_positive,
         count(*) FILTER (WHERE true_label <> prediction AND confidence > 0.5) AS false_positive,
         count(*) FILTER (WHERE true_label <> prediction AND confidence <= 0.5) AS false_negative,
         count(*) FILTER (WHERE true_label <> prediction AND confidence > 0.5) AS true_negative
  FROM base GROUP BY ALL)
SELECT m.test_id, CAST(t.total AS BIGINT) AS "rows", m.labels, round(100.0E0 * t.correct / t.total, 6) AS accuracy,
       round(f.conf, 6) AS avg_confidence, round(m.pr, 6) AS "precision", round(m.re, 6) AS recall,
       round(CASE WHEN m.pr + m.re = 0 THEN NULL ELSE 2 * m.pr * m.re / (m.pr + m.re) END, 6) AS f1,
       round(m.sp, 6) AS specificity, round(m.spt, 6) AS specificity_true,
       c.true_positive, c.false_positive, c.false_negative, c.true_negative
FROM macro m JOIN tot t ON t.test_id = m.test_id JOIN conf f ON f.test_id = m.test_id
JOIN counts c ON c.test_id = m.test_id
"""


def report_sql(species: str = "TRUE", outcome: str = "TRUE", source: str = "SELECT * FROM fx_result") -> str:
    return f"""WITH base AS (SELECT * FROM ({source}) r WHERE {species}),
kept AS (SELECT * FROM base WHERE {outcome}),{_REPORT}"""


METRICS = ["accuracy", "avg_confidence", "precision", "recall", "f1", "specificity", "specificity_true"]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_POOLED = "SELECT CAST(0 AS BIGINT) AS test_id, image_id, true_label, prediction, confidence FROM fx_result"
_FP = "true_label <> prediction AND confidence > 0.5"


@query("e13_test_report", report_sql())
def _(d):
    return rounded(ev.test_report(d.fx_result), *METRICS)


@query("e13_test_report_pooled", report_sql(source=_POOLED))
def _(d):
    return rounded(ev.test_report(d.sql(_POOLED)), *METRICS)


@query("e13_test_report_species", report_sql(species="true_label = 'promo'"))
def _(d):
    return rounded(ev.test_report(d.fx_result, species="promo"), *METRICS)


@query("e13_test_report_false_positive", report_sql(outcome=_FP))
def _(d):
    return rounded(ev.test_report(d.fx_result, outcome="FalsePositive"), *METRICS)


@query(
    "c11_filter_results",
    f"SELECT * FROM fx_result WHERE true_label = 'promo' AND {_FP}",
)
def _(d):
    return ev.filter_results(d.fx_result, "promo", "FalsePositive")


@query(
    "c11_filter_results_false_negative",
    "SELECT * FROM fx_result WHERE true_label <> prediction AND confidence <= 0.5",
)
def _(d):
    return ev.filter_results(d.fx_result, "All", "FalseNegative")


_CELLS = """WITH cells AS (SELECT test_id, true_label, prediction, count(*) AS n FROM fx_result GROUP BY ALL),
lab AS (SELECT test_id, true_label AS label FROM cells UNION SELECT test_id, prediction FROM cells)
SELECT a.test_id, a.label AS true_label, b.label AS prediction, coalesce(c.n, 0) AS n
FROM lab a JOIN lab b ON a.test_id = b.test_id
LEFT JOIN cells c ON c.test_id = a.test_id AND c.true_label = a.label AND c.prediction = b.label"""


@query("e5_confusion_cells", _CELLS)
def _(d):
    return ev.confusion_cells(d.fx_result)


_CLASSES = ["economy", "large", "medium", "promo", "small", "standard"]
_LISTED = ", ".join(f"'{c}'" for c in _CLASSES)
_WIDE = (
    "SELECT test_id, true_label, "
    + ", ".join(f"CAST(sum(CASE WHEN prediction = '{c}' THEN n ELSE 0 END) AS BIGINT) AS {c}" for c in _CLASSES)
    + f", CAST(sum(CASE WHEN prediction IN ({_LISTED}) THEN 0 ELSE n END) AS BIGINT) AS other"
    + " FROM (SELECT test_id, true_label, prediction, 1 AS n FROM {results}"
    + " UNION ALL SELECT test_id, prediction, prediction, 0 FROM {results}) GROUP BY ALL"
)


@query(
    "e6_confusion_matrix",
    _WIDE.format(results="fx_result"),
)
def _(d):
    return ev.confusion_matrix(d.fx_result, _CLASSES, by="test_id")


# Some labels are null, and one class is in the results but not in the list.
_GAPS = """(SELECT test_id, CASE WHEN image_id % 7 <> 0 THEN true_label END AS true_label,
  CASE WHEN image_id % 5 <> 0 THEN CASE WHEN image_id % 3 = 0 THEN 'unlisted' ELSE prediction END END AS prediction FROM fx_result)"""


def _gaps(d):
    image = F.col("image_id")
    return d.fx_result.withColumns({
        "true_label": F.when(image % 7 != 0, F.col("true_label")),
        "prediction": F.when(image % 5 != 0, F.when(image % 3 == 0, "unlisted").otherwise(F.col("prediction"))),
    })


@query("e6_confusion_matrix_gaps", _WIDE.format(results=_GAPS))
def _(d):
    return ev.confusion_matrix(_gaps(d), _CLASSES, by="test_id")


@query(
    "e5_confusion_cells_gaps",
    f"""WITH cells AS (SELECT test_id, true_label, prediction, count(*) AS n FROM {_GAPS} GROUP BY ALL),
lab AS (SELECT test_id, true_label AS label FROM cells UNION SELECT test_id, prediction FROM cells)
SELECT a.test_id, a.label AS true_label, b.label AS prediction, coalesce(c.n, 0) AS n
FROM lab a JOIN lab b ON a.test_id = b.test_id LEFT JOIN cells c
ON c.test_id = a.test_id AND c.true_label IS NOT DISTINCT FROM a.label AND c.prediction IS NOT DISTINCT FROM b.label""",
)
def _(d):
    return ev.confusion_cells(_gaps(d))


@query(
    "e7_accuracy_confidence",
    """SELECT test_id, round(100 * avg(CASE WHEN true_label = prediction THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy,
       round(100 * avg(confidence), 6) AS avg_confidence FROM fx_result GROUP BY ALL""",
)
def _(d):
    return rounded(ev.accuracy_confidence(d.fx_result), "accuracy", "avg_confidence")


def _macro(d, *columns):
    macro = ev.macro_metrics(ev.label_marginals(ev.sparse_cells(d.fx_result)))
    return rounded(macro.select("test_id", *columns), *columns)


def _macro_sql(*columns):
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT test_id, {names} FROM ({report_sql()}) r"


@query("e8_macro_precision", _macro_sql("precision"))
def _(d):
    return _macro(d, "precision")


@query("e9_macro_recall", _macro_sql("recall"))
def _(d):
    return _macro(d, "recall")


@query("e10_macro_f1", _macro_sql("f1"))
def _(d):
    return _macro(d, "f1")


@query(
    "e11_outcome_counts", _macro_sql("true_positive", "false_positive", "false_negative", "true_negative")
)
def _(d):
    return ev.outcome_counts(d.fx_result)


@query("e12_macro_specificity", _macro_sql("specificity", "specificity_true"))
def _(d):
    return _macro(d, "specificity", "specificity_true")


@query(
    "e14_epoch_curves",
    """SELECT session_id, number AS x, 'accuracy' AS metric, 'training' AS split, round(accuracy, 6) AS y FROM fx_epoch
UNION ALL SELECT session_id, number, 'accuracy', 'validation', round(val_accuracy, 6) FROM fx_epoch
UNION ALL SELECT session_id, number, 'loss', 'training', round(loss, 6) FROM fx_epoch
UNION ALL SELECT session_id, number, 'loss', 'validation', round(val_loss, 6) FROM fx_epoch""",
)
def _(d):
    return rounded(ev.epoch_curves(d.fx_epoch), "y")
