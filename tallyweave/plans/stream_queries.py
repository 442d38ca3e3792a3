"""Streaming queries: each consumes a table as a file stream and returns the final state.

Those ``in_batches`` take one of several parts a batch; half of the rows arrive after a first run has ended, and a second
run goes on from its checkpoint.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.plans.evaluation_queries import METRICS, report_sql, rounded
from tallyweave.plans.registry import query
from tallyweave.session import scratch
from tallyweave.streaming import jobs

#: Batches of a run, and rows of a file: a batch takes as many files as its rows need.
BATCHES = 2
FILE_ROWS = 1 << 20


def arriving(d, table: str, run: Callable[..., DataFrame], view: str) -> DataFrame:
    """The state that ``run`` leaves after both halves of ``table`` have arrived."""
    rows, inbox, folder, checkpoint = d.table(table), *(scratch(d.spark, f"{table}-{use}") for use in ("inbox", "state", "checkpoint"))
    half = F.pmod(F.hash(*rows.columns), F.lit(2))
    each = max(1, -(-rows.count() // (2 * BATCHES * FILE_ROWS)))
    state = None
    for n in (0, 1):
        rows.filter(half == n).repartition(BATCHES * each).write.mode("append").parquet(inbox)
        stream = d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(inbox)
        state = run(d.sql(f"SELECT * FROM {view}", **{table: stream}), folder=folder, checkpoint=checkpoint)
    return state


_COUNTS = "SELECT dataset_id, label_id, count(*) AS image_count FROM fx_image WHERE dataset_id IS NOT NULL GROUP BY ALL"
_STATUS = "SELECT session_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM fx_status_event GROUP BY ALL"


@query("s1_stream_label_counts", _COUNTS)
def _(d):
    return jobs.stream_label_counts(d.sql("SELECT * FROM fx_image", orders=d.stream("orders")))


@query("s1_label_counts_in_batches", _COUNTS)
def _(d):
    return arriving(d, "orders", jobs.stream_label_counts, "fx_image")


@query("s2_stream_status", _STATUS)
def _(d):
    return jobs.stream_status(d.sql("SELECT * FROM fx_status_event", events=d.stream("events")))


@query("s2_status_in_batches", _STATUS)
def _(d):
    return arriving(d, "events", jobs.stream_status, "fx_status_event")


@query("s3_stream_test_reports", report_sql())
def _(d):
    return rounded(jobs.stream_test_reports(d.sql("SELECT * FROM fx_result", lineitem=d.stream("lineitem"))), *METRICS)


@query("s3_test_reports_in_batches", report_sql())
def _(d):
    return rounded(arriving(d, "lineitem", jobs.stream_test_reports, "fx_result"), *METRICS)


@query(
    "s4_stream_reexport",
    """WITH pairs AS (SELECT dl.dataset_id, dl.label_id, lower(replace(d.name, ' ', '_')) AS dataset_slug, lower(replace(l.name, ' ', '_')) AS label_slug
  FROM fx_dataset_label dl JOIN fx_dataset d ON d.dataset_id = dl.dataset_id JOIN fx_label l ON l.label_id = dl.label_id
  WHERE dl.dataset_id IN (SELECT dataset_id FROM fx_image WHERE dataset_id IS NOT NULL)),
files AS (SELECT p.dataset_id, p.label_slug, regexp_extract(i.image_path, '[^/]*$') AS file_name, min(i.image_id) AS image_id
  FROM fx_image i JOIN pairs p ON p.dataset_id = i.dataset_id AND p.label_id = i.label_id GROUP BY ALL)
SELECT p.dataset_id, p.dataset_slug, p.label_slug, f.file_name, f.image_id, i.image_path
FROM (SELECT DISTINCT dataset_id, dataset_slug, label_slug FROM pairs) p
LEFT JOIN files f ON f.dataset_id = p.dataset_id AND f.label_slug = p.label_slug LEFT JOIN fx_image i ON i.image_id = f.image_id""",
)
def _(d):
    tables = {"image": d.fx_image, "dataset": d.fx_dataset, "label": d.fx_label, "dataset_label": d.fx_dataset_label}
    return jobs.stream_reexport(d.sql("SELECT * FROM fx_image", orders=d.stream("orders")), lambda: tables)
