"""Queries over tables whose changes are merged when they are read."""

from pyspark.sql import functions as F

from tallyweave.operators import membership as mb
from tallyweave.operators import records as rc
from tallyweave.plans.membership_queries import _MOVE_REQUESTS, _ORDER, SEED, images
from tallyweave.plans.registry import query
from tallyweave.session import scratch, settle
from tallyweave.sources import overlay

# Random moves from the bases, then whole sets back to the bases; the first state is read after the second was compacted.
_STATES = f"""WITH r AS ({_MOVE_REQUESTS}),
c AS (SELECT dataset_id, label_id, count(*) AS available FROM fx_image GROUP BY ALL),
t AS (SELECT dataset_id, sum(available) AS total FROM c GROUP BY ALL),
pool AS (SELECT i.image_id, r.target_id, r.n, row_number() OVER (PARTITION BY i.dataset_id, i.label_id ORDER BY {_ORDER.format(a='i')}) AS rk
  FROM fx_image i JOIN r ON r.dataset_id = i.dataset_id JOIN c ON c.dataset_id = i.dataset_id AND c.label_id = i.label_id
  JOIN t ON t.dataset_id = i.dataset_id JOIN fx_dataset_label dl ON dl.dataset_id = i.dataset_id AND dl.label_id = i.label_id
  WHERE c.available >= r.n AND t.total >= r.n),
one AS (SELECT i.image_id, i.image_path, coalesce(p.target_id, i.dataset_id) AS dataset_id, i.used_for_training OR p.image_id IS NOT NULL AS used_for_training,
  i.used_for_testing FROM fx_image i LEFT JOIN pool p ON p.image_id = i.image_id AND p.rk <= p.n)
SELECT 1 AS batch, image_id, image_path, CAST(dataset_id AS BIGINT) AS dataset_id, used_for_training, used_for_testing FROM one
UNION ALL SELECT 2, image_id, image_path, CAST(CASE WHEN dataset_id % 10 = 2 THEN dataset_id - 1 ELSE dataset_id END AS BIGINT), used_for_training, used_for_testing FROM one"""


@query("g4_g10_merged_on_read", _STATES)
def _(d):
    path = scratch(d.spark, "image-table")
    overlay.create_table(images(d), path, "image", buckets=8)
    now = overlay.read_current(d.spark, path, "image")
    drawn = mb.move_random(now, d.fx_dataset_label, settle(d.sql(_MOVE_REQUESTS), "requests"), SEED)
    overlay.write_changes(d.spark, path, "image", 1, overlay.moved_rows(drawn.changes))
    requests = d.sql("SELECT dataset_id AS origin_id, study_id * 10 + 1 AS target_id FROM fx_dataset WHERE NOT base")
    back = mb.move_all(overlay.read_current(d.spark, path, "image"), d.fx_dataset, requests)
    overlay.write_changes(d.spark, path, "image", 2, overlay.moved_rows(back.changes))
    overlay.compact(d.spark, path, "image")
    states = [overlay.read_current(d.spark, path, "image", as_of=n).withColumn("batch", F.lit(n)) for n in (1, 2)]
    return states[0].unionByName(states[1]).select(
        "batch", "image_id", "image_path", "dataset_id", "used_for_training", "used_for_testing"
    )


# The last status of each week of events is a batch, the second is followed by a compaction; then failed sessions are deleted,
# and those with an even id are made again, with a name only. Events of sessions the table does not know make new rows.
@query(
    "g15_g16_merged_on_read",
    """WITH last AS (SELECT session_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM fx_status_event GROUP BY ALL),
now AS (SELECT coalesce(s.session_id, l.session_id) AS session_id, s.name, CAST(s.dataset_id AS BIGINT) AS dataset_id, coalesce(l.status, s.status) AS status,
  l.updated_at FROM fx_session s FULL OUTER JOIN last l ON l.session_id = s.session_id)
SELECT * FROM now WHERE status <> 'Failed' UNION ALL
SELECT session_id, concat('again ', session_id), NULL, NULL, NULL FROM now WHERE status = 'Failed' AND session_id % 2 = 0""",
)
def _(d):
    path = scratch(d.spark, "session-table")
    overlay.create_table(d.fx_session, path, "session", buckets=8)
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) + 1
    events = settle(d.fx_status_event.withColumn("week", F.when(F.month("ts") == 1, week).otherwise(4)), "events")
    for n in range(1, 5):
        updates = rc.last_status(events.filter(F.col("week") == n), "session_id", tie="event_id")
        overlay.write_changes(d.spark, path, "session", n, updates)
        if n == 2:
            overlay.compact(d.spark, path, "session")
    failed = settle(overlay.read_current(d.spark, path, "session").filter("status = 'Failed'"), "failed")
    overlay.write_changes(d.spark, path, "session", 5, gone=failed)
    again = failed.filter("session_id % 2 = 0").select("session_id", F.concat(F.lit("again "), F.col("session_id").cast("string")).alias("name"))
    overlay.write_changes(d.spark, path, "session", 6, again)
    now = overlay.read_current(d.spark, path, "session")
    return now.select("session_id", "name", "dataset_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
