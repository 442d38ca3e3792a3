"""Record keeping: junction replacement, cascading deletes, status updates and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import PRIMARY_KEYS
from tallyweave.session import settle

# Fixed values: (child, foreign key, parent) in dependency order; deleting the parent deletes the child.
CASCADES = [
    ("dataset", "study_id", "study"),
    ("session", "study_id", "study"),
    ("session", "dataset_id", "dataset"),
    ("session", "model_id", "model"),
    ("image", "label_id", "label"),
    ("epoch", "session_id", "session"),
    ("test", "dataset_id", "dataset"),
    ("test", "session_id", "session"),
    ("result", "test_id", "test"),
    ("result", "image_id", "image"),
]
JUNCTIONS = [
    ("dataset_label", "dataset_id", "dataset"),
    ("dataset_label", "label_id", "label"),
    ("dataset_shared", "dataset_id", "dataset"),
    ("dataset_shared", "study_id", "study"),
]
# Deleting the parent empties the reference and keeps the child.
NULLED = [("image", "dataset_id", "dataset")]
ORDER = ["study", "label", "model", "dataset", "session", "image", "epoch", "test", "result"]


def set_links(links: DataFrame, owners: DataFrame, new_links: DataFrame) -> DataFrame:
    """Replace all junction rows of ``owners`` (dataset_id) by ``new_links``; others stay."""
    ids = owners.select("dataset_id").distinct()
    fresh = new_links.join(ids, "dataset_id", "left_semi").distinct()
    return links.join(ids, "dataset_id", "left_anti").unionByName(fresh)


set_labels = set_links
set_shared = set_links


def cascade_delete(tables: dict[str, DataFrame], entity: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of one entity (``ids`` holds its key) and apply the delete rules to all dependants."""
    doomed: dict[str, DataFrame] = {entity: settle(ids.select(PRIMARY_KEYS[entity]).distinct(), "doomed")}
    for child in ORDER:
        if child == entity or child not in tables:
            continue
        key = PRIMARY_KEYS[child]
        parts = [
            tables[child].join(doomed[parent], fk, "left_semi").select(key)
            for kid, fk, parent in CASCADES
            if kid == child and parent in doomed and fk in tables[child].columns
        ]
        if parts:
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            # stored: the next entities build on it, and its size decides how they are joined
            doomed[child] = settle(merged.distinct(), "doomed")
    left = {
        name: df.join(doomed[name], PRIMARY_KEYS[name], "left_anti") if name in doomed else df for name, df in tables.items()
    }
    for child, fk, parent in JUNCTIONS:
        if child in left and parent in doomed:
            left[child] = left[child].join(doomed[parent], fk, "left_anti")
    for child, fk, parent in NULLED:
        if child in left and parent in doomed:
            gone = doomed[parent].withColumn("_gone", F.lit(True))
            columns = left[child].columns
            kept = F.when(F.col("_gone").isNull(), F.col(fk))
            left[child] = left[child].join(gone, fk, "left").withColumn(fk, kept).select(*columns)
    return left


def last_status(updates: DataFrame, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The last status per key and when it was set; combines map-side, so a chatty key costs one row per task."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return updates.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(ts).alias("updated_at"))


def apply_status(table: DataFrame, updates: DataFrame, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Table rows with their last status; ``updated_at`` moves along, rows without an update stay."""
    latest = last_status(updates, key, ts, tie).select(key, F.struct("status", "updated_at").alias("_last"))
    before = F.col("updated_at") if "updated_at" in table.columns else F.lit(None)
    return (
        table.join(latest, key, "left")
        .withColumns(
            {
                "status": F.coalesce("_last.status", "status"),
                "updated_at": F.coalesce(F.col("_last.updated_at"), before),
            }
        )
        .drop("_last")
    )


def upsert(table: DataFrame, rows: DataFrame, key: str, now: Column) -> DataFrame:
    """Create or update by key (one row per key in ``rows``).

    Columns absent from ``rows``, and nulls in it, leave the stored value. ``created_at`` is kept
    once set; ``updated_at`` becomes ``now`` for every touched row.
    """
    given = [c for c in rows.columns if c != key and c in table.columns]
    incoming = rows.select(key, F.struct(F.lit(True).alias("_hit"), *given).alias("_new"))
    touched = F.col("_new").isNotNull()
    columns = []
    for name in table.columns:
        if name == key:
            columns.append(F.col(key))
            continue
        value = F.coalesce(F.col(f"_new.{name}"), F.col(name)) if name in given else F.col(name)
        if name == "created_at":
            value = F.coalesce(F.col(name), F.when(touched, now))
        elif name == "updated_at":
            value = F.when(touched, now).otherwise(F.col(name))
        columns.append(value.alias(name))
    return table.join(incoming, key, "full_outer").select(*columns)
