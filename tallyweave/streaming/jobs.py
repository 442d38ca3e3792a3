"""Event-driven refreshes as Structured Streaming jobs.

Aggregations run in update mode: each micro-batch writes the changed keys to its own folder below
the shared directory, overwriting on a retry, so a repeated batch has no further effect. The
current state is the newest row of every key; what a stored state has replaced is removed.

``start_*`` return a handle at once, whatever the trigger; ``stream_*`` consume the available input and return the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tallyweave.operators.evaluation import report_cells, report_from_cells
from tallyweave.session import missing_path, scratch
from tallyweave.sources.exports import export_manifest, read_export, write_export

AVAILABLE_NOW = {"availableNow": True}
COMPACT_EVERY = 64


@dataclass(frozen=True)
class Refresh:
    """A started job: its query, and a reader of what it has stored so far."""

    query: StreamingQuery
    state: Callable[[], DataFrame]

    def finish(self) -> DataFrame:
        """The state after the query has ended; with an endless trigger that is after someone has stopped it."""
        self.query.awaitTermination()
        return self.state()

    def stop(self) -> DataFrame:
        """End the query after no further batch and return the state; another start with its checkpoint goes on."""
        self.query.stop()
        return self.state()


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], purpose: str, trigger: dict, checkpoint: str | None) -> StreamingQuery:
    spark = stream.sparkSession
    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch(spark, f"{purpose}-checkpoint"))
        .trigger(**trigger)
        .start()
    )


def _write(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def write_delta(rows: DataFrame, folder: str, keys: list[str], batch_id: int) -> None:
    """Store a batch's changed rows, and every COMPACT_EVERY batches the whole state, so reads stay short.

    After a new state the folders that the state before it had replaced are removed. The last two states and all changes
    after the older one stay, for readers that began earlier and for a repeated batch: at most twice COMPACT_EVERY folders and two.
    """
    _write(rows, f"{folder}/delta", batch_id)
    if (batch_id + 1) % COMPACT_EVERY == 0:
        spark = rows.sparkSession
        _write(latest(spark, folder, keys, batch_id), f"{folder}/base", batch_id)
        before = _newest(spark, f"{folder}/base", batch_id - 1)
        if before is not None:
            _remove(spark, f"{folder}/delta", before + 1)
            _remove(spark, f"{folder}/base", before)


def _remove(spark: SparkSession, folder: str, end: int) -> None:
    """Remove the batches below ``end``; only names are listed, and those are few, as every state does this."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(path):
        name, _, number = found.getPath().getName().partition("=")
        if name == "batch_id" and int(number) < end:
            files.delete(found.getPath(), True)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return False
    return True


def _newest(spark: SparkSession, path: str, upto: int | None = None) -> int | None:
    """The highest batch number among the folders below ``path``; only their names are looked at."""
    batches = spark.read.parquet(path).select("batch_id")
    return (batches if upto is None else batches.filter(F.col("batch_id") <= upto)).agg(F.max("batch_id")).first()[0]


def latest(spark: SparkSession, folder: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The newest row per key: the last stored state and the deltas after it (up to batch ``upto``)."""
    if upto is None:
        upto = _newest(spark, f"{folder}/delta")
    # the stored states say where they end, whatever COMPACT_EVERY was when they were written
    base_id = _newest(spark, f"{folder}/base", upto - 1) if _exists(spark, f"{folder}/base") else None
    base_id = -1 if base_id is None else base_id
    # batch ids are consecutive; only the folders after the state are read
    paths = [f"{folder}/delta/batch_id={i}" for i in range(base_id + 1, upto + 1)]
    rows = spark.read.option("basePath", f"{folder}/delta").parquet(*paths)
    if base_id >= 0:
        stored = spark.read.parquet(f"{folder}/base/batch_id={base_id}").withColumn("batch_id", F.lit(base_id))
        rows = rows.unionByName(stored)
    values = [c for c in rows.columns if c not in [*keys, "batch_id"]]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(*keys, "row.*")


def _latest_or_empty(spark: SparkSession, folder: str, keys: list[str], like: DataFrame) -> DataFrame:
    if not _exists(spark, f"{folder}/delta"):  # nothing has arrived yet
        return spark.createDataFrame([], like.schema)
    return latest(spark, folder, keys)


def _refresh(stream: DataFrame, folder: str, keys: list[str], purpose: str, trigger: dict, checkpoint: str | None) -> Refresh:
    handle = lambda batch, batch_id: write_delta(batch, folder, keys, batch_id)
    query = _start(stream, handle, purpose, trigger, checkpoint)
    return Refresh(query, lambda: _latest_or_empty(stream.sparkSession, folder, keys, stream))


def start_label_counts(
    images: DataFrame, folder: str | None = None, trigger: dict = AVAILABLE_NOW, checkpoint: str | None = None
) -> Refresh:
    """Images per (dataset, label), refreshed by every upload."""
    counts = images.filter(F.col("dataset_id").isNotNull()).groupBy("dataset_id", "label_id").agg(
        F.count(F.lit(1)).alias("image_count")
    )
    folder = folder or scratch(images.sparkSession, "label-counts")
    return _refresh(counts, folder, ["dataset_id", "label_id"], "label-counts", trigger, checkpoint)


def stream_label_counts(images: DataFrame, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """``start_label_counts`` over the input at hand."""
    return start_label_counts(images, folder, AVAILABLE_NOW, checkpoint).finish()


def start_status(
    events: DataFrame, key: str = "session_id", ts: str = "ts", tie: str = "event_id", folder: str | None = None,
    trigger: dict = AVAILABLE_NOW, checkpoint: str | None = None,
) -> Refresh:
    """The last status of every session or test, also if its events arrive out of order."""
    state = events.groupBy(key).agg(F.max_by("status", F.struct(ts, tie)).alias("status"), F.max(ts).alias("updated_at"))
    folder = folder or scratch(events.sparkSession, "status")
    return _refresh(state, folder, [key], "status", trigger, checkpoint)


def stream_status(
    events: DataFrame, key: str = "session_id", ts: str = "ts", tie: str = "event_id", folder: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """``start_status`` over the input at hand."""
    return start_status(events, key, ts, tie, folder, AVAILABLE_NOW, checkpoint).finish()


def start_test_reports(
    results: DataFrame, folder: str | None = None, trigger: dict = AVAILABLE_NOW, checkpoint: str | None = None,
    species: str | None = None, outcome: str | None = None,
) -> Refresh:
    """Reports that follow the results as they are appended.

    Macro metrics cannot be merged, so the state holds the confusion cells and each batch derives
    the reports of the tests it touched from their newest cells.
    """
    spark = results.sparkSession
    folder = folder or scratch(spark, "reports")
    keys = ["test_id", "true_label", "prediction"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        write_delta(batch, f"{folder}/cells", keys, batch_id)
        touched = session.read.parquet(f"{folder}/cells/delta/batch_id={batch_id}").select("test_id").distinct()
        cells = latest(session, f"{folder}/cells", keys, batch_id).join(touched, "test_id", "left_semi")
        write_delta(report_from_cells(cells), f"{folder}/reports", ["test_id"], batch_id)

    cells = report_cells(results, species, outcome)
    query = _start(cells, handle, "reports", trigger, checkpoint)
    return Refresh(query, lambda: _latest_or_empty(spark, f"{folder}/reports", ["test_id"], report_from_cells(cells)))


def stream_test_reports(
    results: DataFrame, folder: str | None = None, checkpoint: str | None = None, species: str | None = None, outcome: str | None = None
) -> DataFrame:
    """``start_test_reports`` over the input at hand."""
    return start_test_reports(results, folder, AVAILABLE_NOW, checkpoint, species, outcome).finish()


def start_reexport(
    changes: DataFrame,
    current: Callable[[], dict[str, DataFrame]],
    path: str | None = None,
    trigger: dict = AVAILABLE_NOW,
    checkpoint: str | None = None,
) -> Refresh:
    """Export again every dataset an uploaded or deleted image belongs to.

    ``current()`` gives the tables ``image``, ``dataset``, ``label`` and ``dataset_label`` as of now.
    Images without a dataset are ignored. A dataset's folders are replaced as a whole, so a
    repeated batch changes nothing.
    """
    spark = changes.sparkSession
    path = path or scratch(spark, "export")

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables = current()
        # bounded by the number of datasets
        touched = batch.select("dataset_id").distinct()
        manifest = export_manifest(
            tables["image"],
            tables["dataset"],
            tables["label"],
            tables["dataset_label"].join(touched, "dataset_id", "left_semi"),
        )
        write_export(manifest, path)

    query = _start(changes.filter(F.col("dataset_id").isNotNull()).select("dataset_id"), handle, "export", trigger, checkpoint)
    return Refresh(query, lambda: read_export(spark, path))


def stream_reexport(
    changes: DataFrame, current: Callable[[], dict[str, DataFrame]], path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """``start_reexport`` over the changes at hand."""
    return start_reexport(changes, current, path, AVAILABLE_NOW, checkpoint).finish()
