"""Exporting a collection: the manifest of its archive layout, written per dataset and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyweave.functions.scalars import basename, slug
from tallyweave.session import missing_path, settle

_KEYS = ["dataset_slug", "label_slug"]


def export_manifest(images: DataFrame, datasets: DataFrame, labels: DataFrame, dataset_labels: DataFrame) -> DataFrame:
    """``<dataset slug>/<label slug>/<file name>`` with the image behind each file.

    Only labels of the dataset's label set are exported. A file name repeated within a label is
    taken once, from the image with the lowest id. A label without images keeps one row without a file.
    """
    folders = settle(
        dataset_labels.join(datasets.select("dataset_id", slug("name").alias("dataset_slug")), "dataset_id").join(
            labels.select("label_id", slug("name").alias("label_slug")), "label_id"
        ),
        "folders",
    )
    # stored: the images are read once, and what follows looks at the manifest only
    files = settle(
        images.select("image_id", "dataset_id", "label_id", "image_path")
        .join(folders, ["dataset_id", "label_id"])
        .groupBy("dataset_id", *_KEYS, basename("image_path").alias("file_name"))
        .agg(F.min(F.struct("image_id", "image_path")).alias("first"))
        .select("dataset_id", *_KEYS, "file_name", "first.*"),
        "manifest",
    )
    empty = folders.select("dataset_id", *_KEYS).distinct().join(
        files.select("dataset_id", "label_slug").distinct(), ["dataset_id", "label_slug"], "left_anti"
    )
    return files.unionByName(empty, allowMissingColumns=True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return None  # nothing exported yet


def write_export(manifest: DataFrame, path: str) -> None:
    """Replace the exported folders of every dataset in the manifest; other datasets stay as they are.

    Folders of labels that left a dataset are overwritten by a row marked ``dropped``. The rebalance
    hint lets adaptive execution split a large label over several files and merge small ones.
    """
    rows = manifest.withColumn("dropped", F.lit(False))
    earlier = _stored(manifest.sparkSession, path)
    if earlier is not None:
        gone = (
            earlier.select(*_KEYS)
            .distinct()
            .join(manifest.select("dataset_slug").distinct(), "dataset_slug", "left_semi")
            .join(manifest.select(*_KEYS).distinct(), _KEYS, "left_anti")
        )
        rows = rows.unionByName(gone.withColumn("dropped", F.lit(True)), allowMissingColumns=True)
    (
        rows.hint("rebalance", *_KEYS)
        .write.partitionBy(*_KEYS)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(~F.col("dropped")).drop("dropped")
