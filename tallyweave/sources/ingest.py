"""Bulk image registration and labelled folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.ranking import id_rank
from tallyweave.functions.scalars import basename, image_path

# File endings a labelled folder accepts, whatever their case.
IMAGE_ENDINGS = ["bmp", "gif", "jpeg", "jpg", "png"]


def next_ids(rows: DataFrame, existing: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Give rows consecutive ids after the highest existing one, in the order of a unique 64-bit column."""
    highest = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).scalar()
    return id_rank(rows, order_col, rank="_rank").withColumn(id_col, F.col("_rank") + highest).drop("_rank")


def ingest_images(
    uploads: DataFrame, datasets: DataFrame, labels: DataFrame, images: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New image rows for uploads (upload_id, dataset_id, label_id, file_name), and what was refused.

    An upload belongs to the request of its (dataset, label); a request naming an unknown dataset
    or label is refused as a whole. Returns (accepted image rows, (dataset_id, label_id, files, reason)).
    """
    known_sets = datasets.select("dataset_id", F.col("name").alias("_dataset_name"))
    known_labels = labels.select("label_id", F.lit(True).alias("_known_label"))
    checked = uploads.join(known_sets, "dataset_id", "left").join(known_labels, "label_id", "left")
    fine = F.col("_dataset_name").isNotNull() & F.col("_known_label").isNotNull()
    accepted = next_ids(checked.filter(fine), images, "image_id", "upload_id").select(
        "image_id",
        "dataset_id",
        image_path("_dataset_name", "dataset_id", "file_name").alias("image_path"),
        "label_id",
        F.lit(False).alias("used_for_training"),
        F.lit(False).alias("used_for_testing"),
    )
    reason = F.when(F.col("_dataset_name").isNull(), "unknown dataset").otherwise("unknown label")
    rejected = checked.filter(~fine).groupBy("dataset_id", "label_id", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("files")
    )
    return accepted, rejected


# Fixed value: what comes before the path in a full address.
_ADDRESS = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def below(spark: SparkSession, root: str, path: str | Column) -> Column:
    """The part of a file's path below ``root``, whichever way the source writes addresses."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    start = len(re.sub(_ADDRESS, "", whole).rstrip("/")) + 2
    return F.substring(F.regexp_replace(path, _ADDRESS, ""), start, 1 << 30)


def class_of(inside: Column) -> Column:
    """The class of a file by its path below the root: the first folder, null if there is none."""
    return F.when(inside.contains("/"), F.substring_index(inside, "/", 1))


def class_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders directly below ``root``, empty ones too, in sorted order; no file is listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    # code-point order; Spark's file listing skips the hidden ones as well
    return sorted(n for n in names if not n.startswith(("_", ".")))


def _judged_files(spark: SparkSession, root: str, classes: list[str] | None, endings: list[str]) -> DataFrame:
    """Every file below ``root`` with its class (the first folder on the way to it) and the reason it is refused, if any."""
    known = class_folders(spark, root) if classes is None else sorted(classes)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    label = class_of(below(spark, root, "path"))
    # bounded by the number of class folders
    index = F.array_position(F.array(*[F.lit(n) for n in known]).cast("array<string>"), F.col("label")) - 1
    ending = F.lower(F.substring_index(basename("path"), ".", -1))
    reason = (
        F.when(F.col("label").isNull(), "not in a class folder")
        .when(F.col("class_idx") < 0, "unknown class")
        .when(~ending.isin(endings) | ~basename("path").contains("."), "ending not accepted")
    )
    return files.withColumn("label", label).withColumn("class_idx", index.cast("int")).withColumn("reason", reason)


def scan_labelled_dir(
    spark: SparkSession, root: str, classes: list[str] | None = None, endings: list[str] = IMAGE_ENDINGS
) -> DataFrame:
    """(path, label, class_idx, length) for a folder per class, files of deeper folders included.

    A file's class is the first folder below ``root``. Classes are indexed in sorted order over all folders, empty ones
    too, or over the given names (say all labels of a collection). Only file metadata is selected, so the scan
    does not read the contents. Hidden files and folders (leading ``_`` or ``.``) are no part of the collection.
    """
    judged = _judged_files(spark, root, classes, endings)
    return judged.filter(F.col("reason").isNull()).select("path", "label", "class_idx", "length")


def scan_rejects(
    spark: SparkSession, root: str, classes: list[str] | None = None, endings: list[str] = IMAGE_ENDINGS
) -> DataFrame:
    """(path, label, length, reason) of the files that ``scan_labelled_dir`` leaves out; Spark lists no file without any byte."""
    judged = _judged_files(spark, root, classes, endings)
    return judged.filter(F.col("reason").isNotNull()).select("path", "label", "length", "reason")
