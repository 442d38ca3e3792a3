"""Equality filters, visibility rules and search over the catalog.

Predicates stay plain column comparisons so that they reach the Parquet scan. Study-level rules
take a ``studies`` table (one ``study_id`` per requested study), so one job answers for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows equal to every given value; an absent (``None``) value does not filter."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def sessions_by_status(sessions: DataFrame, status: str | None = None) -> DataFrame:
    return equals(sessions, status=status)


def images_by(images: DataFrame, dataset_id: int | None = None, label_id: int | None = None) -> DataFrame:
    return equals(images, dataset_id=dataset_id, label_id=label_id)


def labels_of_dataset(labels: DataFrame, dataset_labels: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Labels through the junction; without ``dataset_id`` every (dataset, label) pair."""
    return equals(dataset_labels, dataset_id=dataset_id).join(labels, "label_id").select("dataset_id", "label_id", "name")


def epochs_of_session(epochs: DataFrame, session_id: int | None = None) -> DataFrame:
    return equals(epochs, session_id=session_id)


def results_of_test(results: DataFrame, test_id: int | None = None) -> DataFrame:
    return equals(results, test_id=test_id)


def get_by_id(entity: DataFrame, key: str, value: int) -> DataFrame:
    """Primary-key lookup; an unknown id gives no row."""
    return entity.filter(F.col(key) == value)


def unused_images(images: DataFrame) -> DataFrame:
    """Neither flag set."""
    return images.filter(~F.col("used_for_training") & ~F.col("used_for_testing"))


def _dataset_columns(datasets: DataFrame) -> DataFrame:
    """Rename the owner so that ``study_id`` can name the asking study."""
    return datasets.withColumnRenamed("study_id", "owner_id")


def visible_datasets(datasets: DataFrame, shared: DataFrame, studies: DataFrame) -> DataFrame:
    """Datasets a study owns or has been given, one row per (study, dataset)."""
    owned = datasets.select("dataset_id", "study_id")
    grants = owned.unionByName(shared.select("dataset_id", "study_id")).join(studies, "study_id", "left_semi").distinct()
    return grants.join(_dataset_columns(datasets), "dataset_id")


def _shared_datasets(datasets: DataFrame, shared: DataFrame, studies: DataFrame, keep: Column) -> DataFrame:
    grants = shared.select("dataset_id", "study_id").join(studies, "study_id", "left_semi").distinct()
    return grants.join(_dataset_columns(datasets.filter(keep)), "dataset_id")


def trainable_datasets(datasets: DataFrame, shared: DataFrame, studies: DataFrame) -> DataFrame:
    """Shared with the study, neither testing nor base; owning a dataset is not enough."""
    return _shared_datasets(datasets, shared, studies, ~F.col("for_testing") & ~F.col("base"))


def testable_datasets(datasets: DataFrame, shared: DataFrame, studies: DataFrame) -> DataFrame:
    return _shared_datasets(datasets, shared, studies, F.col("for_testing"))


def sessions_of_study(sessions: DataFrame, study_id: int | None = None) -> DataFrame:
    """No study selected means all sessions."""
    return equals(sessions, study_id=study_id)


def tests_of_study(tests: DataFrame, sessions: DataFrame, study_id: int | None = None) -> DataFrame:
    """Tests belong to the study of their session."""
    if study_id is None:
        return tests
    return tests.join(sessions_of_study(sessions, study_id).select("session_id"), "session_id", "left_semi")


def has_base(datasets: DataFrame, shared: DataFrame, studies: DataFrame) -> DataFrame:
    """Per study: is any visible dataset a base dataset?"""
    seen = visible_datasets(datasets, shared, studies).groupBy("study_id").agg(F.bool_or("base").alias("has_base"))
    return studies.select("study_id").distinct().join(seen, "study_id", "left").na.fill(False, ["has_base"])


def search(entity: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Case-insensitive search: every whitespace-separated term must occur in one of the columns."""
    for term in text.split():
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(column)), F.lit(term.lower())), F.lit(False))
        entity = entity.filter(hit)
    return entity


def facet(entity: DataFrame, column: str, value) -> DataFrame:
    return entity.filter(F.col(column) == value)
