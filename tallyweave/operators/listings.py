"""Label counts, ordered listings, pages and first/last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scalars import slug
from tallyweave.schemas import MAX_PAGE_SIZE, PAGE_SIZE
from tallyweave.sources import page_index


def label_counts(labels: DataFrame, images: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Images per label, zero-filled; within one dataset when given."""
    kept = images if dataset_id is None else images.filter(F.col("dataset_id") == dataset_id)
    counts = kept.groupBy("label_id").agg(F.count(F.lit(1)).alias("image_count"))
    return labels.join(counts, "label_id", "left").select(
        "label_id", "name", F.coalesce("image_count", F.lit(0)).alias("image_count")
    )


def label_counts_by_dataset(dataset_labels: DataFrame, labels: DataFrame, images: DataFrame) -> DataFrame:
    """The same for the labels of every dataset at once."""
    counts = images.groupBy("dataset_id", "label_id").agg(F.count(F.lit(1)).alias("image_count"))
    return (
        dataset_labels.join(labels, "label_id")
        .join(counts, ["dataset_id", "label_id"], "left")
        .select("dataset_id", "label_id", "name", F.coalesce("image_count", F.lit(0)).alias("image_count"))
    )


def eligibility(bases: DataFrame, dataset_labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels of each base dataset (dataset_id, n) with at least n images, where the whole dataset has n too.

    The dataset total counts every image, also of labels outside the dataset's label set.
    """
    per_label = images.groupBy("dataset_id", "label_id").agg(F.count(F.lit(1)).alias("available"))
    totals = per_label.groupBy("dataset_id").agg(F.sum("available").alias("total"))
    enough = totals.join(bases.select("dataset_id", "n"), "dataset_id").filter(F.col("total") >= F.col("n"))
    return (
        per_label.join(enough, "dataset_id")
        .filter(F.col("available") >= F.col("n"))
        .join(dataset_labels, ["dataset_id", "label_id"], "left_semi")
        .select("dataset_id", "label_id", "n", "available", "total")
    )


def label_union(datasets: DataFrame, dataset_labels: DataFrame) -> DataFrame:
    """Distinct labels over all datasets of each study."""
    return dataset_labels.join(datasets.select("dataset_id", "study_id"), "dataset_id").select("study_id", "label_id").distinct()


def class_names(dataset_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """Sorted distinct label slugs per dataset; the array position is the class index."""
    named = dataset_labels.join(labels.select("label_id", slug("name").alias("slug")), "label_id")
    # bounded by the number of labels
    return named.groupBy("dataset_id").agg(F.array_sort(F.collect_set("slug")).alias("class_names"))


def oldest_first(df: DataFrame, id_col: str) -> DataFrame:
    """Ascending creation time; the id breaks ties so that the order is total."""
    return df.orderBy(F.col("created_at").asc_nulls_last(), id_col)


def page_bounds(page: int, size: int = PAGE_SIZE) -> tuple[int, int]:
    """First and last rank of a 1-based page; a size above the maximum is cut to it."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    size = min(size, MAX_PAGE_SIZE)
    return (page - 1) * size + 1, page * size


_LISTING = ["dataset_id", "label_id"]


def _listed(images: DataFrame) -> DataFrame:
    return images.filter(F.col("dataset_id").isNotNull() & F.col("label_id").isNotNull())


def listing_index(images: DataFrame, range_rows: int = page_index.RANGE_ROWS) -> DataFrame:
    """The order-statistic index of every (dataset, label) listing; store it once per snapshot with ``write_index``."""
    return page_index.build_index(_listed(images), "image_id", _LISTING, range_rows)


def paginate_all(images: DataFrame, page: int, size: int = PAGE_SIZE, index: DataFrame | None = None) -> DataFrame:
    """That page of every (dataset, label) listing at once, ordered by id, with ``has_next``.

    ``index`` is a stored ``listing_index`` of the same images; without it one is made.
    """
    first, last = page_bounds(page, size)
    index = listing_index(images) if index is None else index
    rows = page_index.slice_all(_listed(images), index, "image_id", _LISTING, first, last, "position", "total")
    return rows.withColumn("has_next", F.col("total") > last)


def paginate(images: DataFrame, page: int, size: int = PAGE_SIZE, index: DataFrame | None = None) -> DataFrame:
    """One page of an already filtered listing, by rank, so that a deep page costs no more than the first.

    ``index`` is the part of a stored index that is about this listing; without it one is made.
    """
    first, last = page_bounds(page, size)
    index = page_index.build_index(images, "image_id") if index is None else index
    return page_index.slice_one(images, index, "image_id", first, last)


def _edge(df: DataFrame, id_col: str, by: list[str], condition: Column | None, pick) -> DataFrame:
    kept = df if condition is None else df.filter(condition)
    rest = [c for c in df.columns if c not in by]
    picked = kept.groupBy(*by).agg(pick(F.struct(*rest), F.col(id_col)).alias("row"))
    return picked.filter(F.col("row").isNotNull()).select(*by, "row.*")


def first_by_pk(df: DataFrame, id_col: str, by: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """The row with the lowest key, per group when ``by`` is given; no sort is involved."""
    return _edge(df, id_col, by or [], condition, F.min_by)


def last_by_pk(df: DataFrame, id_col: str, by: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    return _edge(df, id_col, by or [], condition, F.max_by)


def latest_training_dataset(datasets: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Per study the newest dataset that is neither base nor testing, as (study_id, dataset_id)."""
    kept = datasets.filter(~F.col("base") & ~F.col("for_testing"))
    if exclude is not None:
        kept = kept.join(exclude.select("dataset_id"), "dataset_id", "left_anti")
    # a missing creation time sorts as oldest
    order = F.struct(F.col("created_at").isNotNull(), F.col("created_at"), F.col("dataset_id"))
    return kept.groupBy("study_id").agg(F.max_by("dataset_id", order).alias("dataset_id"))
