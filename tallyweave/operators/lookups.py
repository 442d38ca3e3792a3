"""Nested documents and key lookups.

One-to-many sides are aggregated to their key before joining, so no join fans out. Join
strategies are left to adaptive execution, which broadcasts by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.prefixes import prefixes_of
from tallyweave.functions.scalars import basename
from tallyweave.schemas import BACKBONES, DEFAULT_PIXELS


def _nest(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key), F.struct(*[F.col(c) for c in df.columns]).alias(name))


def session_documents(
    sessions: DataFrame, studies: DataFrame, datasets: DataFrame, models: DataFrame, epochs: DataFrame
) -> DataFrame:
    """Session with nested study (may be missing), dataset, model and its epochs in order."""
    # epochs of one session are bounded by the model row's epoch count
    history = epochs.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "accuracy", "loss", "val_accuracy", "val_loss"))).alias("epochs")
    )
    empty = F.array().cast(history.schema["epochs"].dataType)
    return (
        sessions.join(_nest(studies, "study_id", "study"), "study_id", "left")
        .join(_nest(datasets, "dataset_id", "dataset"), "dataset_id", "left")
        .join(_nest(models, "model_id", "model"), "model_id", "left")
        .join(history, "session_id", "left")
        .withColumn("epochs", F.coalesce("epochs", empty))
    )


def test_documents(tests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Test with its whole session document nested."""
    return tests.join(_nest(sessions, "session_id", "training_session"), "session_id")


def result_documents(
    results: DataFrame, tests: DataFrame, sessions: DataFrame, images: DataFrame, datasets: DataFrame, labels: DataFrame
) -> DataFrame:
    """Result expanded two levels: test -> (dataset, session), image -> (dataset, label). The image may be missing."""
    dataset = _nest(datasets, "dataset_id", "dataset")
    test = tests.join(dataset, "dataset_id").join(_nest(sessions, "session_id", "training_session"), "session_id")
    image = images.join(dataset, "dataset_id", "left").join(_nest(labels, "label_id", "label"), "label_id", "left")
    return results.join(_nest(test, "test_id", "test"), "test_id").join(_nest(image, "image_id", "image"), "image_id", "left")


def dataset_documents(datasets: DataFrame, dataset_labels: DataFrame, shared: DataFrame) -> DataFrame:
    """Dataset with sorted arrays of label ids and of study ids it is shared with."""
    # both arrays are bounded by the number of labels and studies, not by images
    labels = dataset_labels.groupBy("dataset_id").agg(F.array_sort(F.collect_set("label_id")).alias("labels"))
    studies = shared.groupBy("dataset_id").agg(F.array_sort(F.collect_set("study_id")).alias("shared"))
    nothing = {
        "labels": F.array().cast(labels.schema["labels"].dataType),
        "shared": F.array().cast(studies.schema["shared"].dataType),
    }
    return (
        datasets.join(labels, "dataset_id", "left")
        .join(studies, "dataset_id", "left")
        .withColumns({c: F.coalesce(c, empty) for c, empty in nothing.items()})
    )


def flatten_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The junction tables back from dataset documents: (dataset, label) and (dataset, study)."""
    return (
        documents.select("dataset_id", F.explode("labels").alias("label_id")),
        documents.select("dataset_id", F.explode("shared").alias("study_id")),
    )


def match_by_filename(sources: DataFrame, base_images: DataFrame, scope: str, mode: str = "basename") -> DataFrame:
    """For every source image, how many base images of its scope carry its file name, and the first of them.

    ``sources`` has (scope, image_id, image_path) and so has ``base_images``. In ``suffix`` mode a base
    path matches when it *ends with* the source's file name. A file name holds no slash, so such a
    match lies inside the base file name: names are reversed and met in one sorted pass (see
    ``prefixes_of``), whose rows are at most the names and the distinct names asked for. An empty file name
    matches nothing then. Neither mode forms pairs: the base side has one row per name when it meets the sources.

    Returns (scope, image_id, file_name, matches, base_image_id); no match gives 0 and a null id.
    """
    wanted = sources.select(scope, "image_id", basename("image_path").alias("file_name"))
    # copies of a name collapse here, before anything is expanded or joined
    named = base_images.groupBy(scope, basename("image_path").alias("file_name")).agg(
        F.count(F.lit(1)).alias("matches"), F.min("image_id").alias("base_image_id")
    )
    if mode == "basename":
        candidates = named
    elif mode == "suffix":
        # read backwards, a suffix is a prefix; "found" holds every asked name that ends the base name
        backwards = named.withColumn("_backwards", F.reverse("file_name")).drop("file_name")
        asked = wanted.select(scope, F.reverse("file_name").alias("_asked"))
        candidates = (
            prefixes_of(backwards, asked, [scope], "_backwards", "_asked", "_found")
            # names that answer the same questions are added up first, then each question gets its share
            .groupBy(scope, "_found")
            .agg(F.sum("matches").alias("matches"), F.min("base_image_id").alias("base_image_id"))
            .withColumn("_asked", F.explode("_found"))
            .groupBy(scope, F.reverse("_asked").alias("file_name"))
            .agg(F.sum("matches").alias("matches"), F.min("base_image_id").alias("base_image_id"))
        )
    else:
        raise ValueError(f"unknown match mode {mode!r}")
    return wanted.join(candidates, [scope, "file_name"], "left").select(
        scope, "image_id", "file_name", F.coalesce("matches", F.lit(0)).alias("matches"), "base_image_id"
    )


def exclude_used(base: DataFrame, used: DataFrame) -> DataFrame:
    """Base images whose id is not in the used set, per label."""
    return base.join(used.select("image_id", "label_id"), ["image_id", "label_id"], "left_anti")


def backbone_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BACKBONES, "pre_model string, handle string, pixels int")


def backbone_lookup(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """Handle and input size of each model's backbone; an unlisted size is the default."""
    joined = models.join(catalog, "pre_model", "left")
    return joined.withColumn("pixels", F.coalesce("pixels", F.lit(DEFAULT_PIXELS)))


def resolve_model(requests: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill a missing (null or 0) model id with the first default model; returns (resolved, rejected).

    A request is rejected if it names a model that does not exist, or none while there is no default.
    """
    default = models.filter("is_default").agg(F.min("model_id").alias("model_id")).scalar()
    asked = F.when(F.col("model_id") != 0, F.col("model_id"))
    filled = requests.withColumn("model_id", F.coalesce(asked, default))
    known = models.select("model_id").distinct().withColumn("_known", F.lit(True))
    joined = filled.join(known, "model_id", "left").select(*requests.columns, "_known")
    reason = F.when(F.col("model_id").isNull(), "no model named and no default model").otherwise("unknown model")
    rejected = joined.filter(F.col("_known").isNull()).withColumn("reason", reason).drop("_known")
    return joined.filter("_known").drop("_known"), rejected
