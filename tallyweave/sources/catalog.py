"""Reading entity tables with their fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.schemas import ENTITIES, PRIMARY_KEYS

# The relational table of each entity, and columns stored under another name.
RELATIONS = {
    "study": "feature_extractor_study",
    "label": "datasets_label",
    "dataset": "datasets_dataset",
    "dataset_label": "datasets_dataset_labels",
    "dataset_shared": "datasets_dataset_shared",
    "image": "datasets_image",
    "model": "feature_extractor_tfmodel",
    "session": "feature_extractor_trainingsession",
    "epoch": "feature_extractor_epoch",
    "test": "feature_extractor_test",
    "result": "feature_extractor_testresult",
}
STORED_NAMES = {
    "image": {"image_path": "image"},
    "model": {"is_default": "default"},
    "epoch": {"session_id": "training_session_id"},
    "test": {"session_id": "training_session_id"},
}


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet with a given schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_catalog(spark: SparkSession, uri: str, entity: str, parts: int = 1, bounds: tuple[int, int] | None = None,
                 **options: str) -> DataFrame:
    """One entity from ``<folder>/<entity>`` (Parquet) or from a ``jdbc:`` URL.

    A JDBC read is split over the primary key into ``parts`` ranges when ``bounds`` gives the
    lowest and highest id, so a large table is not read through one connection.
    """
    schema = ENTITIES[entity]
    if not uri.startswith("jdbc:"):
        return read_table(spark, f"{uri.rstrip('/')}/{entity}", schema)
    reader = spark.read.format("jdbc").options(url=uri, dbtable=RELATIONS[entity], **options)
    if bounds and entity in PRIMARY_KEYS:
        reader = reader.options(
            partitionColumn="id", lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts)
        )
    return from_stored(reader.load(), entity)


def from_stored(stored: DataFrame, entity: str) -> DataFrame:
    """Rename and cast relational columns to the catalog schema."""
    names = dict(STORED_NAMES.get(entity, {}))
    if entity in PRIMARY_KEYS:
        names[PRIMARY_KEYS[entity]] = "id"
    return stored.select(
        *[F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in ENTITIES[entity].fields]
    )


def write_catalog(df: DataFrame, folder: str, entity: str) -> None:
    """Write a snapshot of one entity; a snapshot is a new folder, never an update in place."""
    fields = ENTITIES[entity].fields
    df.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{folder.rstrip('/')}/{entity}")
