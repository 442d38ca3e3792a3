"""Seed dumps: JSON arrays of ``{model, pk, fields}`` split into entity tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.schemas import AUGMENTATION_FLAGS, DEFAULTS, ENTITIES, PRIMARY_KEYS
from tallyweave.session import settle

# The record kinds of a dump.
KINDS = {
    "study": "feature_extractor.study",
    "label": "datasets.label",
    "dataset": "datasets.dataset",
    "image": "datasets.image",
    "model": "feature_extractor.tfmodel",
    "session": "feature_extractor.trainingsession",
    "epoch": "feature_extractor.epoch",
    "test": "feature_extractor.test",
    "result": "feature_extractor.testresult",
}
# Field names of a dump that differ from the catalog's column names.
FIELD_NAMES = {
    "study_id": "study",
    "dataset_id": "dataset",
    "label_id": "label",
    "session_id": "training_session",
    "test_id": "test",
    "model_id": "model",
    "image_id": "image",
    "image_path": "image",
    "is_default": "default",
}
# Junction tables that a dump keeps as arrays of its datasets.
LINKS = [("dataset_label", "labels", "label_id"), ("dataset_shared", "shared", "study_id")]
_TEXT = "name description notes resolution pre_model status class_names model_path grad_cam true_label prediction"
_LONG = "study dataset label training_session test model"
_INT = "epochs batch_size number"
_DOUBLE = "validation_split accuracy loss val_accuracy val_loss confidence"
_FLAG = "base for_testing used_for_training used_for_testing fine_tuning data_augmentation default " + " ".join(AUGMENTATION_FLAGS)
_STAMP = "created_at updated_at"
_FIELDS = ", ".join(
    f"`{name}`: {kind}"
    for names, kind in [
        (_TEXT, "string"), (_LONG, "bigint"), (_INT, "int"), (_DOUBLE, "double"), (_FLAG, "boolean"), (_STAMP, "timestamp"),
        # a path or an id: read as a string, Spark would open the file again for every number
        ("labels shared", "array<bigint>"), ("image", "variant"),
    ]
    for name in names.split()
)
DUMP_SCHEMA = f"model string, pk bigint, fields struct<{_FIELDS}>"


def write_fixture_json(tables: dict[str, DataFrame], path: str, per_file: int = 5000) -> None:
    """Write entities (``dataset_label`` and ``dataset_shared`` go into their datasets) as a folder of compressed dumps.

    Each file is one array of ``per_file`` records, or of the rest of a task, which holds the records of one file at a time.
    """
    written = []
    for entity, rows in tables.items():
        if entity not in KINDS:
            continue
        key = PRIMARY_KEYS[entity]
        names = [c for c in rows.columns if c != key]
        if entity == "dataset":
            for table, field, column in LINKS:
                if table in tables:
                    # bounded by the number of labels and studies
                    linked = tables[table].groupBy("dataset_id").agg(F.array_sort(F.collect_set(column)).alias(field))
                    rows, names = rows.join(linked, key, "left"), [*names, field]
        fields = F.struct(*[F.col(c).alias(FIELD_NAMES.get(c, c)) for c in names])
        record = F.struct(F.lit(KINDS[entity]).alias("model"), F.col(key).alias("pk"), fields.alias("fields"))
        written.append(rows.select(F.to_json(record).alias("record")))
    if written:
        records = reduce(DataFrame.unionByName, written)
        # a file per array, all in one folder; as text is long, it is compressed
        files = records.mapInArrow(_arrays(per_file), "value string").write.option("maxRecordsPerFile", 1)
        # tasks move their own files to the folder, where the driver would move all of them one by one; a second
        # attempt gives as many files of the same names
        files = files.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        files.option("compression", "gzip").text(path)


def _arrays(per_file: int) -> Callable:
    """Joins a task's records to JSON arrays as they come, without a shuffle."""

    def joined(records: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["[" + ",\n".join(records) + "]"], pa.string())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= per_file:
                yield joined(held[:per_file])
                held = held[per_file:]
        if held:
            yield joined(held)

    return run


def load_fixture_json(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Every entity and both junction tables of one or more dumps; columns a dump lacks take their defaults.

    The dumps are parsed once, when this is called; the tables read the stored records.
    """
    records = spark.read.schema(DUMP_SCHEMA).option("multiLine", True).json(path).filter(F.col("model").isNotNull())
    image = F.col("fields.image").cast("string")
    records = settle(records.withColumn("fields", F.col("fields").withField("image", image)), "dump-records")
    tables: dict[str, DataFrame] = {}
    for entity, kind in KINDS.items():
        key = PRIMARY_KEYS[entity]
        rows = records.filter(F.col("model") == kind)
        columns = []
        for field in ENTITIES[entity].fields:
            if field.name == key:
                columns.append(F.col("pk").alias(key))
                continue
            value = F.col("fields").getField(FIELD_NAMES.get(field.name, field.name)).cast(field.dataType)
            default = DEFAULTS.get(entity, {}).get(field.name)
            columns.append((value if default is None else F.coalesce(value, F.lit(default))).alias(field.name))
        tables[entity] = rows.select(*columns)
    datasets = records.filter(F.col("model") == KINDS["dataset"])
    for table, field, column in LINKS:
        tables[table] = datasets.select(F.col("pk").alias("dataset_id"), F.explode(f"fields.{field}").alias(column)).distinct()
    return tables
