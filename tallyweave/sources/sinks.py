"""Append-only history and result tables, and trained heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from tallyweave.functions.ranking import shuffle_key, shuffled_rank
from tallyweave.schemas import ENTITIES, PRIMARY_KEYS
from tallyweave.session import missing_path, settle

# What names a row of an append-only table besides its id.
_NATURAL = {"epoch": ["session_id", "number"], "result": ["test_id", "image_id"]}
_COMMIT = "first_id long, rows long, batch string"


def _append(rows: DataFrame, path: str, entity: str) -> None:
    spark, key, schema = rows.sparkSession, PRIMARY_KEYS[entity], ENTITIES[entity]
    if key not in rows.columns:
        try:
            top = spark.read.schema(schema).parquet(path).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
        except AnalysisException as e:
            if not missing_path(e):
                raise
            top = 0  # the table does not exist yet
        # unique but not consecutive, and needs no shuffle
        rows = rows.withColumn(key, F.monotonically_increasing_id() + F.lit(top + 1))
    missing = [f for f in schema.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("append").parquet(path)


def append_epochs(epochs: DataFrame, path: str) -> None:
    _append(epochs, path, "epoch")


def append_results(results: DataFrame, path: str) -> None:
    _append(results, path, "result")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.createDataFrame([], _COMMIT)  # nothing has been appended yet


def append_batch(rows: DataFrame, path: str, entity: str, batch: str) -> bool:
    """Append a named batch once; tells whether it was appended.

    Ids go on from the last batch without gaps, in an order that depends on the rows alone. The rows lie below
    ``rows/batch=``, and a small row below ``commits/batch=`` follows them, with the first id and their number: from then on the
    batch counts, and appending it again does nothing. A batch whose writer died before is written over, with the same ids
    if none came in between. One writer at a time numbers the ids of a table.
    """
    spark, path, key, schema = rows.sparkSession, path.rstrip("/"), PRIMARY_KEYS[entity], ENTITIES[entity]
    if not batch or not all(c.isalnum() or c in "-_" for c in batch):
        raise ValueError(f"a batch is named by letters, digits, - and _, not {batch!r}")
    commits = _commits(spark, path)
    if not commits.filter(F.col("batch") == batch).isEmpty():
        return False
    top = commits.agg(F.max(F.col("first_id") + F.col("rows") - 1)).first()[0] or 0
    given = [c for c in schema.names if c in rows.columns and c != key]
    kept = settle(rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in given]), "batch")
    hashed = shuffle_key(entity, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _NATURAL[entity]])
    ranked = shuffled_rank(kept.withColumn("_tie", F.struct(*given)), hashed, "_tie", rank=key)
    numbered = ranked.withColumn(key, F.col(key) + F.lit(top))
    whole = [(F.col(f.name) if f.name in [key, *given] else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    numbered.select(*whole).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    commit = kept.agg(F.lit(top + 1).cast("long").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    return True


def read_batches(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The rows of all batches that count, with the name of their batch."""
    path = path.rstrip("/")
    schema = StructType([*ENTITIES[entity].fields, StructField("batch", StringType())])
    done = _commits(spark, path).select("batch")
    if done.isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows").join(done, "batch", "left_semi").select(*schema.names)


def write_weights(weights: DataFrame, path: str) -> None:
    """One folder per session slug; training a session again replaces its head."""
    fields = ENTITIES["weights"].fields
    (
        weights.select(*[F.col(f.name).cast(f.dataType) for f in fields])
        .write.partitionBy("session_slug")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_weights(spark: SparkSession, path: str, session_slug: str | None = None) -> DataFrame:
    weights = spark.read.schema(ENTITIES["weights"]).parquet(path)
    return weights if session_slug is None else weights.filter(F.col("session_slug") == session_slug)
