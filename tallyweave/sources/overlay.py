"""Entity tables that take change sets without being rewritten: changes are merged when the table is read.

A table folder holds three parts, all Parquet:

- ``base/version=v/bucket=b``: whole rows, spread over buckets by a hash of the key; a version holds the buckets it rewrote;
- ``layout/version=v``: (bucket, buckets, through, rows) of those buckets, written after them. A version counts from then on,
  so a compaction that dies half-way leaves nothing that anyone reads;
- ``changes/batch=n``: changed rows only, with the names of the columns they set.

Batches are numbered by their one writer, in order. Writing a batch again replaces it by itself, and does nothing once it
has been compacted. Reading costs a scan of the base and a join with the changes since the last compaction, which Spark
broadcasts while they are small.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.schemas import ENTITIES, PRIMARY_KEYS
from tallyweave.session import missing_path, settle

#: Buckets of a new table; only their names reach the driver.
BUCKETS = 64

_LAYOUT = "bucket int, buckets int, through long, rows long, version int"


def _stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return None


def _entity(df: DataFrame, entity: str) -> DataFrame:
    """All columns of the entity; those that are absent are null."""
    fields = ENTITIES[entity].fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_version(rows: DataFrame, held: DataFrame, path: str, entity: str, version: int, buckets: int, through: int) -> None:
    """``held`` lists the buckets of this version, also those that have no row any more."""
    spark, folder = rows.sparkSession, f"{path}/base/version={version}"
    spread = rows.withColumn("bucket", _bucket(PRIMARY_KEYS[entity], buckets))
    # a bucket goes to few files; adaptive execution cuts one that is large
    spread.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
    written = spark.read.schema("bucket int").parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    layout = held.join(written, "bucket", "left").select(
        "bucket", F.lit(buckets).alias("buckets"), F.lit(through).cast("long").alias("through"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows")
    )
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout/version={version}")


def create_table(df: DataFrame, path: str, entity: str, buckets: int = BUCKETS) -> None:
    """Write the first version of a table; keys are unique and not null."""
    spark = df.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _write_version(_entity(df, entity), every, path.rstrip("/"), entity, 0, buckets, 0)


def _layout(spark: SparkSession, path: str, as_of: int | None = None) -> list:
    """The current version of every bucket: one row per bucket, a fixed number."""
    layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout")
    if as_of is not None:
        layout = layout.filter(F.col("through") <= as_of)
    return layout.groupBy("bucket").agg(F.max(F.struct("version", "buckets", "through", "rows")).alias("at")).select("bucket", "at.*").collect()


def _base(spark: SparkSession, path: str, entity: str, layout: list) -> DataFrame:
    folders = [f"{path}/base/version={r.version}/bucket={r.bucket}" for r in layout if r.rows]
    if not folders:
        return spark.createDataFrame([], ENTITIES[entity])
    return spark.read.schema(ENTITIES[entity]).parquet(*folders)


def _through(layout: list) -> int:
    """The last batch inside the base: a compaction takes all buckets that any change so far touches."""
    return max((r.through for r in layout), default=0)


def _change_schema(entity: str) -> StructType:
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTITIES[entity].fields)
    return f"{own}, _set array<string>, _gone boolean, batch long"


def write_changes(
    spark: SparkSession, path: str, entity: str, batch: int, rows: DataFrame | None = None, gone: DataFrame | None = None
) -> bool:
    """Store one batch: ``rows`` to be set, ``gone`` keys to be deleted; tells whether it was written.

    The columns of ``rows`` that the entity has are set, nulls included; its other columns keep their value. A key the table
    does not know becomes a row. A key in both ``rows`` and ``gone`` of one batch is an error when the table is read, and so are two
    rows for one key.
    """
    path, key = path.rstrip("/"), PRIMARY_KEYS[entity]
    if batch <= _through(_layout(spark, path)):
        return False
    parts = []
    if rows is not None:
        given = [f.name for f in ENTITIES[entity].fields if f.name in rows.columns and f.name != key]
        parts.append(_entity(rows, entity).withColumns({"_set": F.array(*[F.lit(c) for c in given]).cast("array<string>"), "_gone": F.lit(False)}))
    if gone is not None:
        parts.append(_entity(gone.select(key), entity).withColumns({"_set": F.array().cast("array<string>"), "_gone": F.lit(True)}))
    if not parts:
        raise ValueError("a batch has rows to set or keys to delete")
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    whole.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
    return True


def moved_rows(changes: DataFrame) -> DataFrame:
    """What the changes of a move set in the image table."""
    return changes.select("image_id", F.col("new_dataset_id").alias("dataset_id"), "used_for_training", "used_for_testing")


def pending_changes(spark: SparkSession, path: str, entity: str, after: int, as_of: int | None = None) -> DataFrame:
    """One row per key with its changes of the batches after ``after``: for each column its last value and whether it was set.

    ``_gone`` says that the row was deleted since, so its stored values no longer count; ``_alive`` that it is there now.
    """
    key = PRIMARY_KEYS[entity]
    found = _stored(spark, f"{path.rstrip('/')}/changes", _change_schema(entity))
    if found is None:
        found = spark.createDataFrame([], _change_schema(entity))
    found = found.filter(F.col("batch") > after)
    if as_of is not None:
        found = found.filter(F.col("batch") <= as_of)
    # a key has at most one row a batch
    own = Window.partitionBy(key)
    twice = F.raise_error(F.concat(F.lit("more than one change in a batch for key "), F.col(key).cast("string")))
    found = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "batch")))
    found = found.withColumn("batch", F.when(F.col("_n") > 1, twice.cast("long")).otherwise(F.col("batch")))
    found = found.withColumn("_end", F.max(F.when(F.col("_gone"), F.col("batch"))).over(own))
    valid = F.col("_end").isNull() | (F.col("batch") > F.col("_end"))
    columns = [f.name for f in ENTITIES[entity].fields if f.name != key]
    at = {c: F.when(valid & F.array_contains("_set", c), F.col("batch")) for c in columns}
    return found.groupBy(key).agg(
        F.bool_or("_gone").alias("_gone"), F.bool_or(valid & ~F.col("_gone")).alias("_alive"),
        F.struct(*[F.max_by(c, at[c]).alias(c) for c in columns]).alias("_value"),
        F.struct(*[(F.max(at[c]).isNotNull()).alias(c) for c in columns]).alias("_known"),
    )


def merged(base: DataFrame, changes: DataFrame, entity: str) -> DataFrame:
    """The rows of ``base`` with ``changes`` (of ``pending_changes``, stored) on top, and rows for keys that ``base`` lacks.

    The base is not shuffled while the changes are small: it is joined with them once for the values, and once more, by its
    keys alone, to find out which changes are new rows.
    """
    key = PRIMARY_KEYS[entity]
    columns = [f.name for f in ENTITIES[entity].fields if f.name != key]
    joined = base.join(changes, key, "left").filter(F.coalesce("_alive", F.lit(True)))
    keep = ~F.coalesce("_gone", F.lit(False))
    updated = joined.select(
        key,
        *[F.when(F.coalesce(f"_known.{c}", F.lit(False)), F.col(f"_value.{c}")).when(keep, F.col(c)).alias(c) for c in columns],
    )
    there = base.select(key).join(changes.select(key), key, "left_semi")
    new = changes.filter("_alive").join(there, key, "left_anti").select(key, "_value.*")
    order = [f.name for f in ENTITIES[entity].fields]
    return updated.select(*order).unionByName(new.select(*order))


def read_current(spark: SparkSession, path: str, entity: str, as_of: int | None = None) -> DataFrame:
    """The table as it is now, or as it was after the batch ``as_of``, as long as that is not older than the first version."""
    path = path.rstrip("/")
    layout = _layout(spark, path, as_of)
    changes = settle(pending_changes(spark, path, entity, _through(layout), as_of), "pending-changes")
    return merged(_base(spark, path, entity, layout), changes, entity)


def compact(spark: SparkSession, path: str, entity: str) -> list[int]:
    """Rewrite the buckets that changes since the last compaction touch; returns their numbers.

    Earlier versions and batches stay, so that readers who have begun, and reads of earlier states, find their files.
    """
    path, key = path.rstrip("/"), PRIMARY_KEYS[entity]
    layout = _layout(spark, path)
    done, buckets = _through(layout), layout[0].buckets
    found = _stored(spark, f"{path}/changes", "batch long")
    last = found.filter(F.col("batch") > done).agg(F.max("batch")).first()[0] if found is not None else None
    if last is None:
        return []
    changes = settle(pending_changes(spark, path, entity, done, last), "pending-changes")
    touched = settle(changes.select(_bucket(key, buckets).alias("bucket")).distinct(), "touched-buckets")
    numbers = sorted(r.bucket for r in touched.collect())  # at most one row a bucket
    base = _base(spark, path, entity, [r for r in layout if r.bucket in set(numbers)])
    version = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").agg(F.max("version")).first()[0] + 1
    _write_version(merged(base, changes, entity), touched, path, entity, version, buckets, last)
    return numbers
