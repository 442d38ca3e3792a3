"""The declared constraints as one job: every breach as a (rule, entity, id) row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import (
    DATASET_RESOLUTIONS,
    MODEL_RESOLUTIONS,
    NAME_LIMIT,
    PRE_MODELS,
    PRIMARY_KEYS,
    STATUSES,
)

# Entity, foreign key, entity it must exist in.
REFERENCES = [
    ("dataset", "study_id", "study"),
    ("dataset_label", "dataset_id", "dataset"),
    ("dataset_label", "label_id", "label"),
    ("dataset_shared", "dataset_id", "dataset"),
    ("dataset_shared", "study_id", "study"),
    ("image", "dataset_id", "dataset"),
    ("image", "label_id", "label"),
    ("session", "study_id", "study"),
    ("session", "dataset_id", "dataset"),
    ("session", "model_id", "model"),
    ("epoch", "session_id", "session"),
    ("test", "dataset_id", "dataset"),
    ("test", "session_id", "session"),
    ("result", "test_id", "test"),
    ("result", "image_id", "image"),
]
CHOICES = [
    ("dataset", "resolution", DATASET_RESOLUTIONS),
    ("model", "resolution", MODEL_RESOLUTIONS),
    ("model", "pre_model", PRE_MODELS),
    ("session", "status", STATUSES),
    ("test", "status", STATUSES),
]
NAMED = ["study", "label", "dataset", "model", "session", "test"]
# Columns that must not be null, and texts besides names that keep to the limit of a name.
REQUIRED = {
    "study": ["name"],
    "label": ["name"],
    "dataset": ["name", "resolution", "base", "for_testing"],
    "image": ["image_path", "label_id", "used_for_training", "used_for_testing"],
    "model": ["name", "epochs", "batch_size", "validation_split", "resolution", "fine_tuning", "data_augmentation", "pre_model", "is_default"],
    "session": ["name", "dataset_id", "model_id", "status"],
    "epoch": ["session_id", "number", "accuracy", "loss", "val_accuracy", "val_loss"],
    "test": ["name", "dataset_id", "session_id", "status"],
    "result": ["test_id", "confidence"],
}
LIMITED = [("session", "model_path"), ("result", "true_label"), ("result", "prediction")]


def _breach(rows: DataFrame, rule: str, entity: str, key: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(entity).alias("entity"), F.col(key).cast("long").alias("id"))


def duplicated(df: DataFrame, entity: str, key: str, column: str) -> DataFrame:
    repeated = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _breach(df.join(repeated, column, "left_semi"), f"{column} not unique", entity, key)


def not_allowed(df: DataFrame, entity: str, key: str, column: str, allowed: list[str]) -> DataFrame:
    return _breach(df.filter(~F.col(column).isin(allowed)), f"unknown {column}", entity, key)


def dangling(df: DataFrame, entity: str, key: str, column: str, target: DataFrame) -> DataFrame:
    """Non-null references without a target row."""
    broken = df.filter(F.col(column).isNotNull()).join(target.select(column), column, "left_anti")
    return _breach(broken, f"dangling {column}", entity, key)


def too_long(df: DataFrame, entity: str, key: str, column: str = "name", limit: int = NAME_LIMIT) -> DataFrame:
    return _breach(df.filter(F.length(column) > limit), f"{column} too long", entity, key)


def collect(*breaches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, breaches)


def row_rules(df: DataFrame, entity: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """All rules that look at one row, in one scan; a null condition is no breach."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.lit(entity).alias("entity"), F.col(key).cast("long").alias("id"))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules whose entity and columns are among the given tables; a table is read once for all rules on its rows."""

    def has(entity: str, column: str) -> bool:
        return entity in tables and column in tables[entity].columns

    found = []
    key_of = lambda entity: PRIMARY_KEYS.get(entity, "dataset_id")
    if has("dataset", "name"):
        found.append(duplicated(tables["dataset"], "dataset", "dataset_id", "name"))
    for entity in tables:
        rules = {f"unknown {c}": ~F.col(c).isin(allowed) for e, c, allowed in CHOICES if e == entity and has(e, c)}
        rules |= {f"{c} missing": F.col(c).isNull() for c in REQUIRED.get(entity, []) if has(entity, c)}
        if entity in NAMED and has(entity, "name"):
            rules["name too long"] = F.length("name") > NAME_LIMIT
        rules |= {f"{c} too long": F.length(c) > NAME_LIMIT for e, c in LIMITED if e == entity and has(e, c)}
        if rules:
            found.append(row_rules(tables[entity], entity, key_of(entity), rules))
    for entity, column, target in REFERENCES:
        if has(entity, column) and target in tables:
            found.append(dangling(tables[entity], entity, key_of(entity), column, tables[target]))
    return collect(*found)


def validate_session_requests(
    requests: DataFrame, studies: DataFrame, datasets: DataFrame | None = None, models: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split requests into accepted and rejected-with-reason; the first rule that a request breaks is its reason.

    A study must be named and exist, and either ``hotdataset`` or ``dataset_id`` must be given (0 counts as missing).
    With ``datasets`` (dataset_id, base), a dataset that is named must exist, and ``hotdataset`` needs a base dataset
    to draw from; with ``models``, a model that is named (0 names none) must exist.
    """
    missing = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    checked, found = requests, []

    def look_up(table: DataFrame, key: str) -> Column:
        nonlocal checked
        found.append(f"_known_{key}")
        checked = checked.join(table.select(key).distinct().withColumn(found[-1], F.lit(True)), key, "left")
        return F.col(found[-1]).isNull()

    # fixed values: texts that clients show
    rules = [
        (F.col("study_id").isNull(), "study_id is required."),
        (look_up(studies, "study_id"), "study_id does not exist."),
        (missing("hotdataset") & missing("dataset_id"), "Either 'hotdataset' or 'dataset_id' must be provided."),
    ]
    if datasets is not None:
        rules.append((~missing("dataset_id") & look_up(datasets, "dataset_id"), "unknown dataset"))
        bases = datasets.agg(F.count_if("base").alias("n")).scalar()
        rules.append((~missing("hotdataset") & (bases == 0), "no base dataset to draw from"))
    if models is not None:
        rules.append((~missing("model_id") & look_up(models, "model_id"), "unknown model"))
    reason = F.coalesce(*[F.when(broken, text) for broken, text in rules])
    checked = checked.withColumn("reason", reason).drop(*found).select(*requests.columns, "reason")
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())
