"""Queries over the column functions."""

from pyspark.sql import functions as F

from tallyweave.functions import scalars as sc
from tallyweave.plans.registry import query


@query("b1_slug", "SELECT dataset_id, lower(replace(name, ' ', '_')) AS slug FROM fx_dataset")
def _(d):
    return d.fx_dataset.select("dataset_id", sc.slug("name").alias("slug"))


@query(
    "b2_image_path",
    """SELECT i.image_id, concat('datasets/', lower(replace(d.name, ' ', '_')), '-', CAST(d.dataset_id AS VARCHAR), '/',
       regexp_extract(i.image_path, '[^/]*$')) AS path
FROM fx_image i JOIN fx_dataset d ON i.dataset_id = d.dataset_id""",
)
def _(d):
    rows = d.fx_image.select("image_id", "dataset_id", "image_path").join(d.fx_dataset.select("dataset_id", "name"), "dataset_id")
    return rows.select("image_id", sc.image_path("name", "dataset_id", sc.basename("image_path")).alias("path"))


@query("b3_basename", "SELECT image_id, regexp_extract(image_path, '[^/]*$') AS file_name FROM fx_image")
def _(d):
    return d.fx_image.select("image_id", sc.basename("image_path").alias("file_name"))


@query(
    "b4_format_label",
    """SELECT dataset_id, array_to_string(list_transform(string_split(replace(lower(name), '_', ' '), ' '),
       lambda w: upper(w[1:1]) || w[2:]), ' ') AS formatted,
       array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '),
       lambda w: upper(w[1:1]) || w[2:]), ' ') AS formatted_raw FROM fx_dataset""",
)
def _(d):
    return d.fx_dataset.select(
        "dataset_id", sc.format_label(sc.slug("name")).alias("formatted"), sc.format_label("name").alias("formatted_raw")
    )


_HMS = """concat(CASE WHEN {s} // 3600 < 10 THEN '0' ELSE '' END, CAST({s} // 3600 AS VARCHAR), ':',
 lpad(CAST({s} // 60 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({s} % 60 AS VARCHAR), 2, '0'))"""


@query("b5_format_duration", f"SELECT session_id, {_HMS.format(s='(duration_s * 60)')} AS duration FROM fx_session")
def _(d):
    return d.fx_session.select("session_id", sc.format_duration(F.col("duration_s") * 60).alias("duration"))


@query(
    "b6_session_duration",
    """SELECT session_id, (epoch_us(updated_at) // 1000 - epoch_us(created_at) // 1000) / 1000.0E0 AS seconds,
       """
    + _HMS.format(s="((epoch_us(updated_at) // 1000 - epoch_us(created_at) // 1000) // 1000)")
    + " AS duration FROM fx_session_time",
)
def _(d):
    seconds = sc.session_duration("created_at", "updated_at")
    return d.fx_session_time.select("session_id", seconds.alias("seconds"), sc.format_duration(seconds).alias("duration"))


# printf rounds exact ties to even; the ties that exist in binary (odd eighths) must go up
_FIXED = "CASE WHEN {x} * 8 = floor({x} * 8) AND CAST(floor({x} * 8) AS BIGINT) % 2 = 1 THEN printf('%.2f', {x} + 0.001) ELSE printf('%.2f', {x}) END || '%'"


@query(
    "b7_pct",
    f"""WITH a AS (SELECT test_id, true_label, 100 * avg(CASE WHEN true_label = prediction THEN 1.0E0 ELSE 0.0E0 END) AS acc,
  100 * min(CASE WHEN true_label = prediction THEN 0.0E0 ELSE confidence END) AS low FROM fx_result GROUP BY ALL)
SELECT test_id, true_label, CASE WHEN acc = 0 THEN 'Calculating...' ELSE {_FIXED.format(x='acc')} END AS accuracy,
       CASE WHEN low = 0 THEN 'Calculating...' ELSE {_FIXED.format(x='low')} END AS lowest, {_FIXED.format(x='low')} AS lowest_raw FROM a""",
)
def _(d):
    same = F.col("true_label") == F.col("prediction")
    shares = d.fx_result.groupBy("test_id", "true_label").agg(
        (100 * F.avg(same.cast("double"))).alias("acc"), (100 * F.min(F.when(same, 0.0).otherwise(F.col("confidence")))).alias("low")
    )
    return shares.select(
        "test_id",
        "true_label",
        sc.pct("acc", falsy_pending=True).alias("accuracy"),
        sc.pct("low", falsy_pending=True).alias("lowest"),
        sc.pct("low").alias("lowest_raw"),
    )


@query(
    "b8_dataset_kind",
    "SELECT dataset_id, CASE WHEN base THEN 'Base' WHEN for_testing THEN 'Testing' ELSE 'Training' END AS kind FROM fx_dataset",
)
def _(d):
    return d.fx_dataset.select("dataset_id", sc.dataset_kind("base", "for_testing").alias("kind"))


@query(
    "b9_class_name_text",
    """WITH n AS (SELECT dl.dataset_id, string_agg(lower(replace(l.name, ' ', '_')), ', ' ORDER BY lower(replace(l.name, ' ', '_'))) AS class_names
  FROM fx_dataset_label dl JOIN fx_label l ON l.label_id = dl.label_id GROUP BY dl.dataset_id)
SELECT dataset_id, class_names, CAST(len(string_split(class_names, ', ')) AS INT) AS classes, string_split(class_names, ', ')[1] AS first_class FROM n""",
)
def _(d):
    from tallyweave.operators.listings import class_names

    names = class_names(d.fx_dataset_label, d.fx_label).select("dataset_id", sc.join_class_names("class_names").alias("class_names"))
    back = sc.split_class_names("class_names")
    return names.select("dataset_id", "class_names", F.size(back).alias("classes"), F.element_at(back, 1).alias("first_class"))


@query(
    "b10_one_hot",
    """SELECT image_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = class_idx THEN 1 ELSE 0 END), '') AS one_hot
FROM fx_feature""",
)
def _(d):
    return d.fx_feature.select("image_id", F.array_join(sc.one_hot("class_idx", 10), "").alias("one_hot"))
