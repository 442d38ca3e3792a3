"""Queries over the catalog: reads, filters, joins, counts, listings and quality rules."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import filters as fl
from tallyweave.operators import listings as ls
from tallyweave.operators import lookups as lk
from tallyweave.operators import quality
from tallyweave.plans.registry import query
from tallyweave.schemas import BACKBONES, DEFAULTS, ENTITIES, PRE_MODELS, STATUSES
from tallyweave.session import scratch
from tallyweave.sources import catalog, exports, ingest, page_index, seeds, sinks


def studies(d):
    return d.region.select(F.col("r_regionkey").alias("study_id"), F.col("r_name").alias("name"))


_IMAGE = "image_id, label_id, dataset_id, image_path, used_for_training, used_for_testing"

# ---- sources ----


@query("a1_read_catalog", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(d):
    # the reader applies a fixed schema; here the schema of the event table stands in for an entity
    return catalog.read_table(d.spark, d.path("events"), d.events.schema)


def entity_rows(d, entity: str, rows: DataFrame) -> DataFrame:
    """A view of the test domain as an entity of the catalog: its defaults, then null, where the view has no such column."""
    filled = {f.name: F.lit(DEFAULTS.get(entity, {}).get(f.name)) for f in ENTITIES[entity].fields}
    return rows.select(*[
        (F.col(name) if name in rows.columns else value).cast(ENTITIES[entity][name].dataType).alias(name) for name, value in filled.items()
    ])


@query(
    "a1_read_catalog_images",
    f"SELECT {_IMAGE}, created_at::VARCHAR AS created_at FROM (SELECT CAST(label_id AS BIGINT) AS label_id, CAST(dataset_id AS BIGINT) AS dataset_id, "
    "* EXCLUDE (label_id, dataset_id) FROM fx_image) x",
)
def _(d):
    folder = scratch(d.spark, "catalog")
    for entity, rows in (("image", d.fx_image), ("dataset", d.fx_dataset)):
        catalog.write_catalog(entity_rows(d, entity, rows), folder, entity)
    stored = catalog.read_catalog(d.spark, folder, "image")
    return stored.select(*_IMAGE.split(", "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# A dump of images, collections with their label sets, and results, written as arrays of a thousand records and loaded again.
_DUMPED = ("image", "dataset", "label", "result")


def _loaded(d) -> dict[str, DataFrame]:
    folder = scratch(d.spark, "dump")
    tables = {e: entity_rows(d, e, getattr(d, f"fx_{e}")) for e in _DUMPED if e != "result"}
    tables["result"] = entity_rows(d, "result", d.fx_result.withColumn("result_id", F.xxhash64("test_id", "image_id")))
    seeds.write_fixture_json({**tables, "dataset_label": d.fx_dataset_label}, folder, per_file=1000)
    return seeds.load_fixture_json(d.spark, folder)


@query(
    "a2_load_dump",
    """SELECT 'image' AS kind, count(*) AS n, CAST(sum(image_id) AS BIGINT) AS ids, CAST(sum(length(image_path)) AS BIGINT) AS figure FROM fx_image
UNION ALL SELECT 'dataset', count(*), CAST(sum(dataset_id) AS BIGINT), CAST(sum(length(name)) AS BIGINT) FROM fx_dataset
UNION ALL SELECT 'label', count(*), CAST(sum(label_id) AS BIGINT), CAST(sum(length(name)) AS BIGINT) FROM fx_label
UNION ALL SELECT 'dataset_label', count(*), CAST(sum(dataset_id) AS BIGINT), CAST(sum(label_id) AS BIGINT) FROM fx_dataset_label
UNION ALL SELECT 'result', count(*), CAST(sum(image_id) AS BIGINT), CAST(sum(test_id) AS BIGINT) FROM fx_result""",
)
def _(d):
    tables = _loaded(d)
    figures = [
        ("image", "image_id", F.length("image_path")), ("dataset", "dataset_id", F.length("name")), ("label", "label_id", F.length("name")),
        ("dataset_label", "dataset_id", F.col("label_id")), ("result", "image_id", F.col("test_id")),
    ]
    return reduce(DataFrame.unionByName, [
        tables[kind].agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("ids"), F.sum(value).cast("long").alias("figure"))
        .select(F.lit(kind).alias("kind"), "n", "ids", "figure")
        for kind, key, value in figures
    ])


@query(
    "a2_load_dump_images",
    "SELECT image_id, CAST(dataset_id AS BIGINT) AS dataset_id, CAST(label_id AS BIGINT) AS label_id, image_path, used_for_training, used_for_testing FROM fx_image",
)
def _(d):
    return _loaded(d)["image"].select(*_IMAGE.split(", "))


# Each image id becomes a line of a file in <dataset>/<label>; one folder holds notes only, one more note lies beside the folders.
def _labelled_folder(d) -> str:
    root = scratch(d.spark, "labelled")
    placed = d.fx_image.filter("dataset_id IS NOT NULL").select("image_id", "dataset_id", "label_id")
    placed.write.partitionBy("dataset_id", "label_id").option("extension", "png").csv(root)
    ids = d.fx_image.select(F.col("image_id").cast("string"))
    ids.write.text(f"{root}/a class of notes")
    ids.write.mode("append").text(root)
    return root


_PLACED = "SELECT concat('dataset_id=', dataset_id) AS label, sum(length(CAST(image_id AS VARCHAR)) + 1) AS bytes FROM fx_image WHERE dataset_id IS NOT NULL GROUP BY ALL"


@query("a4_scan", f"SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS class_idx, CAST(bytes AS BIGINT) AS bytes FROM ({_PLACED}) x")
def _(d):
    scanned = ingest.scan_labelled_dir(d.spark, _labelled_folder(d))
    return scanned.groupBy("label", "class_idx").agg(F.sum("length").alias("bytes"))


@query(
    "a4_scan_rejects",
    """WITH n AS (SELECT CAST(sum(length(CAST(image_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM fx_image)
SELECT 'a class of notes' AS label, 'ending not accepted' AS reason, bytes FROM n UNION ALL SELECT NULL, 'not in a class folder', bytes FROM n""",
)
def _(d):
    rejected = ingest.scan_rejects(d.spark, _labelled_folder(d))
    return rejected.groupBy("label", "reason").agg(F.sum("length").alias("bytes"))


_UPLOAD_OK = """WITH ok AS (SELECT u.*, d.name FROM fx_upload u JOIN fx_dataset d ON d.dataset_id = u.dataset_id
  JOIN fx_label l ON l.label_id = u.label_id)"""


@query(
    "a3_ingest_images",
    _UPLOAD_OK
    + """ SELECT (SELECT max(image_id) FROM fx_image) + row_number() OVER (ORDER BY upload_id) AS image_id, dataset_id, label_id,
   concat('datasets/', lower(replace(name, ' ', '_')), '-', CAST(dataset_id AS VARCHAR), '/', file_name) AS image_path,
   FALSE AS used_for_training, FALSE AS used_for_testing FROM ok""",
)
def _(d):
    accepted, _rejected = ingest.ingest_images(d.fx_upload, d.fx_dataset, d.fx_label, d.fx_image)
    return accepted.select("image_id", "dataset_id", "label_id", "image_path", "used_for_training", "used_for_testing")


@query(
    "a3_ingest_rejects",
    """SELECT dataset_id, label_id, count(*) AS files,
  CASE WHEN dataset_id NOT IN (SELECT dataset_id FROM fx_dataset) THEN 'unknown dataset' ELSE 'unknown label' END AS reason
FROM fx_upload WHERE dataset_id NOT IN (SELECT dataset_id FROM fx_dataset) OR label_id NOT IN (SELECT label_id FROM fx_label)
GROUP BY ALL""",
)
def _(d):
    return ingest.ingest_images(d.fx_upload, d.fx_dataset, d.fx_label, d.fx_image)[1]


@query(
    "a5_export_manifest",
    """WITH pairs AS (SELECT dl.dataset_id, dl.label_id, lower(replace(d.name, ' ', '_')) AS dataset_slug, lower(replace(l.name, ' ', '_')) AS label_slug
  FROM fx_dataset_label dl JOIN fx_dataset d ON d.dataset_id = dl.dataset_id JOIN fx_label l ON l.label_id = dl.label_id),
files AS (SELECT p.dataset_id, p.label_slug, regexp_extract(i.image_path, '[^/]*$') AS file_name, min(i.image_id) AS image_id
  FROM fx_image i JOIN pairs p ON p.dataset_id = i.dataset_id AND p.label_id = i.label_id GROUP BY ALL)
SELECT p.dataset_id, p.dataset_slug, p.label_slug, f.file_name, f.image_id, i.image_path
FROM (SELECT DISTINCT dataset_id, dataset_slug, label_slug FROM pairs) p
LEFT JOIN files f ON f.dataset_id = p.dataset_id AND f.label_slug = p.label_slug LEFT JOIN fx_image i ON i.image_id = f.image_id""",
)
def _(d):
    return exports.export_manifest(d.fx_image, d.fx_dataset, d.fx_label, d.fx_dataset_label)


@query(
    "a6_append_epochs",
    "SELECT session_id, number, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss, val_loss FROM fx_epoch",
)
def _(d):
    # the history arrives in two appends: sessions with a known name, then the others
    path = scratch(d.spark, "epochs")
    known = d.fx_session.select("session_id")
    sinks.append_epochs(d.fx_epoch.join(known, "session_id", "left_semi"), path)
    sinks.append_epochs(d.fx_epoch.join(known, "session_id", "left_anti"), path)
    stored = catalog.read_table(d.spark, path, ENTITIES["epoch"])
    return stored.select("session_id", "number", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"), "val_loss")


@query(
    "a6_append_results",
    "SELECT test_id, true_label, prediction, count(*) AS n, round(sum(confidence), 4) AS confidence FROM fx_result GROUP BY ALL",
)
def _(d):
    path = scratch(d.spark, "results")
    sinks.append_results(d.fx_result, path)
    stored = catalog.read_table(d.spark, path, ENTITIES["result"])
    return stored.groupBy("test_id", "true_label", "prediction").agg(
        F.countDistinct("result_id").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence")
    )


# Every batch arrives twice; ids go on without gaps in an order by hash.
@query(
    "a6_epoch_batches",
    """WITH b AS (SELECT e.*, CASE WHEN e.session_id IN (SELECT session_id FROM fx_session) THEN 1 ELSE 2 END AS nth FROM fx_epoch e)
SELECT row_number() OVER (ORDER BY nth, md5(concat('epoch:', session_id, ':', number)), session_id, number) AS epoch_id, concat('part-', nth) AS batch,
  session_id, number, val_loss FROM b""",
)
def _(d):
    path = scratch(d.spark, "epoch-batches")
    known = d.fx_session.select("session_id")
    for batch, how in (("part-1", "left_semi"), ("part-1", "left_semi"), ("part-2", "left_anti"), ("part-1", "left_semi"), ("part-2", "left_anti")):
        sinks.append_batch(d.fx_epoch.join(known, "session_id", how), path, "epoch", batch)
    return sinks.read_batches(d.spark, path, "epoch").select("epoch_id", "batch", "session_id", "number", "val_loss")


@query(
    "a6_result_batches",
    """SELECT row_number() OVER (ORDER BY test_id % 2, md5(concat('result:', test_id, ':', image_id)), test_id, image_id, true_label, prediction, confidence) AS result_id,
  CAST(test_id % 2 AS VARCHAR) AS batch, test_id, image_id, true_label, prediction, confidence FROM fx_result""",
)
def _(d):
    path = scratch(d.spark, "result-batches")
    for n in (0, 1, 0):
        sinks.append_batch(d.fx_result.filter(F.col("test_id") % 2 == n), path, "result", str(n))
    stored = sinks.read_batches(d.spark, path, "result")
    return stored.select("result_id", "batch", "test_id", "image_id", "true_label", "prediction", "confidence")


# ---- filters ----


@query("c1_sessions_by_status", "SELECT * FROM fx_session WHERE status = 'Completed'")
def _(d):
    return fl.sessions_by_status(d.fx_session, "Completed")


@query("c1_sessions_any_status", "SELECT * FROM fx_session")
def _(d):
    return fl.sessions_by_status(d.fx_session)


@query("c2_images_by", f"SELECT {_IMAGE} FROM fx_image WHERE dataset_id = 11 AND label_id = 2")
def _(d):
    return fl.images_by(d.fx_image, dataset_id=11, label_id=2).select(*_IMAGE.split(", "))


@query(
    "c3_labels_of_dataset",
    "SELECT dl.dataset_id, l.label_id, l.name FROM fx_dataset_label dl JOIN fx_label l ON l.label_id = dl.label_id",
)
def _(d):
    return fl.labels_of_dataset(d.fx_label, d.fx_dataset_label)


@query("c4_epochs_of_session", "SELECT session_id, number, round(accuracy, 6) AS accuracy, val_loss FROM fx_epoch WHERE session_id = 7")
def _(d):
    return fl.epochs_of_session(d.fx_epoch, 7).select("session_id", "number", F.round("accuracy", 6).alias("accuracy"), "val_loss")


@query("c5_results_of_test", "SELECT * FROM fx_result WHERE test_id = 3")
def _(d):
    return fl.results_of_test(d.fx_result, 3)


@query("c6_unused_images", f"SELECT {_IMAGE} FROM fx_image WHERE NOT used_for_training AND NOT used_for_testing")
def _(d):
    return fl.unused_images(d.fx_image).select(*_IMAGE.split(", "))


_VISIBLE = """SELECT g.study_id, d.dataset_id, d.study_id AS owner_id, d.name, d.resolution, d.base, d.for_testing
FROM (SELECT dataset_id, study_id FROM fx_dataset UNION SELECT dataset_id, study_id FROM fx_shared) g
JOIN fx_dataset d ON d.dataset_id = g.dataset_id"""
_SHARED = """SELECT s.study_id, d.dataset_id, d.study_id AS owner_id, d.name, d.resolution, d.base, d.for_testing
FROM (SELECT DISTINCT dataset_id, study_id FROM fx_shared) s JOIN fx_dataset d ON d.dataset_id = s.dataset_id"""


@query("c7_visible_datasets", _VISIBLE)
def _(d):
    return fl.visible_datasets(d.fx_dataset, d.fx_shared, studies(d))


@query("c8_trainable_datasets", _SHARED + " WHERE NOT for_testing AND NOT base")
def _(d):
    return fl.trainable_datasets(d.fx_dataset, d.fx_shared, studies(d))


@query("c9_testable_datasets", _SHARED + " WHERE for_testing")
def _(d):
    return fl.testable_datasets(d.fx_dataset, d.fx_shared, studies(d))


@query("c10_sessions_of_study", "SELECT * FROM fx_session WHERE study_id = 2")
def _(d):
    return fl.sessions_of_study(d.fx_session, 2)


@query(
    "c10_tests_of_study",
    "SELECT t.* FROM fx_test t JOIN fx_session s ON s.session_id = t.session_id WHERE s.study_id = 2",
)
def _(d):
    return fl.tests_of_study(d.fx_test, d.fx_session, 2)


@query(
    "c12_search",
    """SELECT d.* , r.r_name AS study_name FROM fx_dataset d JOIN region r ON r.r_regionkey = d.study_id
WHERE (contains(lower(d.name), 'a') OR contains(lower(r.r_name), 'a')) AND (contains(lower(d.name), 'set') OR contains(lower(r.r_name), 'set'))""",
)
def _(d):
    named = d.fx_dataset.join(studies(d).withColumnRenamed("name", "study_name"), "study_id")
    return fl.search(named, ["name", "study_name"], " A  SET ")


@query("c12_facet", "SELECT * FROM fx_dataset WHERE resolution = '384'")
def _(d):
    return fl.facet(d.fx_dataset, "resolution", "384")


@query("c13_has_base", f"SELECT study_id, bool_or(base) AS has_base FROM ({_VISIBLE}) v GROUP BY study_id")
def _(d):
    return fl.has_base(d.fx_dataset, d.fx_shared, studies(d))


@query("c14_get_by_id", "SELECT * FROM fx_session WHERE session_id = 7")
def _(d):
    return fl.get_by_id(d.fx_session, "session_id", 7)


# ---- joins ----


def _session_documents(d):
    return lk.session_documents(d.fx_session, studies(d), d.fx_dataset, d.fx_model, d.fx_epoch)


_SESSION_DOC = """SELECT s.session_id, s.name, s.status, r.r_name AS study_name, d.name AS dataset_name, m.pre_model,
  coalesce(e.epochs, 0) AS epoch_count, e.numbers FROM fx_session s LEFT JOIN region r ON r.r_regionkey = s.study_id
LEFT JOIN fx_dataset d ON d.dataset_id = s.dataset_id LEFT JOIN fx_model m ON m.model_id = s.model_id
LEFT JOIN (SELECT session_id, CAST(count(*) AS INT) AS epochs, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers
  FROM fx_epoch GROUP BY session_id) e ON e.session_id = s.session_id"""


def _numbers(epochs):
    return F.array_join(F.transform(epochs, lambda e: e["number"].cast("string")), ",")


@query("d1_session_documents", _SESSION_DOC)
def _(d):
    return _session_documents(d).select(
        "session_id",
        "name",
        "status",
        F.col("study.name").alias("study_name"),
        F.col("dataset.name").alias("dataset_name"),
        "model.pre_model",
        F.size("epochs").alias("epoch_count"),
        F.when(F.size("epochs") > 0, _numbers(F.col("epochs"))).alias("numbers"),
    )


@query(
    "d1_session_documents_nested",
    """SELECT s.session_id, d.name AS dataset_name, coalesce(l.labels, '') AS labels, coalesce(h.shared, '') AS shared FROM fx_session s
LEFT JOIN fx_dataset d ON d.dataset_id = s.dataset_id
LEFT JOIN (SELECT dataset_id, string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) AS labels FROM fx_dataset_label GROUP BY dataset_id) l
  ON l.dataset_id = s.dataset_id
LEFT JOIN (SELECT dataset_id, string_agg(CAST(study_id AS VARCHAR), ',' ORDER BY study_id) AS shared FROM fx_shared GROUP BY dataset_id) h
  ON h.dataset_id = s.dataset_id""",
)
def _(d):
    # the dataset comes with its labels and the studies that share it
    datasets = lk.dataset_documents(d.fx_dataset, d.fx_dataset_label, d.fx_shared)
    documents = lk.session_documents(d.fx_session, studies(d), datasets, d.fx_model, d.fx_epoch)
    joined = {c: F.coalesce(F.array_join(f"dataset.{c}", ","), F.lit("")).alias(c) for c in ("labels", "shared")}
    return documents.select("session_id", F.col("dataset.name").alias("dataset_name"), joined["labels"], joined["shared"])


@query(
    "d2_test_documents",
    f"""SELECT t.test_id, t.status, s.session_id, s.name AS session_name, s.dataset_name, s.pre_model, s.epoch_count
FROM fx_test t JOIN ({_SESSION_DOC}) s ON s.session_id = t.session_id""",
)
def _(d):
    return lk.test_documents(d.fx_test, _session_documents(d)).select(
        "test_id",
        "status",
        "session_id",
        F.col("training_session.name").alias("session_name"),
        F.col("training_session.dataset.name").alias("dataset_name"),
        "training_session.model.pre_model",
        F.size("training_session.epochs").alias("epoch_count"),
    )


@query(
    "d3_result_documents",
    """SELECT r.test_id, r.image_id, r.prediction, r.confidence, td.name AS test_dataset, s.name AS session_name,
  i.image_path, d.name AS image_dataset, l.name AS image_label
FROM fx_result r JOIN fx_test t ON t.test_id = r.test_id JOIN fx_dataset td ON td.dataset_id = t.dataset_id
JOIN fx_session s ON s.session_id = t.session_id LEFT JOIN fx_image i ON i.image_id = r.image_id
LEFT JOIN fx_dataset d ON d.dataset_id = i.dataset_id LEFT JOIN fx_label l ON l.label_id = i.label_id""",
)
def _(d):
    docs = lk.result_documents(d.fx_result, d.fx_test, d.fx_session, d.fx_image, d.fx_dataset, d.fx_label)
    return docs.select(
        "test_id",
        "image_id",
        "prediction",
        "confidence",
        F.col("test.dataset.name").alias("test_dataset"),
        F.col("test.training_session.name").alias("session_name"),
        "image.image_path",
        F.col("image.dataset.name").alias("image_dataset"),
        F.col("image.label.name").alias("image_label"),
    )


_DATASET_DOC = """SELECT d.dataset_id, d.name, coalesce(l.labels, '') AS labels, coalesce(s.shared, '') AS shared FROM fx_dataset d
LEFT JOIN (SELECT dataset_id, string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) AS labels FROM fx_dataset_label GROUP BY dataset_id) l
  ON l.dataset_id = d.dataset_id
LEFT JOIN (SELECT dataset_id, string_agg(CAST(study_id AS VARCHAR), ',' ORDER BY study_id) AS shared FROM fx_shared GROUP BY dataset_id) s
  ON s.dataset_id = d.dataset_id"""


@query("d4_dataset_documents", _DATASET_DOC)
def _(d):
    docs = lk.dataset_documents(d.fx_dataset, d.fx_dataset_label, d.fx_shared)
    return docs.select("dataset_id", "name", F.array_join("labels", ",").alias("labels"), F.array_join("shared", ",").alias("shared"))


@query("d4_flatten_documents", "SELECT dataset_id, label_id FROM fx_dataset_label")
def _(d):
    return lk.flatten_documents(lk.dataset_documents(d.fx_dataset, d.fx_dataset_label, d.fx_shared))[0]


# Every image outside a base dataset against the base images of the next study, as a clone would ask.
_OWNED = "FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id"
_SOURCES = f"SELECT (d.study_id + 1) % 5 AS scope, i.image_id, i.image_path {_OWNED} WHERE NOT d.base"
_BASES = f"SELECT d.study_id AS scope, i.image_id, i.image_path {_OWNED} WHERE d.base"
_MATCH = f"""WITH src AS ({_SOURCES}), base AS ({_BASES}),
s AS (SELECT *, regexp_extract(image_path, '[^/]*$') AS file_name FROM src)
SELECT s.scope, s.image_id, s.file_name, count(b.image_id) AS matches, min(b.image_id) AS base_image_id
FROM s LEFT JOIN base b ON b.scope = s.scope AND {{condition}} GROUP BY ALL"""


@query("d5_match_by_filename", _MATCH.format(condition="regexp_extract(b.image_path, '[^/]*$') = s.file_name"))
def _(d):
    return lk.match_by_filename(d.sql(_SOURCES), d.sql(_BASES), "scope")


# Short names in the suffix query: "5.png" ends "img_5.png", "img_15.png" and so on.
_SHORT_SOURCES = f"""SELECT (d.study_id + 1) % 5 AS scope, i.image_id,
  concat('short/', CAST(i.image_id - i.image_id % 5 AS STRING), '.png') AS image_path {_OWNED} WHERE NOT d.base"""


@query(
    "d5_match_by_suffix",
    # the same rule stated over distinct names, so that the check does not pair up all images
    f"""WITH s AS (SELECT *, regexp_extract(image_path, '[^/]*$') AS file_name FROM ({_SHORT_SOURCES}) x),
base AS (SELECT scope, image_path, count(*) AS copies, min(image_id) AS first_id FROM ({_BASES}) y GROUP BY ALL),
tails AS (SELECT scope, copies, first_id, unnest(list_transform(range(1, len(image_path) + 1), lambda k: right(image_path, k))) AS tail FROM base),
m AS (SELECT scope, tail, CAST(sum(copies) AS BIGINT) AS matches, min(first_id) AS base_image_id FROM tails GROUP BY ALL)
SELECT s.scope, s.image_id, s.file_name, coalesce(m.matches, 0) AS matches, m.base_image_id
FROM s LEFT JOIN m ON m.scope = s.scope AND m.tail = s.file_name""",
)
def _(d):
    return lk.match_by_filename(d.sql(_SHORT_SOURCES), d.sql(_BASES), "scope", mode="suffix")


@query(
    "d6_exclude_used",
    f"SELECT i.image_id, i.label_id, i.study_id {_OWNED} WHERE d.base AND NOT i.used_for_testing",
)
def _(d):
    base = d.fx_image.join(d.fx_dataset.filter("base").select("dataset_id"), "dataset_id", "left_semi")
    used = d.fx_image.filter("used_for_testing")
    return lk.exclude_used(base, used).select("image_id", "label_id", "study_id")


_CATALOG = ", ".join(f"('{n}', '{h}', {p if p else 'NULL'})" for n, h, p in BACKBONES)


@query(
    "d7_backbone_lookup",
    f"""SELECT s.session_id, m.pre_model, c.handle, coalesce(c.pixels, 224) AS pixels FROM fx_session s
JOIN fx_model m ON m.model_id = s.model_id LEFT JOIN (VALUES {_CATALOG}) c(name, handle, pixels) ON c.name = m.pre_model""",
)
def _(d):
    models = lk.backbone_lookup(d.fx_model, lk.backbone_catalog(d.spark))
    return d.fx_session.select("session_id", "model_id").join(models, "model_id").select("session_id", "pre_model", "handle", "pixels")


@query(
    "d8_resolve_model",
    """SELECT * FROM (SELECT request_id, coalesce(nullif(model_id, 0), (SELECT min(model_id) FROM fx_model WHERE is_default)) AS model_id
  FROM fx_request) r WHERE model_id IN (SELECT model_id FROM fx_model)""",
)
def _(d):
    return lk.resolve_model(d.fx_request, d.fx_model)[0].select("request_id", "model_id")


@query(
    "d8_rejected",
    """SELECT request_id, CASE WHEN named IS NULL THEN 'no model named and no default model' ELSE 'unknown model' END AS reason
FROM (SELECT request_id, nullif(CASE WHEN request_id % 6 = 1 THEN model_id + 1000000 ELSE model_id END, 0) AS named FROM fx_request) r
WHERE named IS NULL OR named NOT IN (SELECT model_id FROM fx_model WHERE NOT is_default)""",
)
def _(d):
    # some requests name models that do not exist, and no model of this catalog is a default
    named = F.when(F.col("request_id") % 6 == 1, F.col("model_id") + 1_000_000).otherwise(F.col("model_id"))
    rejected = lk.resolve_model(d.fx_request.withColumn("model_id", named), d.fx_model.filter("not is_default"))[1]
    return rejected.select("request_id", "reason")


# ---- counts ----


@query(
    "e1_label_counts",
    """SELECT l.label_id, l.name, count(i.image_id) AS image_count FROM fx_label l LEFT JOIN fx_image i ON i.label_id = l.label_id GROUP BY ALL""",
)
def _(d):
    return ls.label_counts(d.fx_label, d.fx_image)


@query(
    "e1_label_counts_by_dataset",
    """SELECT dl.dataset_id, l.label_id, l.name, count(i.image_id) AS image_count FROM fx_dataset_label dl
JOIN fx_label l ON l.label_id = dl.label_id LEFT JOIN fx_image i ON i.label_id = l.label_id AND i.dataset_id = dl.dataset_id GROUP BY ALL""",
)
def _(d):
    return ls.label_counts_by_dataset(d.fx_dataset_label, d.fx_label, d.fx_image)


@query(
    "e2_eligibility",
    """WITH c AS (SELECT dataset_id, label_id, count(*) AS available FROM fx_image GROUP BY ALL),
r AS (SELECT study_id * 10 + 1 AS dataset_id, n * 2 + 10 AS n FROM fx_generate),
t AS (SELECT dataset_id, CAST(sum(available) AS BIGINT) AS total FROM c GROUP BY ALL)
SELECT c.dataset_id, c.label_id, r.n, c.available, t.total FROM c JOIN t ON t.dataset_id = c.dataset_id JOIN r ON r.dataset_id = c.dataset_id
JOIN fx_dataset_label dl ON dl.dataset_id = c.dataset_id AND dl.label_id = c.label_id WHERE c.available >= r.n AND t.total >= r.n""",
)
def _(d):
    bases = d.sql("SELECT study_id * 10 + 1 AS dataset_id, n * 2 + 10 AS n FROM fx_generate")
    return ls.eligibility(bases, d.fx_dataset_label, d.fx_image)


@query(
    "e3_label_union",
    "SELECT DISTINCT d.study_id, dl.label_id FROM fx_dataset_label dl JOIN fx_dataset d ON d.dataset_id = dl.dataset_id",
)
def _(d):
    return ls.label_union(d.fx_dataset, d.fx_dataset_label)


@query(
    "e4_class_names",
    """WITH n AS (SELECT DISTINCT dl.dataset_id, lower(replace(l.name, ' ', '_')) AS class_name FROM fx_dataset_label dl JOIN fx_label l ON l.label_id = dl.label_id)
SELECT dataset_id, class_name, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY class_name) - 1 AS INT) AS class_idx FROM n""",
)
def _(d):
    names = ls.class_names(d.fx_dataset_label, d.fx_label)
    return names.select("dataset_id", F.posexplode("class_names").alias("class_idx", "class_name"))


# ---- listings ----


def _timed_sessions(d):
    return d.fx_session.join(d.fx_session_time, "session_id", "left")


@query(
    "f1_sessions_listing",
    "SELECT s.session_id, s.name, s.status, t.created_at FROM fx_session s LEFT JOIN fx_session_time t ON t.session_id = s.session_id",
)
def _(d):
    return ls.oldest_first(_timed_sessions(d).select("session_id", "name", "status", "created_at"), "session_id")


@query(
    "f1_tests_listing",
    "SELECT s.test_id, s.status, t.created_at FROM fx_test s LEFT JOIN fx_session_time t ON t.session_id = s.session_id",
)
def _(d):
    timed = d.fx_test.join(d.fx_session_time, "session_id", "left")
    return ls.oldest_first(timed.select("test_id", "status", "created_at"), "test_id")


@query(
    "f2_paginate",
    """WITH r AS (SELECT image_id, dataset_id, label_id, image_path,
  row_number() OVER (PARTITION BY dataset_id, label_id ORDER BY image_id) AS position,
  count(*) OVER (PARTITION BY dataset_id, label_id) AS total FROM fx_image WHERE dataset_id IS NOT NULL)
SELECT *, total > 20 AS has_next FROM r WHERE position BETWEEN 11 AND 20""",
)
def _(d):
    images = d.fx_image.select("image_id", "dataset_id", "label_id", "image_path")
    return ls.paginate_all(images, page=2)


@query(
    "f2_paginate_one",
    "SELECT image_id, image_path FROM fx_image WHERE dataset_id = 11 AND label_id = 2 ORDER BY image_id LIMIT 100 OFFSET 0",
)
def _(d):
    # the asked size of 500 is cut to the maximum of 100
    images = fl.images_by(d.fx_image, dataset_id=11, label_id=2).select("image_id", "image_path")
    return ls.paginate(images, page=1, size=500)


@query(
    "f2_paginate_deep",
    """WITH n AS (SELECT image_id, dataset_id, label_id, image_path, row_number() OVER (PARTITION BY label_id ORDER BY image_id) AS position,
  count(*) OVER (PARTITION BY label_id) AS total FROM fx_image WHERE dataset_id IS NOT NULL)
SELECT image_id, image_path, label_id, position FROM n WHERE position > 100 * (total // 200) AND position <= 100 * (total // 200) + 100""",
)
def _(d):
    # the middle page of each label, read with a stored index of ranges of 500 rows
    images = d.fx_image.filter("dataset_id IS NOT NULL").select("image_id", "image_path", "label_id")
    path = scratch(d.spark, "page-index")
    page_index.write_index(page_index.build_index(images, "image_id", ["label_id"], range_rows=500), path)
    index = page_index.read_index(d.spark, path)
    pages = []
    for label in index.groupBy("label_id").agg(F.first("total").alias("total")).collect():  # one row a label of the demo
        middle = label.total // 200
        page = ls.paginate(
            images.filter(F.col("label_id") == label.label_id), middle + 1, 100, index.filter(F.col("label_id") == label.label_id)
        )
        ranked = page.withColumn("position", 100 * middle + F.row_number().over(Window.partitionBy("label_id").orderBy("image_id")).cast("long"))
        pages.append(ranked)
    return reduce(DataFrame.unionByName, pages)


@query(
    "f3_last_completed_session",
    "SELECT * FROM fx_session WHERE session_id = (SELECT max(session_id) FROM fx_session WHERE status = 'Completed')",
)
def _(d):
    return ls.last_by_pk(d.fx_session, "session_id", condition=F.col("status") == "Completed")


@query(
    "f3_first_base_of_study",
    "SELECT * FROM fx_dataset WHERE dataset_id IN (SELECT min(dataset_id) FROM fx_dataset WHERE base GROUP BY study_id)",
)
def _(d):
    return ls.first_by_pk(d.fx_dataset, "dataset_id", ["study_id"], F.col("base"))


@query(
    "f3_first_default_model",
    "SELECT * FROM fx_model WHERE model_id = (SELECT min(model_id) FROM fx_model WHERE is_default)",
)
def _(d):
    return ls.first_by_pk(d.fx_model, "model_id", condition=F.col("is_default"))


@query(
    "f4_latest_training_dataset",
    """SELECT study_id, dataset_id FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY created_at DESC NULLS LAST, dataset_id DESC) AS rn
FROM fx_dataset_dated WHERE NOT base AND NOT for_testing) x WHERE rn = 1""",
)
def _(d):
    return ls.latest_training_dataset(d.fx_dataset_dated)


# ---- declared constraints ----


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


@query(
    "h1_violations",
    f"""SELECT 'dangling dataset_id' AS rule, 'image' AS entity, image_id AS id FROM fx_image WHERE dataset_id IS NOT NULL AND dataset_id % 10 = 3
UNION ALL SELECT 'unknown status', 'session', session_id FROM fx_session WHERE status NOT IN ({_in(STATUSES[:4])})
UNION ALL SELECT 'unknown pre_model', 'model', model_id FROM fx_model WHERE pre_model NOT IN ({_in(p for p in PRE_MODELS if p != 'resnet_v2_50')})
UNION ALL SELECT 'unknown resolution', 'dataset', dataset_id FROM fx_dataset WHERE resolution NOT IN ('224', '384')
UNION ALL SELECT 'name not unique', 'dataset', dataset_id FROM fx_dataset WHERE (study_id % 2) IN (0, 1)
UNION ALL SELECT 'name too long', 'session', session_id FROM fx_session WHERE length(name) > 17""",
)
def _(d):
    # tightened rules and doubled names so that every rule meets breaches in the test tables
    named = d.fx_dataset.withColumn("name", F.concat(F.lit("study "), (F.col("study_id") % 2).cast("string")))
    kept = d.fx_dataset.filter(~F.col("for_testing"))
    return quality.collect(
        quality.dangling(d.fx_image, "image", "image_id", "dataset_id", kept),
        quality.not_allowed(d.fx_session, "session", "session_id", "status", STATUSES[:4]),
        quality.not_allowed(d.fx_model, "model", "model_id", "pre_model", [p for p in PRE_MODELS if p != "resnet_v2_50"]),
        quality.not_allowed(d.fx_dataset, "dataset", "dataset_id", "resolution", ["224", "384"]),
        quality.duplicated(named, "dataset", "dataset_id", "name"),
        quality.too_long(d.fx_session, "session", "session_id", "name", 17),
    )


@query(
    "h1_violations_catalog",
    """SELECT 'dangling dataset_id' AS rule, 'image' AS entity, image_id AS id FROM fx_image WHERE dataset_id NOT IN (SELECT dataset_id FROM fx_dataset)
UNION ALL SELECT 'dangling model_id', 'session', session_id FROM fx_session WHERE model_id NOT IN (SELECT model_id FROM fx_model)
UNION ALL SELECT 'dangling session_id', 'epoch', session_id FROM fx_epoch WHERE session_id NOT IN (SELECT session_id FROM fx_session)
UNION ALL SELECT 'dangling test_id', 'result', image_id FROM fx_result WHERE test_id NOT IN (SELECT test_id FROM fx_test)""",
)
def _(d):
    tables = {
        "study": studies(d),
        "label": d.fx_label,
        "dataset": d.fx_dataset,
        "image": d.fx_image.drop("study_id"),
        "model": d.fx_model,
        "session": d.fx_session,
        "epoch": d.fx_epoch.withColumn("epoch_id", F.col("session_id")),
        "test": d.fx_test.drop("study_id"),
        "result": d.fx_result.withColumnRenamed("image_id", "result_id"),
    }
    return quality.violations(tables)


@query(
    "h1_missing_and_too_long",
    """SELECT 'name missing' AS rule, 'session' AS entity, session_id AS id FROM fx_session WHERE session_id % 7 = 0
UNION ALL SELECT 'status missing', 'session', session_id FROM fx_session WHERE session_id % 5 = 0
UNION ALL SELECT 'model_path too long', 'session', session_id FROM fx_session WHERE session_id > 100
UNION ALL SELECT 'label_id missing', 'image', image_id FROM fx_image WHERE image_id % 11 = 0
UNION ALL SELECT 'image_path missing', 'image', image_id FROM fx_image WHERE image_id % 13 = 0
UNION ALL SELECT 'val_loss missing', 'epoch', session_id * 1000 + number FROM fx_epoch WHERE val_loss IS NULL OR number % 3 = 0
UNION ALL SELECT 'prediction too long', 'result', image_id FROM fx_result WHERE confidence > 0.5
UNION ALL SELECT 'confidence missing', 'result', image_id FROM fx_result WHERE test_id % 4 = 0
UNION ALL SELECT 'dangling session_id', 'epoch', session_id * 1000 + number FROM fx_epoch WHERE session_id NOT IN (SELECT session_id FROM fx_session)""",
)
def _(d):
    emptied = lambda df, column, when: df.withColumn(column, F.when(~F.expr(when), F.col(column)))
    results = d.fx_result.withColumn("prediction", F.when(F.col("confidence") > 0.5, F.repeat(F.lit("é"), 101)).otherwise(F.repeat(F.lit("é"), 100)))
    sessions = emptied(emptied(d.fx_session, "name", "session_id % 7 = 0"), "status", "session_id % 5 = 0")
    tables = {
        "session": sessions.withColumn("model_path", F.expr("repeat('p', cast(session_id as int))")),
        "image": emptied(emptied(d.fx_image.drop("study_id"), "label_id", "image_id % 11 = 0"), "image_path", "image_id % 13 = 0"),
        "epoch": emptied(d.fx_epoch, "val_loss", "number % 3 = 0").withColumn("epoch_id", F.col("session_id") * 1000 + F.col("number")),
        "result": emptied(results, "confidence", "test_id % 4 = 0").withColumnRenamed("image_id", "result_id"),
    }
    return quality.violations(tables)


_REQUEST = """SELECT *, CASE WHEN study_id IS NULL THEN 'study_id is required.'
 WHEN study_id NOT IN (SELECT r_regionkey FROM region) THEN 'study_id does not exist.'
 WHEN coalesce(hotdataset, 0) = 0 AND coalesce(dataset_id, 0) = 0 THEN 'Either ''hotdataset'' or ''dataset_id'' must be provided.'
 END AS reason FROM fx_request"""


@query("h2_accepted_requests", f"SELECT request_id, dataset_id, hotdataset, study_id FROM ({_REQUEST}) r WHERE reason IS NULL")
def _(d):
    accepted, _rejected = quality.validate_session_requests(d.fx_request, studies(d))
    return accepted.select("request_id", "dataset_id", "hotdataset", "study_id")


_UNKNOWN = """SELECT *, CASE WHEN request_id % 7 = 3 THEN dataset_id + 100000 ELSE dataset_id END AS asked,
  CASE WHEN request_id % 11 = 5 THEN 999999 ELSE model_id END AS model FROM fx_request"""


@query(
    "h2_unknown_ids",
    f"""SELECT request_id, reason FROM (SELECT request_id, CASE WHEN study_id IS NULL THEN 'study_id is required.'
 WHEN study_id NOT IN (SELECT r_regionkey FROM region) THEN 'study_id does not exist.'
 WHEN coalesce(hotdataset, 0) = 0 AND coalesce(asked, 0) = 0 THEN 'Either ''hotdataset'' or ''dataset_id'' must be provided.'
 WHEN coalesce(asked, 0) <> 0 AND asked NOT IN (SELECT dataset_id FROM fx_dataset WHERE NOT base) THEN 'unknown dataset'
 WHEN coalesce(hotdataset, 0) <> 0 THEN 'no base dataset to draw from'
 WHEN coalesce(model, 0) <> 0 AND model NOT IN (SELECT model_id FROM fx_model) THEN 'unknown model' END AS reason FROM ({_UNKNOWN}) r) x
WHERE reason IS NOT NULL""",
)
def _(d):
    # some requests name datasets and models that do not exist; the catalog has no base dataset
    asked = F.when(F.col("request_id") % 7 == 3, F.col("dataset_id") + 100_000).otherwise(F.col("dataset_id"))
    model = F.when(F.col("request_id") % 11 == 5, F.lit(999_999)).otherwise(F.col("model_id"))
    requests = d.fx_request.withColumns({"dataset_id": asked, "model_id": model})
    return quality.validate_session_requests(requests, studies(d), d.fx_dataset.filter("not base"), d.fx_model)[1].select("request_id", "reason")


@query("h2_rejected_requests", f"SELECT request_id, reason FROM ({_REQUEST}) r WHERE reason IS NOT NULL")
def _(d):
    return quality.validate_session_requests(d.fx_request, studies(d))[1].select("request_id", "reason")
