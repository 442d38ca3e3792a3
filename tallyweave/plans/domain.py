"""The labelled-collection domain expressed over the driver's tables (FIXTURES.md).

``VIEWS`` holds one SELECT per view. Most run unchanged in Spark and DuckDB; the three that
pair a table with a short constant list use ``explode`` in Spark (``SPARK_VIEWS``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyweave.session import configure

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    "fx_dataset": """
SELECT r.r_regionkey * 10 + k.kind AS dataset_id, r.r_regionkey AS study_id,
       concat(r.r_name, CASE k.kind WHEN 1 THEN ' Base' WHEN 2 THEN ' Train Set' ELSE ' Test Set' END) AS name,
       CASE r.r_regionkey % 3 WHEN 0 THEN '224' WHEN 1 THEN '384' ELSE '512' END AS resolution,
       k.kind = 1 AS base, k.kind = 3 AS for_testing
FROM region r CROSS JOIN (SELECT 1 AS kind UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "fx_shared": """
SELECT dataset_id, (study_id + s.off) % 5 AS study_id
FROM fx_dataset CROSS JOIN (SELECT 0 AS off UNION ALL SELECT 1) s WHERE NOT base AND (s.off = 1 OR study_id < 3)""",
    "fx_label": """
SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS label_id, name
FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) t""",
    "fx_dataset_label": """
SELECT d.dataset_id, l.label_id FROM fx_dataset d CROSS JOIN fx_label l WHERE (d.dataset_id + l.label_id) % 7 <> 0""",
    "fx_image": """
SELECT o_orderkey AS image_id, l.label_id AS label_id, c_mktsegment AS label_name,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE (c_nationkey % 5) * 10 + CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END END AS dataset_id,
       CAST(c_nationkey % 5 AS INT) AS study_id,
       concat('datasets/study_', CAST(c_nationkey % 5 AS STRING), '/img_', CAST(o_orderkey - o_orderkey % 5 AS STRING), '.png') AS image_path,
       o_orderstatus = 'F' AS used_for_training,
       (o_orderstatus = 'P' OR o_orderkey % 11 = 0) AS used_for_testing,
       o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN fx_label l ON l.name = c_mktsegment""",
    "fx_session": """
SELECT s_suppkey AS session_id, CAST(s_nationkey % 5 AS INT) AS study_id, s_name AS name,
       (s_nationkey % 5) * 10 + 2 AS dataset_id, CAST(s_suppkey % 7 AS INT) AS model_id,
       CASE s_suppkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Training' WHEN 2 THEN 'Testing' WHEN 3 THEN 'Completed' ELSE 'Failed' END AS status,
       CAST(floor(abs(s_acctbal)) AS BIGINT) AS duration_s
FROM supplier""",
    "fx_model": """
SELECT m AS model_id, CASE m WHEN 0 THEN 'efficientnetv2-s' WHEN 1 THEN 'efficientnet_b7' WHEN 2 THEN 'inception_v3'
       WHEN 3 THEN 'resnet_v2_50' WHEN 4 THEN 'nasnet_large' WHEN 5 THEN 'nasnet_mobile' ELSE 'bit_s-r50x1' END AS pre_model,
       m IN (3, 5) AS is_default
FROM (SELECT DISTINCT CAST(s_suppkey % 7 AS INT) AS m FROM supplier) t""",
    "fx_test": """
SELECT session_id AS test_id, session_id, study_id, study_id * 10 + 3 AS dataset_id, status FROM fx_session""",
    "fx_epoch": """
SELECT user_id AS session_id, CAST(day(ts) AS INT) AS number,
       avg(CASE WHEN event_type = 'purchase' THEN 1.0E0 ELSE 0.0E0 END) AS accuracy, avg(value) AS loss,
       avg(CASE WHEN event_type = 'view' THEN 1.0E0 ELSE 0.0E0 END) AS val_accuracy, max(value) AS val_loss
FROM events GROUP BY user_id, day(ts)""",
    "fx_status_event": """
SELECT event_id, user_id AS session_id, ts,
       CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Training' WHEN 'click' THEN 'Testing'
                       WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END AS status
FROM events""",
    "fx_result": """
SELECT l_suppkey AS test_id, l_orderkey AS image_id, lower(p_type) AS true_label,
       CASE WHEN (l_orderkey + l_linenumber) % 4 <> 0 THEN lower(p_type)
            WHEN p_type = 'ECONOMY' THEN 'large' WHEN p_type = 'LARGE' THEN 'medium'
            WHEN p_type = 'MEDIUM' THEN 'promo' WHEN p_type = 'PROMO' THEN 'small'
            WHEN p_type = 'SMALL' THEN 'standard' ELSE 'economy' END AS prediction,
       l_quantity / 50.0E0 AS confidence
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_feature": """
SELECT vec_id AS image_id, embedding AS features, label AS class_idx, concat('class_', CAST(label AS STRING)) AS label_slug FROM embeddings""",
    # A feature vector for every image, the vectors in turn; some images of study 4 have none.
    "fx_image_feature": """
SELECT i.image_id, f.features FROM (SELECT image_id, study_id, image_id % (SELECT count(*) FROM embeddings) AS vec FROM fx_image) i
JOIN fx_feature f ON f.image_id = i.vec WHERE NOT (i.study_id = 4 AND i.image_id % 97 = 1)""",
    # When each session was first and last heard of, for the listings and durations.
    "fx_session_time": """
SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id""",
    # When each dataset received its first image, for "latest training dataset".
    "fx_dataset_dated": """
SELECT d.dataset_id, d.study_id, d.name, d.resolution, d.base, d.for_testing, t.created_at
FROM fx_dataset d LEFT JOIN (SELECT dataset_id, min(created_at) AS created_at FROM fx_image GROUP BY dataset_id) t
  ON d.dataset_id = t.dataset_id""",
    # Uploads: some name a dataset or a label that does not exist.
    "fx_upload": """
SELECT p_partkey AS upload_id, (p_size % 6) * 10 + 1 AS dataset_id, CAST(p_partkey % 7 AS INT) AS label_id,
       concat('part_', CAST(p_partkey AS STRING), '.png') AS file_name
FROM part""",
    # Session requests: some lack a study, a dataset or a model.
    "fx_request": """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 9 AS INT) END AS model_id,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_nationkey % 5) * 10 + 2 END AS dataset_id,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 2 * 50 AS INT) ELSE NULL END AS hotdataset,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_nationkey % 6 AS INT) END AS study_id
FROM customer""",
    # One generate request per study, sized from its base images; study 4 asks for more than any label has.
    "fx_generate": """
SELECT c.study_id, 100 + c.study_id AS dataset_id,
       CASE WHEN c.study_id = 4 THEN max(c.images) + 1 ELSE CAST(floor(min(c.images) / 2.0E0) AS BIGINT) END AS n
FROM (SELECT d.study_id, i.label_id, count(*) AS images FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id
  WHERE d.base GROUP BY d.study_id, i.label_id) c
GROUP BY c.study_id""",
    # The same on top of what the study's previous training set holds.
    "fx_generate_carry": """
SELECT g.study_id, g.dataset_id, g.n + c.carried AS n FROM fx_generate g JOIN (
  SELECT study_id, max(images) AS carried FROM (
    SELECT d.study_id, i.label_id, count(*) AS images FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id
    WHERE NOT d.base AND NOT d.for_testing GROUP BY d.study_id, i.label_id) x GROUP BY study_id) c ON c.study_id = g.study_id""",
    "fx_generate_label": """
SELECT 100 + d.study_id AS dataset_id, dl.label_id FROM fx_dataset_label dl JOIN fx_dataset d ON d.dataset_id = dl.dataset_id
WHERE d.base""",
    # 8 x 8 grey and 4 x 4 RGBA pictures from the feature vectors.
    "fx_gray": """
SELECT image_id, class_idx, 8 AS h, 8 AS w, 1 AS c,
  list_transform(features, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1) * 127.5E0 + 0.5E0), 0), 255) AS FLOAT)) AS px FROM fx_feature""",
    "fx_rgba": """
SELECT image_id, class_idx, 4 AS h, 4 AS w, 4 AS c, px FROM fx_gray""",
}

SPARK_VIEWS: dict[str, str] = {
    "fx_gray": """
SELECT image_id, class_idx, 8 AS h, 8 AS w, 1 AS c,
  transform(features, v -> CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1) * 127.5E0 + 0.5E0), 0), 255) AS FLOAT)) AS px FROM fx_feature""",
    "fx_dataset": """
SELECT r_regionkey * 10 + kind AS dataset_id, r_regionkey AS study_id,
       concat(r_name, CASE kind WHEN 1 THEN ' Base' WHEN 2 THEN ' Train Set' ELSE ' Test Set' END) AS name,
       CASE r_regionkey % 3 WHEN 0 THEN '224' WHEN 1 THEN '384' ELSE '512' END AS resolution,
       kind = 1 AS base, kind = 3 AS for_testing
FROM region LATERAL VIEW explode(array(1, 2, 3)) k AS kind""",
    "fx_shared": """
SELECT dataset_id, (study_id + off) % 5 AS study_id
FROM fx_dataset LATERAL VIEW explode(array(0, 1)) s AS off WHERE NOT base AND (off = 1 OR study_id < 3)""",
    "fx_dataset_label": """
SELECT d.dataset_id, d.label_id
FROM (SELECT dataset_id, explode(sequence(1, label_count)) AS label_id
      FROM (SELECT dataset_id, CAST((SELECT count(*) FROM fx_label) AS INT) AS label_count FROM fx_dataset)) d
JOIN fx_label l ON l.label_id = d.label_id
WHERE (d.dataset_id + d.label_id) % 7 <> 0""",
}


def _mentioned(text: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", text))
    return [name for name in names if name in words]


def _closure(text: str, views: dict[str, str]) -> list[str]:
    """The views a query needs, dependencies first."""
    ordered: list[str] = []

    def visit(body: str) -> None:
        for name in _mentioned(body, views):
            if name not in ordered:
                visit(views[name])
                ordered.append(name)

    visit(text)
    return ordered


def with_views(body: str) -> str:
    """DuckDB text: the query with the views it needs as CTEs."""
    names = _closure(body, VIEWS)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in names]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


class Domain:
    """Lazy access to the driver tables and the fx views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def stream(self, table: str) -> DataFrame:
        """The same table as a file stream; the glob accepts a file or a folder of that name."""
        return self.spark.readStream.schema(self.table(table).schema).parquet(f"{self.sf_dir}/{table}.parque[t]")

    def sql(self, body: str, **tables: DataFrame) -> DataFrame:
        """Spark SQL over the views; ``tables`` replaces driver tables, for example by a stream."""
        views = {**VIEWS, **SPARK_VIEWS}
        names = _closure(body, views)
        text = "\n".join([*(views[n] for n in names), body])
        sources = []
        for table in _mentioned(text, TABLES):
            source = "{" + table + "}" if table in tables else f"parquet.`{self.path(table)}`"
            sources.append(f"{table} AS (SELECT * FROM {source})")
        ctes = sources + [f"{n} AS ({views[n]})" for n in names]
        used = {t: df for t, df in tables.items() if t in _mentioned(text, TABLES)}
        return self.spark.sql("WITH " + ",\n".join(ctes) + "\n" + body.strip(), **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
