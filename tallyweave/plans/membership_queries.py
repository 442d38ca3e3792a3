"""Queries over sampling, moves, clones and record keeping."""

from pyspark.sql import functions as F

from tallyweave.operators import membership as mb
from tallyweave.operators import records as rc
from tallyweave.plans.registry import query
from tallyweave.session import settle

SEED = 7
_CHANGE = ["image_id", "old_dataset_id", "new_dataset_id", "used_for_training", "used_for_testing"]


def images(d):
    """The image table with the catalog's columns only (the study follows from the dataset)."""
    return d.fx_image.select(
        "image_id", F.col("dataset_id").cast("long").alias("dataset_id"), "label_id", "image_path", *mb.FLAGS
    )


def _moves(edit):
    return edit.changes.select(
        "image_id", *[F.col(c).cast("long").alias(c) for c in ("old_dataset_id", "new_dataset_id")], *mb.FLAGS
    )


_ORDER = "md5(concat('7:', CAST({a}.image_id AS VARCHAR))), {a}.image_id"


def _sample_sql(pool: str, quota: str = "q.n", requests: str = "fx_generate") -> str:
    """Ranked candidates per (request, label); requests with a short label are left out."""
    return f"""WITH want AS (SELECT g.dataset_id AS target, g.study_id, gl.label_id, g.n FROM {requests} g
  JOIN fx_generate_label gl ON gl.dataset_id = g.dataset_id),
pool AS (SELECT q.target, q.label_id, {quota} AS quota, i.image_id, i.dataset_id, i.used_for_training, i.used_for_testing,
  row_number() OVER (PARTITION BY q.target, q.label_id ORDER BY {_ORDER.format(a='i')}) AS rk
  FROM want q JOIN fx_dataset d ON d.study_id = q.study_id AND d.base
  JOIN fx_image i ON i.dataset_id = d.dataset_id AND i.label_id = q.label_id WHERE {pool}),
short AS (SELECT q.target, q.label_id, {quota} AS quota, (SELECT count(*) FROM pool p WHERE p.target = q.target AND p.label_id = q.label_id) AS available
  FROM want q WHERE available < quota),
drawn AS (SELECT * FROM pool WHERE rk <= quota AND target NOT IN (SELECT target FROM short))
"""


_TESTING = _sample_sql("NOT i.used_for_testing")
_TESTING_MOVES = """SELECT image_id, CAST(dataset_id AS BIGINT) AS old_dataset_id, CAST(target AS BIGINT) AS new_dataset_id,
  used_for_training, TRUE AS used_for_testing FROM drawn"""


def _requests(d, view="fx_generate"):
    """Requests are small stored tables; here they are derived from the images and then stored."""
    return settle(getattr(d, view), "requests"), settle(d.fx_generate_label, "request-labels")


def _testing_set(d):
    return mb.make_testing_set(images(d), d.fx_dataset, *_requests(d), SEED)


@query("g2_make_testing_set", _TESTING + _TESTING_MOVES)
def _(d):
    return _moves(_testing_set(d))


@query(
    "g2_testing_snapshot",
    _TESTING
    + """SELECT i.image_id, CAST(coalesce(w.target, i.dataset_id) AS BIGINT) AS dataset_id, i.label_id, i.image_path, i.used_for_training,
  i.used_for_testing OR w.image_id IS NOT NULL AS used_for_testing FROM fx_image i LEFT JOIN drawn w ON w.image_id = i.image_id""",
)
def _(d):
    return _testing_set(d).images


@query(
    "g2_testing_shortfalls",
    _TESTING + "SELECT CAST(target AS BIGINT) AS new_dataset_id, label_id, quota, available FROM short",
)
def _(d):
    return _testing_set(d).rejected.withColumn("new_dataset_id", F.col("new_dataset_id").cast("long"))


def _new_sets(edit):
    rows = edit.datasets.join(edit.dataset_labels, "dataset_id")
    return rows.select(F.col("dataset_id").cast("long"), F.col("study_id").cast("long"), F.col("label_id").cast("long"), "base", "for_testing")


_NEW_SETS = """SELECT CAST(g.dataset_id AS BIGINT) AS dataset_id, CAST(g.study_id AS BIGINT) AS study_id, CAST(gl.label_id AS BIGINT) AS label_id,
  FALSE AS base, {testing} AS for_testing
FROM fx_generate g JOIN (SELECT DISTINCT dataset_id, label_id FROM fx_generate_label) gl ON gl.dataset_id = g.dataset_id
WHERE g.dataset_id NOT IN (SELECT target FROM short)"""


@query("g2_new_datasets", _TESTING + _NEW_SETS.format(testing="TRUE"))
def _(d):
    return _new_sets(_testing_set(d))


_FRESH = "NOT i.used_for_training AND NOT i.used_for_testing"
_TRAINING_MOVES = """SELECT image_id, CAST(dataset_id AS BIGINT) AS old_dataset_id, CAST(target AS BIGINT) AS new_dataset_id,
  TRUE AS used_for_training, used_for_testing FROM """


@query("g3_make_training_set", _sample_sql(_FRESH) + _TRAINING_MOVES + "drawn")
def _(d):
    return _moves(mb.make_training_set(images(d), d.fx_dataset, *_requests(d), SEED))


@query("g3_new_datasets", _sample_sql(_FRESH) + _NEW_SETS.format(testing="FALSE"))
def _(d):
    return _new_sets(mb.make_training_set(images(d), d.fx_dataset, *_requests(d), SEED))


# Three requests in every study for half of the usual number: each takes the next ranks, if all labels last.
def _three_sql(pool: str) -> str:
    return f"""WITH want AS (SELECT DISTINCT g.study_id, gl.label_id, greatest(1, CAST(floor(g.n / 2.0E0) AS BIGINT)) AS m FROM fx_generate g
  JOIN fx_generate_label gl ON gl.dataset_id = g.dataset_id),
pool AS (SELECT q.study_id, q.label_id, q.m, i.image_id, i.dataset_id, i.used_for_training, i.used_for_testing,
  row_number() OVER (PARTITION BY q.study_id, q.label_id ORDER BY {_ORDER.format(a='i')}) - 1 AS rk
  FROM want q JOIN fx_dataset d ON d.study_id = q.study_id AND d.base
  JOIN fx_image i ON i.dataset_id = d.dataset_id AND i.label_id = q.label_id WHERE {pool}),
lasts AS (SELECT q.study_id, min((SELECT count(*) FROM pool p WHERE p.study_id = q.study_id AND p.label_id = q.label_id) // q.m) AS requests FROM want q GROUP BY ALL),
drawn AS (SELECT image_id, dataset_id, 100 + study_id + 100 * (rk // m) AS target, used_for_training, used_for_testing
  FROM pool JOIN lasts USING (study_id) WHERE rk // m < least(3, requests))
"""


def _three(d):
    requests = d.sql("SELECT study_id, dataset_id, n FROM fx_generate").select(
        "study_id", F.explode(F.array(*[F.col("dataset_id") + 100 * k for k in range(3)])).alias("dataset_id"),
        F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("long").alias("n"),
    )
    labels = d.fx_generate_label.select(F.explode(F.array(*[F.col("dataset_id") + 100 * k for k in range(3)])).alias("dataset_id"), "label_id")
    return settle(requests, "requests"), settle(labels, "request-labels")


@query("g2_three_requests_per_study", _three_sql("NOT i.used_for_testing") + _TESTING_MOVES)
def _(d):
    return _moves(mb.make_testing_set(images(d), d.fx_dataset, *_three(d), SEED))


@query("g3_three_requests_per_study", _three_sql(_FRESH) + _TRAINING_MOVES + "drawn")
def _(d):
    return _moves(mb.make_training_set(images(d), d.fx_dataset, *_three(d), SEED))


# Previous training set of a study: dataset study * 10 + 2. The quota is what it leaves open.
_CARRIED = "(SELECT count(*) FROM fx_image c WHERE c.dataset_id = q.study_id * 10 + 2 AND c.label_id = q.label_id)"


@query(
    "g3_make_training_set_carry_over",
    _sample_sql(_FRESH, f"greatest(q.n - {_CARRIED}, 0)", "fx_generate_carry")
    + _TRAINING_MOVES
    + """(SELECT image_id, dataset_id, target, used_for_testing FROM drawn
UNION ALL SELECT i.image_id, i.dataset_id, q.target, i.used_for_testing FROM want q
  JOIN fx_image i ON i.dataset_id = q.study_id * 10 + 2 AND i.label_id = q.label_id
  WHERE q.target NOT IN (SELECT target FROM short)) m""",
)
def _(d):
    datasets = settle(d.fx_dataset_dated, "datasets")
    edit = mb.make_training_set(images(d), datasets, *_requests(d, "fx_generate_carry"), SEED, prior="latest")
    return _moves(edit)


# A second request in every study, for two of each label: it takes the ranks after the first one's, without a carry-over.
@query(
    "g3_carry_over_and_second_request",
    f"""WITH want AS (SELECT q.study_id, gl.label_id, greatest(q.n - (SELECT count(*) FROM fx_image c WHERE c.dataset_id = q.study_id * 10 + 2 AND c.label_id = gl.label_id), 0) AS n
  FROM fx_generate_carry q JOIN fx_generate_label gl ON gl.dataset_id = q.dataset_id),
pool AS (SELECT q.study_id, q.label_id, q.n, i.image_id, i.dataset_id, i.used_for_testing, row_number() OVER (PARTITION BY q.study_id, q.label_id ORDER BY {_ORDER.format(a='i')}) AS rk
  FROM want q JOIN fx_dataset d ON d.study_id = q.study_id AND d.base JOIN fx_image i ON i.dataset_id = d.dataset_id AND i.label_id = q.label_id WHERE {_FRESH}),
sizes AS (SELECT q.study_id, q.label_id, q.n, (SELECT count(*) FROM pool p WHERE p.study_id = q.study_id AND p.label_id = q.label_id) AS available FROM want q),
one AS (SELECT study_id, min(CASE WHEN available >= n THEN 1 ELSE 0 END) AS first FROM sizes GROUP BY ALL),
two AS (SELECT s.study_id, min(CASE WHEN s.available - o.first * s.n >= 2 THEN 1 ELSE 0 END) AS second FROM sizes s JOIN one o ON o.study_id = s.study_id GROUP BY ALL)
"""
    + _TRAINING_MOVES
    + """(SELECT p.image_id, p.dataset_id, CASE WHEN o.first = 1 AND p.rk <= p.n THEN 100 ELSE 200 END + p.study_id AS target, p.used_for_testing
  FROM pool p JOIN one o ON o.study_id = p.study_id JOIN two t ON t.study_id = p.study_id
  WHERE (o.first = 1 AND p.rk <= p.n) OR (t.second = 1 AND p.rk > o.first * p.n AND p.rk <= o.first * p.n + 2)
UNION ALL SELECT i.image_id, i.dataset_id, 100 + q.study_id, i.used_for_testing FROM want q JOIN one o ON o.study_id = q.study_id AND o.first = 1
  JOIN fx_image i ON i.dataset_id = q.study_id * 10 + 2 AND i.label_id = q.label_id) m""",
)
def _(d):
    datasets = settle(d.fx_dataset_dated, "datasets")
    requests, labels = _requests(d, "fx_generate_carry")
    later = F.col("dataset_id") + 100
    requests = settle(requests.unionByName(requests.withColumns({"dataset_id": later, "n": F.lit(2).cast("long")})), "requests")
    labels = settle(labels.unionByName(labels.withColumn("dataset_id", later)), "request-labels")
    return _moves(mb.make_training_set(images(d), datasets, requests, labels, SEED, prior="latest"))


# ---- copies by sample ----

_COPY_COLUMNS = "image_id, source_image_id, dataset_id, image_path, label_id, used_for_training, used_for_testing"


def _copies(edit):
    return edit.changes.withColumns({"dataset_id": F.col("dataset_id").cast("long")}).select(*_COPY_COLUMNS.split(", "))


def _sample_copy_sql(bases: str) -> str:
    return f"""WITH b AS ({bases}),
req AS (SELECT dataset_id, (SELECT max(dataset_id) FROM fx_dataset) + row_number() OVER (ORDER BY dataset_id) AS target FROM b),
want AS (SELECT r.*, dl.label_id FROM req r JOIN fx_dataset_label dl ON dl.dataset_id = r.dataset_id),
pool AS (SELECT w.target, w.label_id, i.image_id, i.image_path, row_number() OVER (PARTITION BY w.target, w.label_id ORDER BY {_ORDER.format(a='i')}) AS rk
  FROM want w JOIN fx_image i ON i.dataset_id = w.dataset_id AND i.label_id = w.label_id),
short AS (SELECT w.target FROM want w WHERE (SELECT count(*) FROM pool p WHERE p.target = w.target AND p.label_id = w.label_id) < 5)
SELECT (SELECT max(image_id) FROM fx_image) + row_number() OVER (ORDER BY target, image_id) AS image_id, image_id AS source_image_id,
  CAST(target AS BIGINT) AS dataset_id, image_path, label_id, FALSE AS used_for_training, FALSE AS used_for_testing
FROM pool WHERE rk <= 5 AND target NOT IN (SELECT target FROM short)"""


@query("g1_sample_copy", _sample_copy_sql("SELECT max(dataset_id) AS dataset_id FROM fx_dataset WHERE base"))
def _(d):
    return _copies(mb.sample_copy(images(d), d.fx_dataset, d.fx_dataset_label, 5, SEED))


@query(
    "g1_sample_copy_per_study",
    _sample_copy_sql("SELECT max(dataset_id) AS dataset_id FROM fx_dataset WHERE base GROUP BY study_id"),
)
def _(d):
    return _copies(mb.sample_copy(images(d), d.fx_dataset, d.fx_dataset_label, 5, SEED, per_study=True))


@query(
    "g1_sampled_datasets",
    """SELECT new_id AS dataset_id, concat('Dataset 5-', substr(md5(concat('7:', dataset_id, ':', new_id)), 1, 6)) AS name,
  resolution, base AND FALSE AS base, for_testing
FROM (SELECT *, (SELECT max(dataset_id) FROM fx_dataset) + row_number() OVER (ORDER BY dataset_id) AS new_id FROM fx_dataset
  WHERE dataset_id IN (SELECT max(dataset_id) FROM fx_dataset WHERE base GROUP BY study_id)) x""",
)
def _(d):
    edit = mb.sample_copy(images(d), d.fx_dataset, d.fx_dataset_label, 5, SEED, per_study=True)
    return edit.datasets.select("dataset_id", "name", "resolution", "base", "for_testing")


# ---- soft moves ----

_MOVE_REQUESTS = "SELECT study_id * 10 + 1 AS dataset_id, study_id * 10 + 2 AS target_id, n * 2 + 10 AS n FROM fx_generate"


@query(
    "g4_move_random",
    f"""WITH r AS ({_MOVE_REQUESTS}),
c AS (SELECT dataset_id, label_id, count(*) AS available FROM fx_image GROUP BY ALL),
t AS (SELECT dataset_id, sum(available) AS total FROM c GROUP BY ALL),
pool AS (SELECT i.*, r.target_id, r.n, row_number() OVER (PARTITION BY i.dataset_id, i.label_id ORDER BY {_ORDER.format(a='i')}) AS rk
  FROM fx_image i JOIN r ON r.dataset_id = i.dataset_id JOIN c ON c.dataset_id = i.dataset_id AND c.label_id = i.label_id
  JOIN t ON t.dataset_id = i.dataset_id JOIN fx_dataset_label dl ON dl.dataset_id = i.dataset_id AND dl.label_id = i.label_id
  WHERE c.available >= r.n AND t.total >= r.n)
SELECT image_id, CAST(dataset_id AS BIGINT) AS old_dataset_id, CAST(target_id AS BIGINT) AS new_dataset_id, TRUE AS used_for_training, used_for_testing
FROM pool WHERE rk <= n""",
)
def _(d):
    return _moves(mb.move_random(images(d), d.fx_dataset_label, settle(d.sql(_MOVE_REQUESTS), "requests"), SEED))


# Two requests on every base: the second one takes the next ranks of labels that last.
_SHARED_REQUESTS = """SELECT r.dataset_id, r.target_id + k AS target_id, r.n FROM (SELECT study_id * 10 + 1 AS dataset_id, study_id * 10 + 2 AS target_id,
  greatest(1, CAST(floor(n / 2.0E0) AS BIGINT)) AS n FROM fx_generate) r JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 900) t ON TRUE"""


@query(
    "g4_move_random_shared_base",
    f"""WITH r AS (SELECT DISTINCT dataset_id, n FROM ({_SHARED_REQUESTS})),
pool AS (SELECT i.*, r.n, row_number() OVER (PARTITION BY i.dataset_id, i.label_id ORDER BY {_ORDER.format(a='i')}) - 1 AS rk,
  count(*) OVER (PARTITION BY i.dataset_id, i.label_id) AS available
  FROM fx_image i JOIN r ON r.dataset_id = i.dataset_id JOIN fx_dataset_label dl ON dl.dataset_id = i.dataset_id AND dl.label_id = i.label_id)
SELECT image_id, CAST(dataset_id AS BIGINT) AS old_dataset_id, CAST(dataset_id + 1 + rk // n AS BIGINT) AS new_dataset_id, TRUE AS used_for_training, used_for_testing
FROM pool WHERE rk // n < 2 AND available >= (rk // n + 1) * n""",
)
def _(d):
    requests = settle(d.sql(_SHARED_REQUESTS), "requests")
    return _moves(mb.move_random(images(d), d.fx_dataset_label, requests, SEED, d.fx_dataset))


@query(
    "g4_rejected",
    f"""WITH r AS ({_SHARED_REQUESTS}),
c AS (SELECT dataset_id, max(available) AS most FROM (SELECT i.dataset_id, i.label_id, count(*) AS available FROM fx_image i
  JOIN fx_dataset_label dl ON dl.dataset_id = i.dataset_id AND dl.label_id = i.label_id GROUP BY ALL) GROUP BY ALL)
SELECT CAST(r.dataset_id AS BIGINT) AS dataset_id, CAST(r.target_id AS BIGINT) AS target_id, r.n FROM r LEFT JOIN c ON c.dataset_id = r.dataset_id
WHERE r.target_id > r.dataset_id + 2 OR coalesce(c.most, 0) < r.n * (r.target_id - r.dataset_id)""",
)
def _(d):
    requests = settle(d.sql(_SHARED_REQUESTS), "requests")
    rejected = mb.move_random(images(d), d.fx_dataset_label, requests, SEED, d.fx_dataset).rejected
    return rejected.select(F.col("dataset_id").cast("long"), F.col("target_id").cast("long"), "n")


# ---- clones by copy ----


def _study_requests(d, first_id: int):
    """Every study is cloned into the next one."""
    return d.sql(
        f"""SELECT r_regionkey AS old_study_id, (r_regionkey + 1) % 5 AS new_study_id, {first_id} + r_regionkey AS new_dataset_id,
  concat('clone of ', r_name) AS name FROM region"""
    )


def _copied_sql(where: str, flags: str, first_id: int = 200, target: str = "i.study_id") -> str:
    return f"""SELECT (SELECT max(image_id) FROM fx_image) + row_number() OVER (ORDER BY {target}, i.image_id) AS image_id, i.image_id AS source_image_id,
  CAST({first_id} + {target} AS BIGINT) AS dataset_id, i.image_path, i.label_id, {flags}
FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id WHERE {where}"""


_KEPT = "i.used_for_training, i.used_for_testing"
_RESET = "FALSE AS used_for_training, FALSE AS used_for_testing"


@query("g5_clone_base", _copied_sql("d.base", _KEPT))
def _(d):
    return _copies(mb.clone_base(images(d), d.fx_dataset, d.fx_dataset_label, _study_requests(d, 200)))


@query(
    "g5_cloned_base_datasets",
    """SELECT 200 + d.study_id AS dataset_id, (d.study_id + 1) % 5 AS study_id, concat('clone of ', r.r_name) AS name, d.resolution, TRUE AS base, FALSE AS for_testing,
  (SELECT string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) FROM fx_dataset_label dl WHERE dl.dataset_id = d.dataset_id) AS labels
FROM fx_dataset d JOIN region r ON r.r_regionkey = d.study_id WHERE d.base""",
)
def _(d):
    edit = mb.clone_base(images(d), d.fx_dataset, d.fx_dataset_label, _study_requests(d, 200))
    labels = edit.dataset_labels.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("label_id")), ",").alias("labels"))
    return edit.datasets.join(labels, "dataset_id")


@query("g6_clone_study", _copied_sql("TRUE", _RESET))
def _(d):
    return _copies(mb.clone_study(images(d), d.fx_dataset, d.fx_dataset_label, _study_requests(d, 200)))


@query(
    "g6_cloned_study_datasets",
    """SELECT 200 + d.study_id AS dataset_id, (d.study_id + 1) % 5 AS study_id, concat('clone of ', r.r_name) AS name, d.resolution, FALSE AS base, FALSE AS for_testing,
  (SELECT string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) FROM (SELECT DISTINCT x.study_id, dl.label_id FROM fx_dataset_label dl
     JOIN fx_dataset x ON x.dataset_id = dl.dataset_id) u WHERE u.study_id = d.study_id) AS labels
FROM fx_dataset d JOIN region r ON r.r_regionkey = d.study_id WHERE d.dataset_id % 10 = 1""",
)
def _(d):
    edit = mb.clone_study(images(d), d.fx_dataset, d.fx_dataset_label, _study_requests(d, 200))
    labels = edit.dataset_labels.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("label_id")), ",").alias("labels"))
    return edit.datasets.join(labels, "dataset_id")


_CLONE_REQUESTS = "SELECT dataset_id, (study_id + 1) % 5 AS new_study_id, 200 + dataset_id AS new_dataset_id FROM fx_dataset WHERE {where}"


@query("g9_clone_dataset", _copied_sql("TRUE", _KEPT, target="i.dataset_id"))
def _(d):
    return _copies(mb.clone_dataset(images(d), d.fx_dataset, d.fx_dataset_label, d.sql(_CLONE_REQUESTS.format(where="TRUE"))))


# ---- clones by file name ----


def _by_name_sql(where: str, columns: str, condition: str = "b.file_name = s.file_name") -> str:
    return f"""WITH req AS (SELECT dataset_id, (study_id + 1) % 5 AS new_study_id, 200 + dataset_id AS new_dataset_id FROM fx_dataset WHERE {where}),
img AS (SELECT *, regexp_extract(image_path, '[^/]*$') AS file_name FROM fx_image),
names AS (SELECT r.new_dataset_id, b.file_name, count(*) AS matches, min(b.image_id) AS base_image_id
  FROM req r JOIN fx_dataset d ON d.study_id = r.new_study_id AND d.base JOIN img b ON b.dataset_id = d.dataset_id GROUP BY ALL),
m AS (SELECT r.new_dataset_id, s.image_id, s.file_name, coalesce(n.matches, 0) AS matches, n.base_image_id
  FROM req r JOIN img s ON s.dataset_id = r.dataset_id LEFT JOIN names n ON n.new_dataset_id = r.new_dataset_id AND n.file_name = s.file_name),
own AS (SELECT base_image_id AS image_id, min(new_dataset_id) AS target FROM m WHERE matches = 1 GROUP BY ALL)
SELECT {columns}"""


_BY_NAME_MOVES = """i.image_id, CAST(i.dataset_id AS BIGINT) AS old_dataset_id, CAST(own.target AS BIGINT) AS new_dataset_id, {flags}
FROM own JOIN fx_image i ON i.image_id = own.image_id"""


def _testing_clone(d, mode="basename"):
    return mb.clone_testing_set(
        images(d), d.fx_dataset, d.fx_dataset_label, d.sql(_CLONE_REQUESTS.format(where="for_testing")), mode
    )


@query(
    "g7_clone_testing_set",
    _by_name_sql("for_testing", _BY_NAME_MOVES.format(flags="i.used_for_training, TRUE AS used_for_testing")),
)
def _(d):
    return _moves(_testing_clone(d))


@query("g7_clone_testing_set_by_suffix",
    # every file name starts with img_ and holds no other img_, so a suffix match is an equal name here
    _by_name_sql("for_testing", _BY_NAME_MOVES.format(flags="i.used_for_training, TRUE AS used_for_testing")),
)
def _(d):
    return _moves(_testing_clone(d, "suffix"))


@query(
    "g7_clone_ambiguous",
    _by_name_sql("for_testing", "CAST(new_dataset_id AS BIGINT) AS new_dataset_id, image_id, file_name, matches FROM m WHERE matches > 1"),
)
def _(d):
    found = _testing_clone(d).extra["ambiguous"]
    return found.withColumn("new_dataset_id", F.col("new_dataset_id").cast("long"))


@query(
    "g7_cloned_with_resolution",
    """SELECT 200 + dataset_id AS dataset_id, (study_id + 1) % 5 AS study_id, concat(name, '_clone') AS name, '512' AS resolution,
  FALSE AS base, TRUE AS for_testing FROM fx_dataset WHERE for_testing""",
)
def _(d):
    requests = d.sql(_CLONE_REQUESTS.format(where="for_testing")).withColumn("resolution", F.lit("512"))
    return mb.clone_testing_set(images(d), d.fx_dataset, d.fx_dataset_label, requests).datasets


def _training_clone(d):
    requests = d.sql(
        """SELECT dataset_id, (study_id + 1) % 5 AS new_study_id, 200 + dataset_id AS new_dataset_id, (study_id + 1) % 5 * 10 + 1 AS base_id
FROM fx_dataset WHERE NOT for_testing AND NOT base"""
    )
    return mb.clone_training_set(images(d), d.fx_dataset, d.fx_dataset_label, requests)


@query(
    "g8_clone_training_set",
    _by_name_sql("NOT for_testing AND NOT base", _BY_NAME_MOVES.format(flags="TRUE AS used_for_training, i.used_for_testing")),
)
def _(d):
    return _moves(_training_clone(d))


@query(
    "g8_cloned_shared",
    "SELECT 200 + dataset_id AS dataset_id, (study_id + 1) % 5 AS study_id FROM fx_dataset WHERE NOT for_testing AND NOT base",
)
def _(d):
    return _training_clone(d).dataset_shared


# ---- plain moves ----


@query(
    "g10_move_all",
    """SELECT i.image_id, CAST(i.dataset_id AS BIGINT) AS old_dataset_id, CAST(d.study_id * 10 + 1 AS BIGINT) AS new_dataset_id, i.used_for_training, i.used_for_testing
FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id WHERE NOT d.for_testing AND NOT d.base""",
)
def _(d):
    # testing sets are asked for too and must be refused
    requests = d.sql("SELECT dataset_id AS origin_id, study_id * 10 + 1 AS target_id FROM fx_dataset WHERE NOT base")
    return _moves(mb.move_all(images(d), d.fx_dataset, requests))


@query(
    "g10_move_all_shared_origin",
    """SELECT i.image_id, CAST(i.dataset_id AS BIGINT) AS old_dataset_id, CAST(d.study_id * 10 AS BIGINT) AS new_dataset_id, i.used_for_training, i.used_for_testing
FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id WHERE NOT d.for_testing AND NOT d.base
AND d.study_id * 10 IN (SELECT dataset_id FROM fx_dataset)
UNION ALL SELECT i.image_id, CAST(i.dataset_id AS BIGINT), CAST(d.study_id * 10 + 1 AS BIGINT), i.used_for_training, i.used_for_testing
FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id WHERE NOT d.for_testing AND NOT d.base
AND d.study_id * 10 NOT IN (SELECT dataset_id FROM fx_dataset)""",
)
def _(d):
    # two targets each; the smaller one that exists takes all
    requests = d.sql("SELECT dataset_id AS origin_id, study_id * 10 + k AS target_id FROM fx_dataset JOIN (SELECT 0 AS k UNION ALL SELECT 1) t ON TRUE WHERE NOT base")
    return _moves(mb.move_all(images(d), d.fx_dataset, requests))


@query(
    "g11_claim_unused",
    """SELECT image_id, CAST(CASE WHEN NOT used_for_training AND NOT used_for_testing THEN 12 ELSE dataset_id END AS BIGINT) AS dataset_id, label_id, image_path,
  used_for_training OR NOT used_for_testing AS used_for_training, used_for_testing FROM fx_image""",
)
def _(d):
    return mb.claim_unused(images(d), d.fx_dataset, 12).images


@query("g11_claimed_count", "SELECT count(*) AS updated FROM fx_image WHERE NOT used_for_training AND NOT used_for_testing")
def _(d):
    return mb.claim_unused(images(d), d.fx_dataset, 12).extra["count"]


_NEW_LABELS = "SELECT d.dataset_id, l.label_id FROM fx_dataset d JOIN fx_label l ON l.label_id <= 1 + d.study_id WHERE d.for_testing"


@query(
    "g12_set_labels",
    f"""SELECT dl.* FROM fx_dataset_label dl JOIN fx_dataset d ON d.dataset_id = dl.dataset_id WHERE NOT d.for_testing UNION ALL ({_NEW_LABELS})""",
)
def _(d):
    owners = d.fx_dataset.filter("for_testing")
    pairs = owners.select("dataset_id", F.explode(F.sequence(F.lit(1), F.col("study_id") + 1)).alias("label_id"))
    return rc.set_labels(d.fx_dataset_label, owners, pairs)


@query(
    "g12_set_shared",
    """SELECT s.* FROM fx_shared s JOIN fx_dataset d ON d.dataset_id = s.dataset_id WHERE d.for_testing
UNION ALL SELECT dataset_id, study_id FROM fx_dataset WHERE NOT for_testing""",
)
def _(d):
    owners = d.fx_dataset.filter(~F.col("for_testing"))
    return rc.set_shared(d.fx_shared, owners, owners.select("dataset_id", "study_id"))


@query(
    "g13_recycle_on_delete",
    """SELECT i.image_id, CAST(i.dataset_id AS BIGINT) AS old_dataset_id, CAST(d.study_id * 10 + 1 AS BIGINT) AS new_dataset_id,
  FALSE AS used_for_training, FALSE AS used_for_testing FROM fx_image i JOIN fx_dataset d ON d.dataset_id = i.dataset_id WHERE NOT d.base""",
)
def _(d):
    return _moves(mb.recycle_on_delete(images(d), d.fx_dataset, d.fx_dataset.filter(~F.col("base"))))


# ---- record keeping ----


def _all_tables(d):
    return {
        "study": d.sql("SELECT r_regionkey AS study_id FROM region"),
        "label": d.fx_label,
        "dataset": d.fx_dataset,
        "dataset_label": d.fx_dataset_label,
        "dataset_shared": d.fx_shared,
        "image": images(d),
        "model": d.fx_model,
        "session": d.fx_session,
        "epoch": d.fx_epoch.select("session_id", "number", (F.col("session_id") * 100 + F.col("number")).alias("epoch_id")),
        "test": d.fx_test,
        "result": d.sql("SELECT test_id, image_id, test_id * 1000000000 + image_id AS result_id FROM fx_result"),
    }


def _sizes(tables):
    parts = [df.groupBy().agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n")) for name, df in sorted(tables.items())]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "g14_cascade_delete_study",
    """WITH ds AS (SELECT * FROM fx_dataset WHERE study_id <> 2),
s AS (SELECT * FROM fx_session WHERE study_id <> 2 AND dataset_id IN (SELECT dataset_id FROM ds)),
t AS (SELECT * FROM fx_test WHERE dataset_id IN (SELECT dataset_id FROM ds) AND session_id IN (SELECT session_id FROM s))
SELECT 'dataset' AS entity, count(*) AS n FROM ds
UNION ALL SELECT 'dataset_label', count(*) FROM fx_dataset_label WHERE dataset_id IN (SELECT dataset_id FROM ds)
UNION ALL SELECT 'dataset_shared', count(*) FROM fx_shared WHERE study_id <> 2 AND dataset_id IN (SELECT dataset_id FROM ds)
UNION ALL SELECT 'epoch', count(*) FROM fx_epoch WHERE session_id NOT IN (SELECT session_id FROM fx_session WHERE session_id NOT IN (SELECT session_id FROM s))
UNION ALL SELECT 'image', count(*) FROM fx_image
UNION ALL SELECT 'label', count(*) FROM fx_label
UNION ALL SELECT 'model', count(*) FROM fx_model
UNION ALL SELECT 'result', count(*) FROM fx_result WHERE test_id IN (SELECT test_id FROM t)
UNION ALL SELECT 'session', count(*) FROM s
UNION ALL SELECT 'study', count(*) FROM region WHERE r_regionkey <> 2
UNION ALL SELECT 'test', count(*) FROM t""",
)
def _(d):
    tables = _all_tables(d)
    return _sizes(rc.cascade_delete(tables, "study", tables["study"].filter("study_id = 2")))


@query(
    "g14_cascade_delete_dataset_images",
    """SELECT image_id, CAST(CASE WHEN dataset_id % 10 = 3 THEN NULL ELSE dataset_id END AS BIGINT) AS dataset_id, label_id, image_path,
  used_for_training, used_for_testing FROM fx_image""",
)
def _(d):
    tables = _all_tables(d)
    return rc.cascade_delete(tables, "dataset", tables["dataset"].filter("for_testing"))["image"]


@query(
    "g14_cascade_delete_label",
    """SELECT r.test_id, count(*) AS n FROM fx_result r LEFT JOIN fx_image i ON i.image_id = r.image_id WHERE i.label_id IS NULL OR i.label_id <> 2 GROUP BY ALL""",
)
def _(d):
    tables = _all_tables(d)
    left = rc.cascade_delete(tables, "label", tables["label"].filter("label_id = 2"))
    return left["result"].groupBy("test_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g15_apply_status",
    """WITH u AS (SELECT session_id, arg_max(status, ts) AS status, max(ts) AS updated_at FROM fx_status_event GROUP BY ALL)
SELECT s.session_id, s.name, coalesce(u.status, s.status) AS status, u.updated_at FROM fx_session s LEFT JOIN u ON u.session_id = s.session_id""",
)
def _(d):
    updated = rc.apply_status(d.fx_session, d.fx_status_event, "session_id", tie="event_id")
    return updated.select("session_id", "name", "status", "updated_at")


@query(
    "g16_upsert",
    """SELECT coalesce(s.session_id, e.session_id) AS session_id, s.name, coalesce(e.status, s.status) AS status, s.duration_s,
  coalesce(t.created_at, CASE WHEN e.session_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END) AS created_at,
  CASE WHEN e.session_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE t.updated_at END AS updated_at
FROM (SELECT session_id, name, status, duration_s FROM fx_session) s
LEFT JOIN fx_session_time t ON t.session_id = s.session_id
FULL OUTER JOIN (SELECT session_id, arg_max(status, ts) AS status FROM fx_status_event GROUP BY ALL) e ON e.session_id = s.session_id""",
)
def _(d):
    table = d.fx_session.join(d.fx_session_time, "session_id", "left").select(
        "session_id", "name", "status", "duration_s", "created_at", "updated_at"
    )
    rows = rc.last_status(d.fx_status_event, "session_id", tie="event_id").select("session_id", "status")
    return rc.upsert(table, rows, "session_id", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
