"""Queries over the training of all pending sessions.

The SQL twins take every step of two epochs by recursion, for each block from the same head, and average the blocks.
Sessions have one or two epochs with batches of 16 or 32, by their model.
"""

from pyspark.sql import functions as F

from tallyweave.operators import training as tr
from tallyweave.operators.preparation import PRIME
from tallyweave.plans.registry import query

WIDTH = 64
#: Blocks of 256 rows, so that sessions have several of them on the given tables.
HOW = tr.Descent(lr=0.05, block_values=256 * WIDTH)
KEEP = 1 - HOW.dropout
SHARP = 1 - HOW.smoothing


def _stirred(x: str, key: str) -> str:
    moved = f"(({x}) + {key}) % {PRIME}"
    return f"(({moved}) * ({moved}) % {PRIME} * 48271 + 12345) % {PRIME}"


_ORDER_DRAW = _stirred("b", "17")
_INPUT_DRAW = _stirred("f", "31")

_ASKED = """s AS (SELECT session_id, name, dataset_id, 1 + model_id % 2 AS epochs, 16 * (1 + model_id % 2) AS batch FROM fx_session WHERE status = 'Pending'),
img AS (SELECT i.image_id, i.dataset_id, lower(i.label_name) AS slug, f.features FROM fx_image i LEFT JOIN fx_image_feature f ON f.image_id = i.image_id
  WHERE i.dataset_id IN (SELECT dataset_id FROM s)),
fig AS (SELECT dataset_id, count(*) AS n, count(*) - count(features) AS bare, array_to_string(list_sort(list(DISTINCT slug)), ', ') AS class_names FROM img GROUP BY ALL),
asked AS (SELECT s.*, f.n, CAST(f.n - floor(f.n * 0.2E0) AS BIGINT) AS training, f.class_names, CASE WHEN f.n IS NULL THEN 'dataset has no images'
  WHEN f.bare > 0 THEN 'image has no features' WHEN f.n - floor(f.n * 0.2E0) < s.batch THEN 'fewer training images than a batch' END AS reason
  FROM s LEFT JOIN fig f ON f.dataset_id = s.dataset_id)"""

_CELLS = f"""cls AS (SELECT dataset_id, slug, row_number() OVER (PARTITION BY dataset_id ORDER BY slug) - 1 AS class_idx FROM (SELECT DISTINCT dataset_id, slug FROM img) x),
placed AS (SELECT i.*, c.class_idx, row_number() OVER (PARTITION BY i.dataset_id ORDER BY md5(concat('123:', CAST(i.image_id AS VARCHAR))), i.image_id) AS position
  FROM img i JOIN cls c ON c.dataset_id = i.dataset_id AND c.slug = i.slug),
dealt AS (SELECT a.session_id, a.batch, a.epochs, p.image_id, p.class_idx, p.features, a.n - a.training AS held, p.position - a.training AS late,
    least((p.position - 1) // a.size, greatest(a.training // a.size, 1) - 1) AS block
  FROM (SELECT *, batch * greatest(1, {HOW.block_values} // ({WIDTH} * batch)) AS size FROM asked WHERE reason IS NULL) a
  JOIN placed p ON p.dataset_id = a.dataset_id),
sized AS (SELECT *, count(*) OVER (PARTITION BY session_id, block) AS m FROM dealt WHERE late <= 0),
pass1 AS (SELECT *, {_stirred(f"image_id % {PRIME}", "session_id")} AS a FROM sized, (SELECT unnest(range(0, 2)) AS pass) p),
pass2 AS (SELECT *, {_stirred("a", "pass")} AS b FROM pass1),
pass3 AS (SELECT *, {_ORDER_DRAW} AS draw FROM pass2),
pass4 AS (SELECT *, pass * ((m + batch - 1) // batch)
    + (row_number() OVER (PARTITION BY session_id, block, pass ORDER BY draw, image_id) - 1) // batch AS place FROM pass3),
wide AS (SELECT session_id, block, place // (m // batch) AS epoch, place % (m // batch) AS t, image_id, class_idx, draw,
    unnest(range(0, {WIDTH + 1})) AS pos, unnest(list_append(CAST(features AS DOUBLE[]), 1.0E0)) AS v FROM pass4 WHERE place // (m // batch) < epochs),
mixed AS (SELECT *, {_stirred("draw", "(pos + 1) * 104729")} AS f FROM wide),
cell AS MATERIALIZED (SELECT session_id, block, epoch, t, image_id, class_idx, pos,
    CASE WHEN pos = {WIDTH} THEN 1.0E0 WHEN {_INPUT_DRAW} >= CAST({HOW.dropout} AS DOUBLE) * {PRIME} THEN v / CAST({KEEP} AS DOUBLE) ELSE 0.0E0 END AS x FROM mixed),
held AS MATERIALIZED (SELECT session_id, 0 AS block, 0 AS t, image_id, class_idx, unnest(range(0, {WIDTH + 1})) AS pos,
    unnest(list_append(CAST(features AS DOUBLE[]), 1.0E0)) AS x FROM dealt WHERE late > 0 AND late <= held // batch * batch),
head0 AS MATERIALIZED (SELECT a.session_id, c.class_idx AS cls, p.pos, 0.0E0 AS w, 0.0E0 AS v FROM asked a JOIN cls c ON c.dataset_id = a.dataset_id,
  (SELECT unnest(range(0, {WIDTH + 1})) AS pos) p WHERE a.reason IS NULL)"""


def _gaps(states: str, cells: str) -> str:
    """For each row met and class: probability, its logarithm and target, with the head as it was at that step."""
    row = "PARTITION BY session_id, block, t, image_id"
    return f"""SELECT *, z - top - ln(sum(exp(z - top)) OVER ({row})) AS log_p,
      {HOW.smoothing}E0 / count(*) OVER ({row}) + CASE WHEN cls = class_idx THEN {SHARP}E0 ELSE 0.0E0 END AS target
    FROM (SELECT *, max(z) OVER ({row}) AS top FROM (
      SELECT r.session_id, r.block, r.t, c.image_id, c.class_idx, r.cls, sum(r.w * c.x) AS z FROM {states} r JOIN {cells} c
      ON c.session_id = r.session_id AND c.block = r.block AND c.t = r.t AND c.pos = r.pos GROUP BY ALL) logits) topped"""


def _judged(states: str, cells: str) -> str:
    """Per session the share of hits and the mean loss, each row with the penalty of the head it met."""
    return f"""SELECT z.session_id, avg(z.hit) AS accuracy, avg(z.loss + {HOW.l2} * s.squares) AS loss FROM (
    SELECT session_id, block, t, image_id, CASE WHEN arg_max(cls, (z, -cls)) = any_value(class_idx) THEN 1.0E0 ELSE 0.0E0 END AS hit,
      -sum(log_p * target) AS loss FROM ({_gaps(states, cells)}) g GROUP BY session_id, block, t, image_id) z
  JOIN (SELECT session_id, block, t, sum(CASE WHEN pos < {WIDTH} THEN w * w ELSE 0 END) AS squares FROM {states} x GROUP BY ALL) s
    ON s.session_id = z.session_id AND s.block = z.block AND s.t = z.t GROUP BY z.session_id"""


def _epoch(e: int) -> str:
    """From ``head{e}`` the states after every step, the averaged ``head{e + 1}`` and the figures of the epoch."""
    step = "session_id = r.session_id AND {0}.block = r.block AND {0}.t = r.t"
    return f"""cell{e} AS MATERIALIZED (SELECT * FROM cell WHERE epoch = {e}),
size{e} AS MATERIALIZED (SELECT session_id, block, t, count(DISTINCT image_id) AS n FROM cell{e} GROUP BY ALL),
run{e} AS (SELECT b.session_id, b.block, CAST(0 AS BIGINT) AS t, h.cls, h.pos, h.w, h.v
    FROM (SELECT DISTINCT session_id, block FROM cell{e}) b JOIN head{e} h ON h.session_id = b.session_id
  UNION ALL
  SELECT session_id, block, t + 1, cls, pos, w + speed, speed FROM (
    SELECT r.session_id, r.block, r.t, r.cls, r.pos, r.w,
      {HOW.momentum} * r.v - {HOW.lr} * (q.g / s.n + CASE WHEN r.pos < {WIDTH} THEN 2 * {HOW.l2} * r.w ELSE 0 END) AS speed
    FROM run{e} r JOIN size{e} s ON s.{step.format("s")}
    JOIN (SELECT p.session_id, p.block, p.t, p.cls, c.pos, sum((exp(p.log_p) - p.target) * c.x) AS g
      FROM ({_gaps(f"run{e}", f"cell{e}")}) p JOIN cell{e} c
        ON c.session_id = p.session_id AND c.block = p.block AND c.t = p.t AND c.image_id = p.image_id
      GROUP BY p.session_id, p.block, p.t, p.cls, c.pos) q
    ON q.{step.format("q")} AND q.cls = r.cls AND q.pos = r.pos) moved),
states{e} AS MATERIALIZED (SELECT * FROM run{e}),
head{e + 1} AS MATERIALIZED (SELECT f.session_id, f.cls, f.pos, sum(f.w * n.n) / sum(n.n) AS w, sum(f.v * n.n) / sum(n.n) AS v FROM states{e} f
  JOIN (SELECT session_id, block, max(t) + 1 AS steps, sum(n) AS n FROM size{e} GROUP BY ALL) n
    ON n.session_id = f.session_id AND n.block = f.block AND n.steps = f.t GROUP BY ALL),
kept{e} AS (SELECT *, 0 AS block, 0 AS t FROM head{e + 1}),
seen{e} AS ({_judged(f"states{e}", f"cell{e}")}),
val{e} AS ({_judged(f"kept{e}", "held")})"""


_TRAINED = f"WITH RECURSIVE {_ASKED},\n{_CELLS},\n{_epoch(0)},\n{_epoch(1)}"


def _trained(d) -> tr.Trained:
    more = F.col("model_id") % 2
    settings = {"epochs": 1 + more, "batch_size": 16 * (1 + more), "validation_split": F.lit(0.2)}
    return tr.train_sessions(d.fx_session.withColumns(settings), d.fx_image, d.fx_image_feature, d.fx_label, HOW)


@query(
    "k7_train_weights",
    f"""SELECT * FROM ({_TRAINED},
final AS (SELECT h.* FROM head2 h UNION ALL SELECT h.* FROM head1 h JOIN s ON s.session_id = h.session_id WHERE s.epochs = 1)
SELECT f.session_id, replace(lower(a.name), ' ', '_') AS session_slug, CAST(f.cls AS INTEGER) AS class_idx, c.slug AS class_name, CAST(f.pos AS INTEGER) AS pos,
  round(f.w, 6) + 0 AS w FROM final f JOIN asked a ON a.session_id = f.session_id JOIN cls c ON c.dataset_id = a.dataset_id AND c.class_idx = f.cls) q""",
)
def _(d):
    # the bias is the last position
    cells = F.posexplode(F.concat("w", F.array("b"))).alias("pos", "w")
    return _trained(d).weights.select("session_id", "session_slug", "class_idx", "class_name", cells).withColumn("w", F.round("w", 6) + 0)


@query(
    "k7_train_epochs",
    f"""SELECT * FROM ({_TRAINED}
SELECT session_id, number, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss, round(val_accuracy, 6) AS val_accuracy, round(val_loss, 6) AS val_loss FROM (
  SELECT t.*, 1 AS number, v.accuracy AS val_accuracy, v.loss AS val_loss FROM seen0 t LEFT JOIN val0 v ON v.session_id = t.session_id
  UNION ALL SELECT t.*, 2, v.accuracy, v.loss FROM seen1 t LEFT JOIN val1 v ON v.session_id = t.session_id) x) q""",
)
def _(d):
    figures = ("accuracy", "loss", "val_accuracy", "val_loss")
    return _trained(d).epochs.select("session_id", "number", *[F.round(c, 6).alias(c) for c in figures])


@query(
    "k7_train_status",
    f"WITH {_ASKED} SELECT session_id, CASE WHEN reason IS NULL THEN 'Completed' ELSE 'Failed' END AS status, class_names, reason FROM asked",
)
def _(d):
    return _trained(d).updates
