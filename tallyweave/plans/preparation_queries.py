"""Queries over the split and the batch plans."""

from pyspark.sql import functions as F

from tallyweave.operators import preparation as pp
from tallyweave.plans.registry import query
from tallyweave.session import settle

_SPLIT = """WITH r AS (SELECT image_id, dataset_id, row_number() OVER (ORDER BY md5(concat('123:', CAST(image_id AS VARCHAR))), image_id) AS rk, count(*) OVER () AS n
  FROM fx_image),
s AS (SELECT image_id, CASE WHEN rk > n - floor(n * 0.2E0) THEN 'validation' ELSE 'training' END AS split,
  CASE WHEN rk > n - floor(n * 0.2E0) THEN rk - (n - CAST(floor(n * 0.2E0) AS BIGINT)) ELSE rk END AS position FROM r)
"""


# Rounds of the permutation: the place a goes to its mirror image if a hash of the larger of both is odd.
_OTHER = "((y.m - x.a + t.n) % t.n)"
_HASH = f"((greatest(x.a, {_OTHER}) % {pp.PRIME} * y.f + y.a) % {pp.PRIME})"
_SWAP = f"CASE WHEN ((({_HASH} * {_HASH} + y.a) % {pp.PRIME}) >> 12) % 2 = 1 THEN {_OTHER} ELSE x.a END"
_KEYS = f""", size AS (SELECT count(*) AS n FROM s WHERE split = 'training'),
hashed AS (SELECT pass, i, n, md5(concat('123:', pass, ':', i)) AS h FROM size, (SELECT unnest(range(1, 4)) AS pass) a, (SELECT unnest(range(1, {pp.SHUFFLE_ROUNDS + 1})) AS i) b),
keyed AS (SELECT pass, list({{'m': CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % n, 'f': CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % {pp.PRIME},
  'a': CAST(('0x' || substr(h, 17, 8)) AS BIGINT) % {pp.PRIME}}} ORDER BY i) AS keys FROM hashed GROUP BY pass)"""


def _split(d):
    return pp.train_val_split(d.fx_image.select("image_id"), 0.2)


def _stored_split(d):
    """The plans read a split that was stored once, as a training run would."""
    return settle(_split(d), "split")


@query("i1_train_val_split", _SPLIT + "SELECT image_id, split, position FROM s")
def _(d):
    return _split(d)


@query(
    "i1_split_per_dataset",
    """WITH r AS (SELECT image_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY md5(concat('123:', CAST(image_id AS VARCHAR))), image_id) AS rk,
  count(*) OVER (PARTITION BY dataset_id) AS n FROM fx_image WHERE dataset_id IS NOT NULL)
SELECT dataset_id, image_id, CASE WHEN rk > n - floor(n * 0.2E0) THEN 'validation' ELSE 'training' END AS split FROM r""",
)
def _(d):
    images = d.fx_image.filter("dataset_id IS NOT NULL").select("dataset_id", "image_id")
    return pp.train_val_split(images, 0.2, by=["dataset_id"]).select("dataset_id", "image_id", "split")


@query(
    "i2_step_counts",
    _SPLIT
    + """SELECT CAST(count(*) FILTER (WHERE split = 'training') // 16 AS BIGINT) AS steps,
  CAST(count(*) FILTER (WHERE split = 'validation') // 16 AS BIGINT) AS val_steps FROM s""",
)
def _(d):
    return pp.step_counts(_stored_split(d), 16)


@query(
    "i3_batch_plan",
    _SPLIT
    + f"""{_KEYS}, t AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('123:', CAST(image_id AS VARCHAR))), image_id) - 1 AS r, count(*) OVER () AS n
  FROM s WHERE split = 'training'),
p AS (SELECT t.image_id, t.n, k.pass, list_reduce(list_prepend({{'m': CAST(0 AS BIGINT), 'f': CAST(0 AS BIGINT), 'a': CAST(t.r AS BIGINT)}}, k.keys),
  lambda x, y: {{'m': CAST(0 AS BIGINT), 'f': CAST(0 AS BIGINT), 'a': {_SWAP}}}).a AS rk FROM t, keyed k),
g AS (SELECT image_id, rk, n // 13 AS steps, (pass - 1) * ((n + 12) // 13) + rk // 13 AS nth FROM p)
SELECT CAST(nth // steps + 1 AS INT) AS epoch, nth % steps + 1 AS step, rk % 13 + 1 AS slot, image_id FROM g WHERE nth < 3 * steps""",
)
def _(d):
    # 13 does not divide the number of images, so the short batches move the epoch borders
    return pp.batch_plan(_stored_split(d).filter("split = 'training'").select("image_id"), epochs=3, batch=13)


@query(
    "i4_val_batches",
    _SPLIT
    + """, v AS (SELECT image_id, position, count(*) OVER () // 16 AS steps FROM s WHERE split = 'validation')
SELECT (position - 1) // 16 + 1 AS step, (position - 1) % 16 + 1 AS slot, image_id FROM v WHERE (position - 1) // 16 + 1 <= steps""",
)
def _(d):
    return pp.val_batches(_stored_split(d), 16)
