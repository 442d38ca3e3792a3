"""Queries over image preparation, augmentation and saliency."""

import math

from pyspark.sql import functions as F

from tallyweave.operators import head as hd
from tallyweave.operators import raster as rs
from tallyweave.operators.preparation import PRIME
from tallyweave.plans.head_queries import _SCORED_SESSIONS, session_rows
from tallyweave.plans.registry import query


def _cells(rasters, digits=4, *keys):
    """One row per pixel value, for comparison."""
    return rasters.select("image_id", *keys, F.posexplode("px").alias("pos", "v")).withColumn(
        "v", F.round(F.col("v").cast("double"), digits)
    )


def _cells_sql(source: str, size: int, value: str, digits: int = 4) -> str:
    """``value`` computes the value at the 0-based position k from the list px; u(...) gives a draw."""
    return f"""SELECT image_id, CAST(k AS INT) AS pos, round(CAST(CAST({value} AS FLOAT) AS DOUBLE), {digits}) AS v
FROM (SELECT *, unnest(range({size})) AS k FROM {source}) x"""


def _draw(op: str, epoch: int = 1) -> str:
    return f"(CAST('0x' || substr(md5(concat('123:{epoch}:{op}:', CAST(image_id AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0E0)"


_KEYS = ["image_id", "h", "w", "c", "px"]
_OVER_WHITE = "floor((px[(k//3)*4 + k%3 + 1] * px[(k//3)*4 + 4] + 255 * (255 - px[(k//3)*4 + 4]) + 127) / 255)"


def _gray(d):
    return d.fx_gray.select(*_KEYS)


def _rgba(d):
    return d.fx_rgba.select(*_KEYS)


@query("r1_flatten_alpha", _cells_sql("fx_rgba", 48, _OVER_WHITE))
def _(d):
    return _cells(rs.flatten_alpha(_rgba(d)))


@query("r2_rescale", _cells_sql("fx_gray", 64, "px[k + 1] * (1 / 255.0E0)", 6))
def _(d):
    return _cells(rs.resize_rescale(_gray(d), 8), 6)


@query("r2_resize_nearest", _cells_sql("fx_gray", 16, "px[(k//4*2 + 1)*8 + k%4*2 + 2]"))
def _(d):
    return _cells(rs.resize_rescale(_gray(d), 4, "nearest", 1.0))


@query(
    "r2_resize_bilinear",
    _cells_sql("fx_gray", 16, "(px[k//4*16 + k%4*2 + 1] + px[k//4*16 + k%4*2 + 2] + px[k//4*16 + k%4*2 + 9] + px[k//4*16 + k%4*2 + 10]) / 4"),
)
def _(d):
    return _cells(rs.resize_rescale(_gray(d), 4, "bilinear", 1.0))


def _augmented(d, source, digits=4, **switches):
    return _cells(rs.augment(source, rs.Augmentation(**switches)), digits)


_X, _Y = "(k%8)", "(k//8)"


@query("r3_horizontal_flip", _cells_sql("fx_gray", 64, f"CASE WHEN {_draw('horizontal_flip')} < 0.5 THEN px[{_Y}*8 + 8 - {_X}] ELSE px[k + 1] END"))
def _(d):
    return _augmented(d, _gray(d), horizontal_flip=True)


@query("r3_vertical_flip", _cells_sql("fx_gray", 64, f"CASE WHEN {_draw('vertical_flip')} < 0.5 THEN px[(7 - {_Y})*8 + {_X} + 1] ELSE px[k + 1] END"))
def _(d):
    return _augmented(d, _gray(d), vertical_flip=True)


_WHITE = f"(SELECT image_id, list_transform(range(48), lambda k: {_OVER_WHITE}) AS px FROM fx_rgba)"
_LUMA = "(px[k//3*3 + 1] * 0.2989E0 + px[k//3*3 + 2] * 0.5870E0 + px[k//3*3 + 3] * 0.1140E0)"


@query("r3_grayscale", _cells_sql(_WHITE, 48, _LUMA, 3))
def _(d):
    return _augmented(d, rs.flatten_alpha(_rgba(d)), 3, grayscale=True)


@query("r3_random_grayscale", _cells_sql(_WHITE, 48, f"CASE WHEN {_draw('random_grayscale')} < 0.5 THEN {_LUMA} ELSE px[k + 1] END", 3))
def _(d):
    return _augmented(d, rs.flatten_alpha(_rgba(d)), 3, random_grayscale=True)


# Brightness shifts and clips, contrast stretches around the picture's mean and clips; clip_max 255 keeps the figures apart.
_BRIGHT = f"(SELECT image_id, list_transform(px, lambda v: least(greatest(v + (2 * {_draw('brightness')} - 1) * 0.1E0 * 255, 0), 255)) AS px FROM fx_gray)"


@query(
    "r3_brightness_contrast",
    _cells_sql(
        _BRIGHT, 64,
        f"least(greatest((px[k + 1] - list_avg(px)) * (1 + (2 * {_draw('contrast')} - 1) * 0.1E0) + list_avg(px), 0), 255)", 3,
    ),
)
def _(d):
    return _augmented(d, _gray(d), 3, brightness_contrast=True, clip_max=255.0)


@query("r3_clip", _cells_sql("fx_gray", 64, "1"))
def _(d):
    # the default clip to 1 saturates these pictures, none of whose pixels is near 0
    return _augmented(d, _gray(d), brightness_contrast=True)


def _blur_sql() -> str:
    raw = [math.exp(-(i * i) / (2 * 0.7**2)) for i in (-1, 0, 1)]
    weights = [r / sum(raw) for r in raw]
    mirror = lambda at: f"(7 - abs(7 - abs({at})))"
    terms = [
        f"{weights[i + 1] * weights[j + 1]!r}E0 * px[{mirror(f'{_Y} + {i}')}*8 + {mirror(f'{_X} + {j}')} + 1]"
        for i in (-1, 0, 1)
        for j in (-1, 0, 1)
    ]
    return " + ".join(terms)


@query("r3_blur", _cells_sql("fx_gray", 64, _blur_sql(), 3))
def _(d):
    return _augmented(d, _gray(d), 3, blur=True)


_CUT_ROW, _CUT_COLUMN = f"floor({_draw('cutout_row')} * 8)", f"floor({_draw('cutout_column')} * 8)"


@query(
    "r3_cutout",
    _cells_sql(
        "fx_gray", 64,
        f"CASE WHEN {_Y} >= {_CUT_ROW} - 2 AND {_Y} < {_CUT_ROW} + 2 AND {_X} >= {_CUT_COLUMN} - 2 AND {_X} < {_CUT_COLUMN} + 2 THEN 0 ELSE px[k + 1] END",
    ),
)
def _(d):
    return _augmented(d, _gray(d), cutout=True, cutout_size=4)


# The steps below state each new value of an 8 x 8 picture by the places it is read from: a step takes a source of
# (image_id, px) and gives another, so that steps can be chained.
def _each(value: str) -> str:
    return f"list_transform(range(64), lambda k: {value})"


def _within(op: str, reach: str, epoch: int) -> str:
    return f"(2 * {_draw(op, epoch)} - 1) * {reach}"


def _mirrored(at: str) -> str:
    turned = f"({at} + 0.5E0 - 16 * floor(({at} + 0.5E0) / 16))"
    return f"least(greatest(CASE WHEN {turned} < 8 THEN {turned} ELSE 16 - {turned} END - 0.5E0, 0), 7)"


def _read(source: str, row: str, column: str, mirror: bool, **draws: str) -> str:
    """Values read between four pixels at (row, column), which may use the named draws."""
    named = "".join(f", {value} AS {name}" for name, value in draws.items())
    at = _mirrored if mirror else (lambda x: x)
    corner = lambda r, c: f"px[CAST({r} * 8 + {c} + 1 AS INTEGER)]"
    r, c = "rs[k + 1]", "cs[k + 1]"
    r0, c0 = f"floor({r})", f"floor({c})"
    r1, c1 = f"least({r0} + 1, 7)", f"least({c0} + 1, 7)"
    along = lambda row: f"({corner(row, c0)} * (1 - ({c} - {c0})) + {corner(row, c1)} * ({c} - {c0}))"
    value = f"{along(r0)} * (1 - ({r} - {r0})) + {along(r1)} * ({r} - {r0})"
    return f"""(SELECT image_id, {_each(value)} AS px FROM (SELECT image_id, px, {_each(at("(" + row + ")"))} AS rs, {_each(at("(" + column + ")"))} AS cs
  FROM (SELECT image_id, px{named} FROM {source} s) named) placed)"""


def _rotated(source: str, epoch: int = 1) -> str:
    angle = _within("random_rotation", f"{rs.ROTATION_TURNS * 2 * math.pi!r}E0", epoch)
    return _read(
        source, f"cos(a) * ({_Y} - 3.5E0) + sin(a) * ({_X} - 3.5E0) + 3.5E0", f"cos(a) * ({_X} - 3.5E0) - sin(a) * ({_Y} - 3.5E0) + 3.5E0", True, a=angle
    )


def _zoomed(source: str, epoch: int = 1) -> str:
    rows, columns = _within("zoom_height", "0.05E0", epoch), _within("zoom_width", "0.15E0", epoch)
    return _read(source, f"({_Y} - 3.5E0) * (1 + a) + 3.5E0", f"({_X} - 3.5E0) * (1 + b) + 3.5E0", True, a=rows, b=columns)


def _cropped(source: str, epoch: int = 1, pixels: int = 3) -> str:
    side = 8 - pixels
    inside = lambda at: f"least(greatest(({at} + 0.5E0) * {side} / 8 - 0.5E0, 0), {side - 1})"
    corner = {name: f"floor({_draw(op, epoch)} * {pixels + 1})" for name, op in (("a", "crop_top"), ("b", "crop_left"))}
    return _read(source, f"a + {inside(_Y)}", f"b + {inside(_X)}", False, **corner)


def _stirred(x: str, key: str) -> str:
    moved = f"((({x}) + {key}) % {PRIME})"
    return f"(({moved} * {moved} % {PRIME} * 48271 + 12345) % {PRIME})"


def _noisy(source: str, epoch: int = 1) -> str:
    seed = f"CAST({_draw('gaussian_noise', epoch)} * 4294967296.0E0 AS BIGINT) % {PRIME}"
    mixed = _each(_stirred(_stirred("a", f"k * {rs.NOISE_STRIDE}"), "17"))
    drawn = f"sqrt(-2 * ln(({_stirred('m[k + 1]', '31')} + 0.5E0) / {PRIME})) * cos({2 * math.pi!r}E0 * {_stirred('m[k + 1]', '53')} / {PRIME})"
    return f"""(SELECT image_id, {_each(f"px[k + 1] + {rs.NOISE_SIGMA}E0 * {drawn}")} AS px
  FROM (SELECT *, {mixed} AS m FROM (SELECT image_id, px, {seed} AS a FROM {source} s) seeded) mixed)"""


def _chained(epoch: int) -> str:
    """All steps on grey pictures, for which the random turn to grey does nothing."""
    step = lambda source, value, **draws: (
        f"(SELECT image_id, {_each(value)} AS px FROM (SELECT image_id, px{''.join(f', {v} AS {n}' for n, v in draws.items())} FROM {source} s) named)"
    )
    clipped = lambda value: f"least(greatest({value}, 0), 255)"
    px = step("fx_gray", f"CASE WHEN a < 0.5 THEN px[{_Y}*8 + 8 - {_X}] ELSE px[k + 1] END", a=_draw("horizontal_flip", epoch))
    px = step(px, f"CASE WHEN a < 0.5 THEN px[(7 - {_Y})*8 + {_X} + 1] ELSE px[k + 1] END", a=_draw("vertical_flip", epoch))
    px = _zoomed(_rotated(px, epoch), epoch)
    px = step(px, clipped("px[k + 1] + a * 255"), a=_within("brightness", "0.1E0", epoch))
    px = step(px, clipped("(px[k + 1] - m) * (1 + a) + m"), a=_within("contrast", "0.1E0", epoch), m="list_avg(px)")
    px = step(_noisy(_cropped(px, epoch), epoch), _blur_sql())
    reach = f"{_Y} >= a - 2 AND {_Y} < a + 2 AND {_X} >= b - 2 AND {_X} < b + 2"
    rows, columns = (f"floor({_draw(op, epoch)} * 8)" for op in ("cutout_row", "cutout_column"))
    return step(px, f"CASE WHEN {reach} THEN 0 ELSE px[k + 1] END", a=rows, b=columns)


@query("r3_rotation", _cells_sql(_rotated("fx_gray"), 64, "px[k + 1]", 3))
def _(d):
    return _augmented(d, _gray(d), 3, random_rotation=True)


@query("r3_zoom", _cells_sql(_zoomed("fx_gray"), 64, "px[k + 1]", 3))
def _(d):
    return _augmented(d, _gray(d), 3, zoom=True)


@query("r3_random_crop", _cells_sql(_cropped("fx_gray"), 64, "px[k + 1]", 3))
def _(d):
    return _augmented(d, _gray(d), 3, random_crop=True, crop_pixels=3)


@query("r3_gaussian_noise", _cells_sql(_noisy("fx_gray"), 64, "px[k + 1]", 3))
def _(d):
    return _augmented(d, _gray(d), 3, gaussian_noise=True)


@query(
    "r3_augment_chain_grey",
    " UNION ALL ".join(f"SELECT *, CAST({e} AS INT) AS epoch FROM ({_cells_sql(_chained(e), 64, 'px[k + 1]', 3)}) e{e}" for e in (1, 2)),
)
def _(d):
    config = rs.Augmentation(
        random_grayscale=True, horizontal_flip=True, vertical_flip=True, random_rotation=True, zoom=True, brightness_contrast=True,
        random_crop=True, gaussian_noise=True, blur=True, cutout=True, clip_max=255.0, crop_pixels=3, cutout_size=4,
    )
    return _cells(rs.augment(_gray(d), config, epochs=2), 3, "epoch")


@query("r3_augment_chain")
def _(d):
    config = rs.Augmentation(
        grayscale=False, random_grayscale=True, horizontal_flip=True, vertical_flip=True, random_rotation=True, zoom=True,
        brightness_contrast=True, random_crop=True, gaussian_noise=True, blur=True, cutout=True, clip_max=255.0,
        crop_pixels=2, cutout_size=2,
    )
    return rs.augment(rs.flatten_alpha(_rgba(d)), config, epochs=2).select(
        "image_id", "epoch", F.posexplode("px").alias("pos", "v")
    )


def _edges_sql(source: str) -> str:
    """``source`` gives (image_id, pos, v) of 8 x 8 maps."""
    return f"""raw AS ({source}),
span AS (SELECT image_id, min(v) AS low, max(v) - min(v) AS reach FROM raw GROUP BY ALL),
m AS (SELECT r.image_id, r.pos // 8 AS y, r.pos % 8 AS x, CASE WHEN s.reach > 0 THEN (r.v - s.low) / s.reach ELSE 0 END AS v
  FROM raw r JOIN span s ON s.image_id = r.image_id),
off AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
grad AS (SELECT c.image_id, c.y, c.x, any_value(c.v) AS v, sum(n.v * o.dy * (2 - abs(o.dx))) AS gy, sum(n.v * o.dx * (2 - abs(o.dy))) AS gx
  FROM m c, off o JOIN m n ON n.image_id = c.image_id AND n.y = least(greatest(c.y + o.dy, 0), 7) AND n.x = least(greatest(c.x + o.dx, 0), 7)
  GROUP BY c.image_id, c.y, c.x),
e AS (SELECT image_id, y, x, v + sqrt(gy * gy + gx * gx) AS v FROM grad),
espan AS (SELECT image_id, min(v) AS low, max(v) - min(v) AS reach FROM e GROUP BY ALL)
SELECT e.image_id, CAST(e.y * 8 + e.x AS INT) AS pos, round(CAST(CAST(CASE WHEN s.reach > 0 THEN (e.v - s.low) / s.reach ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS v
FROM e JOIN espan s ON s.image_id = e.image_id"""


@query("r4_saliency_edges", "WITH " + _edges_sql("SELECT image_id, unnest(range(64)) AS pos, CAST(unnest(px) AS DOUBLE) AS v FROM fx_gray"))
def _(d):
    return _cells(rs.saliency_edges(_gray(d)))


_WEIGHT_MAPS = """SELECT s.image_id, m.pos - 1 AS pos, CAST(CAST(abs(m.m * 10 * (1 + s.image_id % 5)) AS FLOAT) AS DOUBLE) AS v FROM scored s JOIN mean m ON m.class_idx = s.predicted_idx"""


def _attribution(d):
    rows, weights = session_rows(d)
    return rs.attribution(hd.score(rows, weights), weights, 8, 8)


@query("r5_attribution", _SCORED_SESSIONS + f", a AS ({_WEIGHT_MAPS}) SELECT image_id, CAST(pos AS INT) AS pos, round(v, 5) AS v FROM a")
def _(d):
    return _cells(_attribution(d), 5)


@query("r5_attribution_edges", _SCORED_SESSIONS.rstrip() + ",\n" + _edges_sql(_WEIGHT_MAPS))
def _(d):
    return _cells(rs.saliency_edges(_attribution(d)))
