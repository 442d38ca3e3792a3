"""Image preparation as Spark jobs over a raster table (image_id, h, w, c, px).

Spark partitions the images; a task turns each Arrow batch into pixel blocks of one shape and
applies vectorised numpy kernels. Random draws are columns computed from ``md5(seed:epoch:op:id)``,
so a retry or another partitioning gives the same pictures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.ranking import uniform
from tallyweave.operators.preparation import PRIME
from tallyweave.operators.training import stir
from tallyweave.schemas import AUGMENTATION_FLAGS
from tallyweave.session import settle
from tallyweave.sources.ingest import below, class_of

RASTER = "image_id long, h int, w int, c int, px array<float>"
# Pixels of one block: with Spark's own limit on the bytes of an Arrow batch it bounds a task's working memory.
BLOCK_PIXELS = 4_000_000


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one shape, as (rows, n x h x w x c pixels), a bounded number of pixels at a time."""
    for (h, w, c), rows in pdf.groupby(["h", "w", "c"], sort=False):
        step = max(1, BLOCK_PIXELS // max(1, h * w * c))
        for start in range(0, len(rows), step):
            part = rows.iloc[start : start + step]
            yield part, np.stack(part["px"].to_list()).astype(np.float64).reshape(len(part), h, w, c)


def map_rasters(rasters: DataFrame, kernel: Callable[[np.ndarray, pd.DataFrame], np.ndarray], extra: str = "") -> DataFrame:
    """Apply ``kernel(pixels, rows)`` to every block; columns named in ``extra`` ("name type, ...") pass through."""
    passed = [part.split()[0] for part in extra.split(",") if part.strip()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for rows, pixels in _blocks(pdf):
                out = kernel(pixels, rows)
                n, h, w, c = out.shape
                yield pd.DataFrame(
                    {
                        "image_id": rows["image_id"].to_numpy(),
                        "h": h,
                        "w": w,
                        "c": c,
                        "px": list(out.reshape(n, -1).astype(np.float32)),
                        **{name: rows[name].to_numpy() for name in passed},
                    }
                )

    return rasters.mapInPandas(run, RASTER + (f", {extra}" if extra else ""))


def _image_files(spark: SparkSession, root: str) -> DataFrame:
    """Spark's image source over a folder, with each file's class: the first folder below ``root``, null beside them."""
    image = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    # the source gives encoded addresses, in which a plus stands for itself
    path = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    label = class_of(below(spark, root, path))
    return image.select("image.*", path.alias("path"), label.alias("label"))


def unreadable_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, reason) of the files below ``root`` that cannot be decoded; ``read_images`` returns all others.

    Files without any byte are in neither: Spark's file sources skip them.
    """
    return _image_files(spark, root).filter("height < 0").select("path", "label", F.lit("not a readable image").alias("reason"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decode a labelled folder with Spark's image source: (path, label, h, w, c, px) in RGB(A) order.

    Files that cannot be decoded are listed by ``unreadable_images``.
    """
    flat = _image_files(spark, root).filter("height >= 0").drop("origin")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                px = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                if r.nChannels >= 3:  # stored blue first
                    px = px[:, :, [2, 1, 0] + list(range(3, r.nChannels))]
                rows.append((r.path, r.label, r.height, r.width, r.nChannels, px.ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "label", "h", "w", "c", "px"])

    return flat.mapInPandas(run, "path string, label string, h int, w int, c int, px array<float>")


# ---- alpha, resize ----


def _over_white(pixels: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    channels = pixels.shape[3]
    if channels == 1:
        return np.repeat(pixels, 3, axis=3)
    if channels != 4:
        return pixels
    alpha = pixels[..., 3:]
    # whole-number blend, rounded to nearest (255 is odd, so there are no ties)
    return np.floor((pixels[..., :3] * alpha + 255.0 * (255.0 - alpha) + 127.0) / 255.0)


def flatten_alpha(rasters: DataFrame) -> DataFrame:
    """RGBA over a white background becomes RGB; grey becomes RGB; the input table is left alone."""
    return map_rasters(rasters, _over_white)


def _bilinear(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Half-pixel centres, edges clamped."""
    for axis, size in ((1, height), (2, width)):
        old = pixels.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, old - 1)
        shape = [1, 1, 1, 1]
        shape[axis] = size
        part = (at - low).reshape(shape)
        pixels = np.take(pixels, low, axis) * (1 - part) + np.take(pixels, high, axis) * part
    return pixels


def _nearest(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    for axis, size in ((1, height), (2, width)):
        old = pixels.shape[axis]
        pixels = np.take(pixels, np.minimum(((np.arange(size) + 0.5) * old / size).astype(int), old - 1), axis)
    return pixels


def resize_rescale(rasters: DataFrame, size: int, method: str = "bilinear", scale: float = 1 / 255) -> DataFrame:
    """Resize to size x size and rescale; training reads bilinear, testing reads nearest."""
    resize = {"bilinear": _bilinear, "nearest": _nearest}[method]
    return map_rasters(rasters, lambda px, rows: resize(px, size, size) * scale)


# ---- augmentation ----

# Fixed values of the augmentation steps.
GRAY_WEIGHTS = [0.2989, 0.5870, 0.1140]
ROTATION_TURNS = 0.15  # of a full turn either way: 54 degrees
ZOOM_HEIGHT, ZOOM_WIDTH = 0.05, 0.15
BRIGHTNESS, CONTRAST = 0.1, 0.1
CROP_PIXELS = 10
NOISE_SIGMA = 0.02
BLUR_SIGMA, BLUR_SIZE = 0.7, 3
CUTOUT_SIZE = 20

# Sets the places of a picture apart in the hash that its noise is drawn from.
NOISE_STRIDE = 7919

# Draws each step needs, in a fixed order.
DRAWS = [
    "random_grayscale", "horizontal_flip", "vertical_flip", "random_rotation", "zoom_height", "zoom_width",
    "brightness", "contrast", "crop_top", "crop_left", "gaussian_noise", "cutout_row", "cutout_column",
]


@dataclass(frozen=True)
class Augmentation:
    """Switches of a model row. Without ``data_augmentation`` nothing is applied.

    ``clip_max`` closes the brightness and contrast step: 1.0 is the behaviour to be matched, which
    on 0..255 pixels saturates nearly all of them; 255.0 is what was probably meant.
    """

    data_augmentation: bool = True
    grayscale: bool = False
    random_grayscale: bool = False
    horizontal_flip: bool = False
    vertical_flip: bool = False
    random_rotation: bool = False
    zoom: bool = False
    brightness_contrast: bool = False
    random_crop: bool = False
    gaussian_noise: bool = False
    blur: bool = False
    cutout: bool = False
    clip_max: float = 1.0
    crop_pixels: int = CROP_PIXELS
    cutout_size: int = CUTOUT_SIZE

    @staticmethod
    def from_model(row) -> Augmentation:
        flags = {flag: bool(row[flag]) for flag in ["data_augmentation", *AUGMENTATION_FLAGS]}
        return Augmentation(**flags)


def _grayscale(px: np.ndarray, on: np.ndarray) -> np.ndarray:
    if px.shape[3] < 3:
        return px
    gray = (px[..., :3] * np.array(GRAY_WEIGHTS)).sum(axis=3, keepdims=True)
    return np.where(on[:, None, None, None], np.repeat(gray, px.shape[3], axis=3), px)


def _reflect(at: np.ndarray, size: int) -> np.ndarray:
    """Mirror coordinates into the picture, edges repeated (d c b a | a b c d | d c b a)."""
    at = np.mod(at + 0.5, 2 * size)
    return np.clip(np.where(at < size, at, 2 * size - at) - 0.5, 0, size - 1)


def _sample(px: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Bilinear reads of every picture at its own (rows, columns) grid of shape (n, h, w)."""
    n, h, w, _ = px.shape
    rows, columns = _reflect(rows, h), _reflect(columns, w)
    r0, c0 = np.floor(rows).astype(int), np.floor(columns).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (rows - r0)[..., None], (columns - c0)[..., None]
    i = np.arange(n)[:, None, None]
    top = px[i, r0, c0] * (1 - fc) + px[i, r0, c1] * fc
    bottom = px[i, r1, c0] * (1 - fc) + px[i, r1, c1] * fc
    return top * (1 - fr) + bottom * fr


def _grid(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    _, h, w, _ = px.shape
    mid_r, mid_c = (h - 1) / 2, (w - 1) / 2
    return np.arange(h)[None, :, None] - mid_r, np.arange(w)[None, None, :] - mid_c, mid_r, mid_c


def _rotate(px: np.ndarray, angle: np.ndarray) -> np.ndarray:
    r, c, mid_r, mid_c = _grid(px)
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    return _sample(px, cos * r + sin * c + mid_r, -sin * r + cos * c + mid_c)


def _zoom(px: np.ndarray, by_row: np.ndarray, by_column: np.ndarray) -> np.ndarray:
    """A positive amount shows more of the (mirrored) surroundings, a negative one enlarges."""
    r, c, mid_r, mid_c = _grid(px)
    full = np.ones((len(px), px.shape[1], px.shape[2]))
    return _sample(px, full * r * (1 + by_row)[:, None, None] + mid_r, full * c * (1 + by_column)[:, None, None] + mid_c)


def _pick(u: np.ndarray, count: int) -> np.ndarray:
    """Draws in [0, 1) to whole numbers below ``count``."""
    return np.minimum((u * count).astype(int), count - 1)


def _crop(px: np.ndarray, u_top: np.ndarray, u_left: np.ndarray, pixels: int) -> np.ndarray:
    n, h, w, _ = px.shape
    ch, cw = max(1, h - pixels), max(1, w - pixels)
    top, left = _pick(u_top, h - ch + 1), _pick(u_left, w - cw + 1)
    r, c = top[:, None] + np.arange(ch), left[:, None] + np.arange(cw)
    return _bilinear(px[np.arange(n)[:, None, None], r[:, :, None], c[:, None, :]], h, w)


def _blur(px: np.ndarray) -> np.ndarray:
    reach = BLUR_SIZE // 2
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * BLUR_SIGMA**2))
    weights = weights / weights.sum()
    for axis in (1, 2):
        size = px.shape[axis]
        pad = [(0, 0)] * 4
        pad[axis] = (reach, reach)
        # mirrored without repeating the edge; a one-pixel side can only repeat it
        padded = np.pad(px, pad, mode="reflect" if size > reach else "edge")
        px = sum(wt * np.take(padded, np.arange(i, i + size), axis) for i, wt in enumerate(weights))
    return px


def _noise(u: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Normal draws for every value of every picture, from its draw and its place alone (Box and Muller)."""
    seeds = (u * 2**32).astype(np.int64)[:, None] % PRIME
    places = np.arange(int(np.prod(shape)), dtype=np.int64)[None, :] * NOISE_STRIDE
    mixed = stir(stir(seeds, places), 17)
    radius = np.sqrt(-2 * np.log((stir(mixed, 31) + 0.5) / PRIME))
    return (radius * np.cos(2 * np.pi * stir(mixed, 53) / PRIME)).reshape(len(u), *shape)


def _cutout(px: np.ndarray, u_row: np.ndarray, u_column: np.ndarray, size: int) -> np.ndarray:
    """A zero square around a random centre, cut at the border."""
    _, h, w, _ = px.shape
    half = size // 2
    row, column = _pick(u_row, h)[:, None], _pick(u_column, w)[:, None]
    in_r = (np.arange(h) >= row - half) & (np.arange(h) < row + half)
    in_c = (np.arange(w) >= column - half) & (np.arange(w) < column + half)
    return np.where((in_r[:, :, None] & in_c[:, None, :])[..., None], 0.0, px)


def _augment_kernel(config: Augmentation) -> Callable[[np.ndarray, pd.DataFrame], np.ndarray]:
    def run(px: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        draws = np.stack(rows["u"].to_list())
        u = {name: draws[:, i] for i, name in enumerate(DRAWS)}
        within = lambda name, reach: (2 * u[name] - 1) * reach
        column = lambda values: values[:, None, None, None]
        if config.grayscale:
            px = _grayscale(px, np.ones(len(px), bool))
        if config.random_grayscale:
            px = _grayscale(px, u["random_grayscale"] < 0.5)
        if config.horizontal_flip:
            px = np.where((u["horizontal_flip"] < 0.5)[:, None, None, None], px[:, :, ::-1], px)
        if config.vertical_flip:
            px = np.where((u["vertical_flip"] < 0.5)[:, None, None, None], px[:, ::-1], px)
        if config.random_rotation:
            px = _rotate(px, within("random_rotation", ROTATION_TURNS * 2 * np.pi))
        if config.zoom:
            px = _zoom(px, within("zoom_height", ZOOM_HEIGHT), within("zoom_width", ZOOM_WIDTH))
        if config.brightness_contrast:
            px = np.clip(px + column(within("brightness", BRIGHTNESS) * 255), 0, 255)
            mean = px.mean(axis=(1, 2), keepdims=True)
            px = np.clip((px - mean) * column(1 + within("contrast", CONTRAST)) + mean, 0, 255)
            px = np.clip(px, 0, config.clip_max)
        if config.random_crop:
            px = _crop(px, u["crop_top"], u["crop_left"], config.crop_pixels)
        if config.gaussian_noise:
            px = px + NOISE_SIGMA * _noise(u["gaussian_noise"], px.shape[1:])
        if config.blur:
            px = _blur(px)
        if config.cutout:
            px = _cutout(px, u["cutout_row"], u["cutout_column"], config.cutout_size)
        return px

    return run


def augment(rasters: DataFrame, config: Augmentation, epochs: int = 1, seed: object = 123) -> DataFrame:
    """One augmented row per (image, epoch), for training rows only, before rescaling.

    The steps run in the fixed order of ``AUGMENTATION_FLAGS``.
    """
    each = rasters.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    if not config.data_augmentation:
        return each.select("image_id", "h", "w", "c", "px", "epoch")
    draws = F.array(*[uniform(seed, "epoch", F.lit(name), "image_id") for name in DRAWS])
    return map_rasters(each.withColumn("u", draws), _augment_kernel(config), "epoch int")


# ---- saliency ----


def _stretch(maps: np.ndarray) -> np.ndarray:
    low = maps.min(axis=(1, 2), keepdims=True)
    reach = maps.max(axis=(1, 2), keepdims=True) - low
    # a constant map has no range and becomes zero
    return np.divide(maps - low, reach, out=np.zeros_like(maps), where=reach > 0)


def _sobel(maps: np.ndarray, axis: int) -> np.ndarray:
    across = 3 - axis
    padded = np.pad(maps, [(0, 0), (1, 1), (1, 1)], mode="symmetric")
    size = {a: maps.shape[a] for a in (1, 2)}
    cut = lambda a, at, arr: np.take(arr, np.arange(at, at + size[a]), a)
    slope = cut(axis, 2, padded) - cut(axis, 0, padded)
    return cut(across, 0, slope) + 2 * cut(across, 1, slope) + cut(across, 2, slope)


def _edges(pixels: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    maps = _stretch(pixels[..., 0])
    return _stretch(maps + np.hypot(_sobel(maps, 1), _sobel(maps, 2)))[..., None]


def saliency_edges(maps: DataFrame) -> DataFrame:
    """Stretch to 0..1, add the Sobel edge strength, stretch again."""
    return map_rasters(maps, _edges)


def attribution(scored: DataFrame, weights: DataFrame, h: int, w: int, c: int = 1) -> DataFrame:
    """Saliency map of the predicted class of a linear head: the largest |weight| over the channels.

    ``scored`` has (image_id, session_id, predicted_idx). The gradient of a linear logit is its
    weight vector, so the map is built once per class and joined to the images.
    """
    flat = F.transform("w", lambda x: F.abs(x))
    at = lambda i, j: F.element_at(flat, (i * c + j + 1).cast("int"))
    strongest = F.transform(
        F.sequence(F.lit(0), F.lit(h * w - 1)),
        lambda i: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda j: at(i, j))).cast("float"),
    )
    maps = weights.select("session_id", F.col("class_idx").alias("predicted_idx"), strongest.alias("px"))
    maps = settle(maps, "class-maps")
    return scored.join(maps, ["session_id", "predicted_idx"]).select(
        "image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(1).alias("c"), "px"
    )
