"""Training of all pending sessions at once: small batches, dropout, many heads in one pass over the features.

Each session's training images are dealt into blocks of bounded size. In an epoch every block starts from its session's
head and takes its steps one after the other, inside one task; the heads of a session's blocks are then averaged, weighted
by the rows they saw. A session that fits one block is thus trained by plain stochastic descent, and a large one by as many
tasks as it has blocks. Heads travel by joins and sums; only the number of epochs reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyweave.functions.ranking import shuffle_key, shuffled_rank
from tallyweave.functions.scalars import join_class_names, slug
from tallyweave.operators.head import L2, LEARNING_RATE, MOMENTUM, SMOOTHING
from tallyweave.operators.preparation import PRIME, SPLIT_SEED
from tallyweave.session import scratch, settle

# Fixed value: the share of inputs that a step leaves out.
DROPOUT = 0.2
# Numbers of a block: 8 MB of features, so that a task holds a few blocks whatever their width.
BLOCK_VALUES = 1 << 20
# Numbers of the blocks that travel together, so that heads are sent once for several small blocks.
BUNDLE_VALUES = 1 << 18
# Sessions that read a block together; inputs of a step, draws at a time and logits judged at a time, so that they
# fit a core's cache; heads a task holds.
TOGETHER = 128
STEP_VALUES = 1 << 17
DRAWN_VALUES = 1 << 16
JUDGED_VALUES = 1 << 16
HELD_HEADS = 4096
GIVEN_HEADS = 256
# Heads and blocks of a plan meet in up to this many parts, so that a plan is no single task.
PARTS = 16
# Inputs of an image are drawn at this distance from each other.
INPUT_STEP = 104729

# What blocks have in common: sessions of equal dataset, batch size and split read the same blocks.
_PLAN = ["dataset_id", "batch_size", "training"]
_PASS = "session_id bigint, part string, n bigint, loss double, correct bigint, w array<double>, speed array<double>"
_HEAD = "session_id bigint, w array<double>, speed array<double>"
_MOST_TASKS = 10000


@dataclass(frozen=True)
class Descent:
    """How heads are trained; the numbers of epochs and images a batch come with each session."""

    lr: float = LEARNING_RATE
    momentum: float = MOMENTUM
    l2: float = L2
    smoothing: float = SMOOTHING
    dropout: float = DROPOUT
    block_values: int = BLOCK_VALUES


@dataclass(frozen=True)
class Trained:
    """Heads, one history row per epoch, the sessions' new status, and why some could not be trained."""

    weights: DataFrame
    epochs: DataFrame
    updates: DataFrame


# ---- draws that depend on session, image and pass only ----


def stir(x: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """One round of a hash below ``PRIME``; everything fits 64 bits."""
    y = (x + key) % PRIME
    return (y * y % PRIME * 48271 + 12345) % PRIME


def place_draw(session: int, images: np.ndarray, number: int) -> np.ndarray:
    """By which a pass orders the images of a block (ties by image)."""
    return stir(stir(stir(images % PRIME, session % PRIME), number), 17)


def input_draw(places: np.ndarray, width: int) -> np.ndarray:
    """For each image (by its place draw) and input, the number below ``PRIME`` that decides about dropping it."""
    return stir(stir(places[:, None], np.arange(1, width + 1, dtype=np.int64)[None, :] * INPUT_STEP), 31)


# ---- one block, one epoch ----


def _stirred(x: np.ndarray, *keys: int) -> np.ndarray:
    """``stir`` once, and again by each of the (small) keys, of numbers below ``2 * PRIME`` that hold the first key already; they
    are used up. Remainders are taken by shifts: 2 ** 31 leaves 1, so the bits above the lowest 31 are added to these."""
    prime, bits = np.uint64(PRIME), np.uint64(PRIME.bit_length())
    high = np.empty_like(x)
    for key in (*keys, 0):
        for times, plus in ((x, 0), (np.uint64(48271), 12345 + key)):
            np.multiply(x, times, out=x)
            if plus:
                np.add(x, np.uint64(plus), out=x)
            np.right_shift(x, bits, out=high)
            np.bitwise_and(x, prime, out=x)
            np.add(x, high, out=x)
    np.subtract(x, prime, out=high)  # wraps to a large number where x is below
    return np.minimum(x, high, out=x)


def _places(sessions: np.ndarray, images: np.ndarray, number: int) -> np.ndarray:
    """``place_draw`` of each session (row) for each image (column)."""
    below = lambda ids: (ids % PRIME).astype(np.uint64)
    return _stirred(below(sessions)[:, None] + below(images), number, 17).view(np.int64)


def _stays(x: np.ndarray, dropout: float) -> np.ndarray:
    """Whether ``stir(stir(x), 31) >= dropout * PRIME`` for numbers below ``2 * PRIME``, which are used up."""
    return _stirred(x, 31) >= np.uint64(np.ceil(dropout * PRIME))


def _kept(places: np.ndarray, width: int, dropout: float) -> np.ndarray:
    """Which inputs stay: ``input_draw(places, width) >= dropout * PRIME``."""
    keys = (np.arange(1, width + 1, dtype=np.int64) * INPUT_STEP % PRIME).astype(np.uint64)
    return _stays(places.astype(np.uint64)[..., None] + keys, dropout)


class _Draws:
    """The inputs that stay, as bits; after many draws from a table of all there are.

    An input's draw depends on the sum of place and ``INPUT_STEP`` times its number only, so there are ``PRIME`` draws in all.
    The table has a row for each remainder by ``INPUT_STEP``; what an image keeps lies in one row, side by side. It takes
    0.27 GB and as long as ``PRIME`` draws, so it is made once a worker has made as many draws without it.
    """

    def __init__(self, width: int, dropout: float, least: int = PRIME):
        self.width, self.dropout, self.least, self.drawn, self.table = width, dropout, least, 0, None

    def _tabulate(self, end: int = INPUT_STEP) -> None:
        # the row's last numbers are beyond PRIME: there the row goes on as the draws of an image do
        words = -(-(PRIME // INPUT_STEP + 1 + self.width) // 64) + 1
        steps = (np.arange(words * 64, dtype=np.int64) * INPUT_STEP % PRIME).astype(np.uint64)
        rows = np.empty((INPUT_STEP, words * 8), np.uint8)
        each = max(1, DRAWN_VALUES // len(steps))
        for r in range(0, end, each):
            some = np.arange(r, min(r + each, end), dtype=np.uint64)
            rows[r : r + len(some)] = np.packbits(_stays(steps + some[:, None], self.dropout), axis=1, bitorder="little")
        self.table, self.words = rows.view("<u8").reshape(-1), words

    def bits(self, places: np.ndarray) -> np.ndarray:
        """Bytes (..., width / 8), the first input in the lowest bit."""
        size = -(-self.width // 8)
        if self.table is None:
            self.drawn += places.size * self.width
            if self.drawn >= self.least:
                self._tabulate()
        flat = places.reshape(-1)
        if self.table is None:
            found, each = np.empty((len(flat), size), np.uint8), max(1, DRAWN_VALUES // self.width)
            for a in range(0, len(flat), each):
                found[a : a + each] = np.packbits(_kept(flat[a : a + each], self.width, self.dropout), axis=-1, bitorder="little")
            return found.reshape(*places.shape, size)
        first = flat // INPUT_STEP + 1
        at, skip = flat % INPUT_STEP * self.words + (first >> 6), (first & 63).astype(np.uint64)
        found = np.empty((len(flat), -(-size // 8)), "<u8")
        low = self.table[at]
        for k in range(found.shape[1]):
            high = self.table[at + k + 1]
            found[:, k] = low >> skip | high << np.uint64(1) << (np.uint64(63) - skip)
            low = high
        return found.view(np.uint8)[:, :size].reshape(*places.shape, size)


_DRAWS: dict[tuple[int, float], _Draws] = {}
# For each byte its bits, lowest first, as numbers all of whose bits are set or none.
_BITS = -np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _draws(width: int, dropout: float) -> _Draws:
    """The worker's draws; one table at most is kept."""
    if (width, dropout) not in _DRAWS:
        _DRAWS.clear()
        _DRAWS[width, dropout] = _Draws(width, dropout)
    return _DRAWS[width, dropout]


def _figures(z: np.ndarray, y: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities - targets, summed losses, hits) by logits (heads, classes, rows), which are used up, and class indexes (heads, rows)."""
    heads, classes, rows = z.shape
    flat, base = z.reshape(-1), smoothing / classes
    at = np.arange(heads)[:, None] * (classes * rows) + np.arange(rows) + y * rows
    top, own = z.max(axis=1), flat[at]
    # the first of several best classes counts, which is seldom asked
    single = np.count_nonzero(z == top[:, None]) == top.size and not np.isnan(top).any()
    hit = own == top if single else z.argmax(axis=1) == y
    z -= top[:, None]
    own -= top
    loss = -(1 - smoothing) * own.sum(axis=1) - base * z.reshape(heads, -1).sum(axis=1)
    np.exp(z, out=z)
    total = z.sum(axis=1)
    loss += np.log(total).sum(axis=1)
    z /= total[:, None]
    z -= base
    flat[at] -= 1 - smoothing
    return z, loss, hit.sum(axis=1)


def _penalty(w: np.ndarray, how: Descent) -> np.ndarray:
    """For heads without their biases."""
    flat = w.reshape(len(w), -1)
    return how.l2 * np.einsum("hv,hv->h", flat, flat)


def descend_many(
    sessions: np.ndarray, images: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray, speed: np.ndarray, epoch: int, batch: int,
    how: Descent,
) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """The steps of one block in one epoch (from 0) for several sessions at once: (w, speed, rows seen, summed losses with penalty, hits).

    Passes over the block follow each other without end, each in its own order and with a short last batch; an epoch takes
    the next ``rows // batch`` batches of them, so what one epoch leaves is first in the next. ``w`` and ``speed`` are
    (session, class, input) with the biases last; every session has its own orders and drops its own inputs.
    """
    rows, width = x.shape
    by_image = np.argsort(images, kind="stable")
    images, y, scaled = images[by_image], y[by_image].astype(np.int64), x[by_image] / (1 - how.dropout)
    steps, per_pass = rows // batch, -(-rows // batch)
    w, b, fast, fast_b = (v.copy() for v in (w[..., :-1], w[..., -1], speed[..., :-1], speed[..., -1]))
    inputs, kept, grad = None, None, np.empty_like(w)
    seen, total, hits = 0, np.zeros(len(sessions)), np.zeros(len(sessions), np.int64)
    first, end, digits = epoch * steps, (epoch + 1) * steps, rows.bit_length()
    for number in range(first // per_pass, -(-end // per_pass)):
        start = max(0, first - number * per_pass) * batch
        stop = min(rows, (end - number * per_pass) * batch)
        # the draw that orders images, and below it the image's place among all, by which equal draws are ordered
        keys = _places(sessions, images, number) << digits | np.arange(rows)
        keys = np.sort(keys, axis=1)[:, start:stop]
        order, bits = keys & ((1 << digits) - 1), _draws(width, how.dropout).bits(keys >> digits)
        for a in range(0, stop - start, batch):
            chosen = order[:, a : a + batch]
            n = chosen.shape[1]
            if inputs is None or inputs.shape[1] != n:
                # large arrays are used again, as new ones cost more than what is done with them
                inputs, kept = np.empty((len(sessions), n, width)), np.empty((len(sessions), n, bits.shape[2], 8), np.int64)
            np.take(scaled, chosen, axis=0, out=inputs, mode="clip")
            np.take(_BITS, bits[:, a : a + batch], axis=0, out=kept, mode="clip")
            whole = inputs.view(np.int64)
            np.bitwise_and(whole, kept.reshape(len(sessions), n, -1)[..., :width], out=whole)
            z = w @ inputs.transpose(0, 2, 1)
            z += b[..., None]
            gap, loss, hit = _figures(z, y[chosen], how.smoothing)
            seen, total, hits = seen + n, total + loss + _penalty(w, how) * n, hits + hit
            # the penalty's part of the gradient belongs to the head before the step
            np.matmul(gap, inputs, out=grad)
            grad *= how.lr / n
            fast *= how.momentum
            fast -= grad
            np.multiply(w, 2 * how.lr * how.l2, out=grad)
            fast -= grad
            w += fast
            fast_b = how.momentum * fast_b - how.lr / n * gap.sum(axis=2)
            b = b + fast_b
    return np.concatenate([w, b[..., None]], axis=2), np.concatenate([fast, fast_b[..., None]], axis=2), seen, total, hits


def descend(
    session: int, images: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray, speed: np.ndarray, epoch: int, batch: int,
    how: Descent,
) -> tuple[np.ndarray, np.ndarray, int, float, int]:
    """``descend_many`` for one session."""
    w, speed, n, loss, hits = descend_many(np.array([session], np.int64), images, y, x, w[None], speed[None], epoch, batch, how)
    return w[0], speed[0], n, float(loss[0]), int(hits[0])


def _judge(y: np.ndarray, x: np.ndarray, w: np.ndarray, how: Descent) -> tuple[np.ndarray, np.ndarray]:
    """(summed losses with penalty, hits) of several heads on the same rows, a bounded number of rows at a time."""
    heads, classes, wide = w.shape
    weights, b = np.ascontiguousarray(w[..., :-1]), w[..., -1]
    total, hits = _penalty(weights, how) * len(y), np.zeros(heads, np.int64)
    each = max(1, JUDGED_VALUES // (heads * classes))
    for a in range(0, len(y), each):
        part = x[a : a + each]
        z = (weights.reshape(-1, wide - 1) @ part.T).reshape(heads, classes, len(part))
        z += b[..., None]
        _, loss, hit = _figures(z, np.broadcast_to(y[a : a + each], (heads, len(part))), how.smoothing)
        total, hits = total + loss, hits + hit
    return total, hits


def _numbers(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


_PASS_ARROW = pa.schema(
    [("session_id", pa.int64()), ("part", pa.string()), ("n", pa.int64()), ("loss", pa.float64()),
     ("correct", pa.int64()), ("w", pa.list_(pa.float64())), ("speed", pa.list_(pa.float64()))]
)


def _over_blocks(blocks: list[slice], sessions, images, y, x, w, speed, epoch: int, batch: int, how: Descent) -> list:
    """``descend_many`` from the same heads on each block: rows seen, summed losses and hits, and sums of heads and speeds by rows seen."""
    sums: list = []
    for block in blocks:
        head, fast, n, loss, hits = descend_many(sessions, images[block], y[block], x[block], w, speed, epoch, batch, how)
        new = [n, loss, hits, head.reshape(len(sessions), -1) * n, fast.reshape(len(sessions), -1) * n]
        sums = [p + q for p, q in zip(sums, new, strict=True)] if sums else new
    return sums


def _block_pass(epoch: int, how: Descent) -> Callable:
    """Per (bundle of blocks, group of sessions): train on each block (``block`` numbers the rows' blocks; without it there is one),
    or judge the heads on the rows. Heads of a session are averaged over a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                part, classes, size = cell["part"].as_py(), cell["classes"].as_py(), cell["batch_size"].as_py()
                sessions, images, y = _numbers(cell["sessions"]), _numbers(cell["images"]), _numbers(cell["class_idx"])
                x = _numbers(cell["x"]).reshape(len(images), -1).astype(np.float64)
                w = _numbers(cell["w"]).reshape(len(sessions), classes, -1)
                speed = _numbers(cell["speed"]).reshape(len(sessions), classes, -1) if part == "training" else None
                cuts = np.flatnonzero(np.diff(_numbers(cell["block"]))) + 1 if "block" in cell and part == "training" else []
                blocks = [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(images)], strict=True)]
                each = max(1, STEP_VALUES // (size * x.shape[1]))
                for a in range(0, len(sessions), each):
                    some, head = sessions[a : a + each], w[a : a + each]
                    if part == "training":
                        summed = _over_blocks(blocks, some, images, y, x, head, speed[a : a + each], epoch, size, how)
                    else:
                        summed = [len(images), *_judge(y, x, head, how)]
                    for k, session in enumerate(some.tolist()):
                        new = [summed[0], *(v[k] for v in summed[1:])]
                        old = sums.get((session, part))
                        sums[session, part] = new if old is None else [p + q for p, q in zip(old, new, strict=True)]
            if len(sums) >= HELD_HEADS:
                yield from _given(sums)
                sums = {}
        yield from _given(sums)

    return run


def _given(sums: dict[tuple[int, str], list]) -> Iterator[pa.RecordBatch]:
    """The rows of a pass; sums of heads become averages by the rows seen."""
    given = list(sums.items())
    for a in range(0, len(given), GIVEN_HEADS):
        rows = []
        for (session, part), (n, loss, hits, *heads) in given[a : a + GIVEN_HEADS]:
            w, speed = [h / n for h in heads] or (None, None)
            rows.append((session, part, n, float(loss), int(hits), w, speed))
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _PASS_ARROW, strict=True)], schema=_PASS_ARROW)


# ---- what is to be trained ----


def _dataset_figures(rows: DataFrame) -> DataFrame:
    """Per dataset: images, classes (sorted label slugs, as many as there are labels), and what is wrong with its images."""
    odd = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("label_slug")).alias("classes"),
        F.count_if(F.col("label_slug").isNull()).alias("unnamed"),
        F.count_if(F.col("features").isNull()).alias("bare"),
        F.count_if(odd).alias("odd"),
        F.min(F.size("features")).alias("narrow"),
        F.max(F.size("features")).alias("width"),
    )


def _fault() -> Column:
    batch, epochs, share = F.col("batch_size"), F.col("epochs"), F.col("validation_split")
    settings = (epochs >= 1) & (batch >= 1) & (share >= 0) & (share < 1)
    return (
        F.when(~F.coalesce(settings, F.lit(False)), "settings are missing or out of range")
        .when(F.col("n").isNull(), "dataset has no images")
        .when(F.col("unnamed") > 0, "image has no label")
        .when(F.col("bare") > 0, "image has no features")
        .when((F.col("odd") > 0) | (F.col("width") == 0), "features are not finite")
        .when(F.col("narrow") != F.col("width"), "features differ in length")
        .when(F.col("training") < batch, "fewer training images than a batch")
    )


def _plans(ready: DataFrame, how: Descent) -> DataFrame:
    """One row per plan: rows of a block, the last training block, blocks of a bundle, and the parts its bundles are dealt to."""
    batch, training = F.col("batch_size"), F.col("training")
    size = batch * F.greatest(F.lit(1), F.floor(F.lit(how.block_values) / (F.col("width") * batch)))
    plans = ready.select(*_PLAN, "n", "width", "classes").distinct().withColumn("size", size)
    plans = plans.withColumns({
        "last": F.greatest(F.lit(1), F.floor(training / F.col("size"))) - 1,
        "together": F.greatest(F.lit(1), F.floor(F.lit(BUNDLE_VALUES) / (F.col("width") * F.col("size")))),
    })
    return plans.withColumn("parts", F.least(F.lit(PARTS), F.floor(F.col("last") / F.col("together")) + 1))


def _blocks(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per bundle of blocks: its images, their blocks, class indexes and features, row after row.

    The split is that of ``train_val_split`` on the dataset's images. Training blocks hold a whole number of batches, but
    for the last one, which also takes the rest; the validation part ends with its last whole batch.
    """
    ranked = shuffled_rank(rows, shuffle_key(SPLIT_SEED, "image_id"), "image_id", ["dataset_id"], rank="position")
    batch, training, late = F.col("batch_size"), F.col("training"), F.col("position") - F.col("training")
    block = F.when(late <= 0, F.least(F.floor((F.col("position") - 1) / F.col("size")), F.col("last"))).otherwise(
        F.floor((late - 1) / F.col("size"))
    )
    placed = (
        ranked.join(plans, "dataset_id")
        .filter((late <= 0) | (late <= F.floor((F.col("n") - training) / batch) * batch))
        .select(
            *_PLAN, "together", "parts", "image_id", "features", block.alias("block"),
            F.when(late <= 0, "training").otherwise("validation").alias("part"),
            (F.array_position("classes", F.col("label_slug")) - 1).cast("int").alias("class_idx"),
        )
    )
    # a bundle has less than two blocks' worth of rows, or than two bundles' of small blocks, whatever the dataset's size
    bundle = F.floor(F.col("block") / F.col("together")).alias("bundle")
    packed = placed.groupBy(*_PLAN, "part", "parts", bundle).agg(
        F.array_sort(F.collect_list(F.struct("block", "image_id", "class_idx", "features"))).alias("_rows")
    )
    return packed.select(
        *_PLAN, "part", F.pmod("bundle", "parts").alias("dealt"), F.col("_rows.block").alias("block"),
        F.col("_rows.image_id").alias("images"), F.col("_rows.class_idx").alias("class_idx"), F.flatten("_rows.features").alias("x"),
    )


def _stacks(heads: DataFrame) -> DataFrame:
    """One row per group of sessions with all their heads, for each part of the bundles."""
    speed = F.when(F.col("part") == "training", F.col("speed"))
    # a group has about TOGETHER sessions
    stacks = heads.groupBy(*_PLAN, "classes", "parts", "part", "group").agg(
        F.array_sort(F.collect_list(F.struct("session_id", "w", speed.alias("speed")))).alias("_heads")
    )
    return stacks.select(
        *_PLAN, "classes", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("dealt"),
        F.col("_heads.session_id").alias("sessions"), F.flatten("_heads.w").alias("w"), F.flatten("_heads.speed").alias("speed"),
    )


def _averaged(trained: DataFrame) -> DataFrame:
    """Heads and speeds of a session, averaged over the tasks' by the rows they saw; there are about as many as parts."""
    given = trained.groupBy("session_id").agg(F.collect_list(F.struct("n", "w", "speed")).alias("_given"))
    total = F.aggregate("_given", F.lit(0).cast("long"), lambda n, g: n + g["n"])

    def mean(name: str) -> Column:
        nothing = F.transform(F.element_at("_given", 1)[name], lambda v: F.lit(0.0))
        summed = F.aggregate("_given", nothing, lambda a, g: F.zip_with(a, g[name], lambda p, q: p + q * g["n"]))
        return F.transform(summed, lambda v: v / F.col("_total")).alias(name)

    return given.withColumn("_total", total).select("session_id", mean("w"), mean("speed"))


def _history(passes: DataFrame) -> DataFrame:
    """Training figures of an epoch come from its own pass, while heads moved; validation figures from the next pass."""
    training = F.col("part") == "training"
    rows = passes.withColumn("number", (F.col("pass") + training.cast("int")).cast("int"))
    share = lambda which, name: F.sum(F.when(which, F.col(name))) / F.sum(F.when(which, F.col("n")))
    return rows.groupBy("session_id", "number").agg(
        share(training, "correct").alias("accuracy"), share(training, "loss").alias("loss"),
        share(~training, "correct").alias("val_accuracy"), share(~training, "loss").alias("val_loss"),
    )


def train_sessions(sessions: DataFrame, images: DataFrame, features: DataFrame, labels: DataFrame, how: Descent = Descent()) -> Trained:
    """Train a head for every pending session, in as many passes as the longest session has epochs, and one.

    ``sessions`` carries session_id, name, dataset_id, status and the settings of its model: epochs, batch_size and
    validation_split. ``features`` (image_id, features) are those of one backbone; call once for each backbone. The classes
    of a session are the sorted label slugs of its dataset's images. ``updates`` has session_id, status, class_names and
    reason: a session whose settings, images or features do not allow training, or whose head does not stay finite, becomes
    Failed and has no head; the others are trained all the same and become Completed. Weights start at zero. With neither
    whole validation batch, the validation figures are null. No pending session gives empty tables.
    """
    spark = sessions.sparkSession
    settings = ["epochs", "batch_size", "validation_split"]
    pending = settle(sessions.filter("status = 'Pending'").select("session_id", "name", "dataset_id", *settings), "pending")
    named = labels.select("label_id", slug("name").alias("label_slug"))
    shown = images.select("image_id", "dataset_id", "label_id").join(pending.select("dataset_id").distinct(), "dataset_id", "left_semi")
    kind = "array<float>" if features.schema["features"].dataType == ArrayType(FloatType()) else "array<double>"
    vectors = features.select("image_id", F.col("features").cast(kind).alias("features"))
    rows = shown.join(named, "label_id", "left").join(vectors, "image_id", "left").drop("label_id")
    rows = settle(rows, "training-images")
    asked = pending.join(_dataset_figures(rows), "dataset_id", "left")
    asked = asked.withColumn("training", F.col("n") - F.floor(F.col("n") * F.col("validation_split")))
    asked = settle(asked.withColumn("reason", _fault()), "training-requests")
    ready = asked.filter("reason IS NULL")
    usable = rows.join(ready.select("dataset_id").distinct(), "dataset_id", "left_semi")
    plans = settle(_plans(ready, how), "training-plans")
    blocks = settle(_blocks(usable, plans), "training-blocks")

    folder = scratch(spark, "training")
    plan = ready.select("session_id", "epochs", *_PLAN, F.size("classes").alias("classes"), "width")
    groups = plan.groupBy(*_PLAN).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("groups")).join(plans.select(*_PLAN, "parts"), _PLAN)
    plan = plan.join(groups, _PLAN).withColumn("group", F.pmod(F.xxhash64("session_id"), "groups")).drop("groups")
    plan = settle(plan, "training-sessions")
    # more tasks than parts, so that few tasks are dealt several; a given number, as adaptive execution would put small
    # partitions together, though they stand for much work
    tasks = max(1, min(2 * (plans.agg(F.sum("parts")).first()[0] or 0), _MOST_TASKS))
    key = [*_PLAN, "part", "dealt"]
    nothing = F.array_repeat(F.lit(0.0), (F.col("classes") * (F.col("width") + 1)).cast("int"))
    plan.select("session_id", nothing.alias("w"), nothing.alias("speed")).write.parquet(f"{folder}/heads/done=0")
    longest = plan.agg(F.max("epochs")).first()[0] or 0
    for number in range(longest + 1):
        heads = spark.read.schema(_HEAD).parquet(f"{folder}/heads/done={number}").join(plan, "session_id")
        # a session's last pass only judges its head
        parts = F.array(F.when(F.col("epochs") > number, "training"), F.when(F.lit(number > 0), "validation"))
        stacks = _stacks(heads.withColumn("part", F.explode(F.array_compact(parts))))
        used = [part for part, needed in (("training", number < longest), ("validation", number > 0)) if needed]
        # a stack meets all bundles of its part before the next one comes, so that a task gives few heads twice; heads much
        # alike are small in a file but not in memory, so their size must not have them broadcast
        left, right = stacks.repartition(tasks, *key), blocks.filter(F.col("part").isin(used)).repartition(tasks, *key)
        joined = left.hint("merge").join(right, key)
        joined = joined.select("sessions", "part", "batch_size", "classes", "images", "block", "class_idx", "x", "w", "speed")
        done = f"{folder}/passes/pass={number}"
        joined.mapInArrow(_block_pass(number, how), _PASS).write.parquet(done)
        if number < longest:
            trained = spark.read.schema(_PASS).parquet(done).filter("part = 'training'")
            _averaged(trained).write.parquet(f"{folder}/heads/done={number + 1}")

    passes = spark.read.schema(f"{_PASS}, pass int").parquet(f"{folder}/passes")
    last = spark.read.schema(f"{_HEAD}, done int").parquet(f"{folder}/heads")
    final = ready.join(last.withColumnRenamed("done", "epochs"), ["session_id", "epochs"])
    broken = F.exists("w", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    final = settle(final.select("session_id", "name", "classes", "width", "w", broken.alias("broken")), "trained-heads")
    wide = (F.col("width") + 1).cast("int")
    each = final.filter("NOT broken").select("session_id", "name", "w", wide.alias("wide"), F.posexplode("classes").alias("class_idx", "class_name"))
    weights = each.select(
        "session_id", slug("name").alias("session_slug"), "class_idx", "class_name",
        F.slice("w", F.col("class_idx") * F.col("wide") + 1, F.col("wide") - 1).alias("w"),
        F.element_at("w", (F.col("class_idx") + 1) * F.col("wide")).alias("b"),
    )
    judged = asked.join(final.select("session_id", "broken"), "session_id", "left")
    reason = F.coalesce("reason", F.when(F.col("broken"), "head does not stay finite"))
    updates = judged.select(
        "session_id", F.when(reason.isNull(), "Completed").otherwise("Failed").alias("status"),
        join_class_names("classes").alias("class_names"), reason.alias("reason"),
    )
    return Trained(weights, _history(passes), updates)
